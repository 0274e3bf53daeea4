"""Exact token ids at speed: the installed tokenizers' results, remembered by white-space delimited part of a text.

Both vocabularies treat a text's parts between single spaces on their own, which makes a memo of parts exact; texts for which that does not
hold go to the tokenizer whole. Memos are bounded. Ids fit 16 bits in both vocabularies and are kept as such.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import islice

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts that a memo holds at most, and the longest part that it holds.
MEMO_PARTS, MEMO_CHARS = 400_000, 40
BYTE_BPE, BYTE_RANKS, WORD_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def _library(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def _u16(ids: list[int]) -> bytes:
    return np.array(ids, "<u2").tobytes()


class _Memo:
    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def fill(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as 16-bit little-endian bytes."""
        out = [*map(self.known.get, parts)]
        if None in out:
            at = [i for i, v in enumerate(out) if v is None]
            if len(self.known) > MEMO_PARTS:  # the first seen are the commonest
                self.known = dict(islice(self.known.items(), MEMO_PARTS // 2))
            new = [*dict.fromkeys(parts[i] for i in at)]
            found = dict(zip(new, self.encode_parts(new), strict=True))
            for i in at:
                out[i] = found[parts[i]]
            self.known.update((p, v) for p, v in found.items() if len(p) <= MEMO_CHARS)
        return out


class ByteBpe(_Memo):
    """byte_bpe_50k: a single space starts a new part of the pattern unless it stands between two white-space characters."""

    #: A space inside a run of white space is no boundary.
    inside = re.compile(r"\s \s")

    def __init__(self, path: str | None = None, ranks: str | None = None) -> None:
        import tiktoken

        super().__init__()
        self.library = _library(path or public_tokenizers.path(BYTE_BPE))
        with open(ranks or public_tokenizers.path(BYTE_RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _whole(self, text: str) -> bytes:
        if len(text) > 1000 or "<|" in text:  # the library knows the special token, and long runs
            return _u16(self.library.encode(text, add_special_tokens=False).ids)
        return _u16(self.fast.encode_ordinary(text))

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        return [self._whole(" " + p) for p in parts]

    def encode(self, text: str) -> bytes:
        if self.inside.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(self.fill(rest))


class WordBpe(_Memo):
    """word_bpe_49k: white space is dropped, so spaces and line ends always part."""

    def __init__(self, path: str | None = None) -> None:
        super().__init__()
        self.library = _library(path or public_tokenizers.path(WORD_BPE))
        n = self.library.get_vocab_size()
        self.pieces = [self.library.id_to_token(i) for i in range(n)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        if len(parts) < 3 or any("<|" in p for p in parts):
            return [_u16(self.library.encode(p, add_special_tokens=False).ids) for p in parts]
        e = self.library.encode(parts, is_pretokenized=True, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        if (word < 0).any():
            return [_u16(self.library.encode(p, add_special_tokens=False).ids) for p in parts]
        ids, cuts = np.array(e.ids, "<u2"), np.searchsorted(word, np.arange(len(parts) + 1))
        raw, cuts = ids.tobytes(), (2 * cuts).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        return b"".join(self.fill(text.replace("\n", " ").split(" ")))

    def plain(self, text: str) -> bytes:
        """By the library, without the memo."""
        return _u16(self.library.encode(text, add_special_tokens=False).ids)

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False): it has no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


_made: dict = {}


def shared(kind: type, *args):
    """One per worker process, so that its memo outlives a task."""
    if (kind, args) not in _made:
        _made[kind, args] = kind(*args)
    return _made[kind, args]
