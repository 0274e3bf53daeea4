"""BPE encoding with content-defined chunks that documents share, and decoding.

Texts are cut where a rolling hash of the last 32 bytes hits a mask, so a shared passage gives the same chunks in every document. Chunks are dealt by a
128-bit digest to the task that encodes them once; a task sends a chunk's text with its first occurrence only. Occurrences of a chunk beyond a task's share of HOT_ROWS
go to salted owners, each for the tasks of one salt, so an owner's rows stay bounded however many tasks there are. Each occurrence gets the chunk's ids back; documents are put together in order. A cut may
fall inside a word: a chunk's ids cover what lies between its first and last white space. At each join the loose ends (over as many chunks as have no white space) are
re-encoded by the library together with the nearest part of either neighbour, and the join stands when the result begins with the left part's known ids and ends with the right part's;
if not, it is done again with GUARDS parts of either side, and a join that does not agree then is an error, not a result.

Defined results: null texts are empty (no ids); repeated ids and rows are answered each; an empty table gives no rows; very long texts are cut and joined
the same way; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import text_of

#: Bytes of a chunk: at least, about 2 ** MASK_BITS more, at most.
LEAST, MASK_BITS, MOST = 512, 12, 16384
#: Rows of a chunk that all tasks together may send to its first owner, tasks that share a salted owner beyond that, and salts at least.
HOT_ROWS, TASKS_A_SALT, SALTS = 4096, 64, 64
#: Parts of a chunk on either side that a join may look at.
GUARDS = 4
#: Documents, and characters of each, that the dictionaries for what is shuffled are trained on; they affect its size only.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 500, 20_000, 110 << 10, 9
#: One pseudo-random 32-bit number per byte, by a rule.
GEAR = np.array([(b + 1) * 2654435761 & 0xFFFFFFFF ^ (b + 7) * 40503 * 65537 & 0xFFFFFFFF for b in range(256)], np.uint32)
EDGE = re.compile(rb"[ \n]")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8; no cut falls inside a character."""
    n = len(data)
    if n <= LEAST:
        return [n]
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    for k in (1, 2, 4, 8, 16):  # sums over windows of 2, 4 .. 32 bytes
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    ok = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    ends, at = [], 0
    for c in ok.tolist() + [n]:
        while c - at > MOST:
            e = at + MOST
            while data[e] & 0xC0 == 0x80:
                e -= 1
            ends.append(e)
            at = e
        if c == n or (c - at >= LEAST and data[c] & 0xC0 != 0x80):
            ends.append(c)
            at = c
    return ends if ends[-1] == n else [*ends, n]


_HEAD = struct.Struct("<10i")
_PART = re.compile(rb"[^ \n]+")


def encode_chunk(bpe: tokens.WordBpe, data: bytes) -> bytes:
    """Lengths, then head and tail (before the first and after the last white space), the first and last GUARDS parts between, and the ids of all between. A chunk without
    white space is all head, and its tail's length -1. Lengths: of head and tail, and for either guard its bytes and ids with one part and with all."""
    found = EDGE.search(data)
    if not found:
        return _HEAD.pack(len(data), -1, *[0] * 8) + data
    a, z = found.start(), max(data.rfind(b" "), data.rfind(b"\n")) + 1
    inner = data[a:z]
    n = lambda part: len(bpe.encode(part.decode())) // 2
    left = [m.end() for m, _ in zip(_PART.finditer(inner), range(GUARDS), strict=False)] or [len(inner)]
    right, at = [], len(inner)
    while len(right) < GUARDS and at:
        end = len(inner[:at].rstrip(b" \n"))
        if not end:
            break
        at = max(inner.rfind(b" ", 0, end), inner.rfind(b"\n", 0, end)) + 1
        right.append(at)
    right = right or [0]
    first, last = inner[: left[-1]], inner[right[-1] :]
    guards = [left[0], n(inner[: left[0]]), left[-1], n(first), len(inner) - right[0], n(inner[right[0] :]), len(last), n(last)]
    return _HEAD.pack(a, len(data) - z, *guards) + data[:a] + data[z:] + first + last + bpe.encode(inner.decode())


class Joiner:
    """Puts a document's chunks together; loose ends are re-encoded where they meet, until both sides agree."""

    def __init__(self, bpe: tokens.WordBpe) -> None:
        self.bpe, self.out, self.loose = bpe, [], b""
        self.left = [(b"", b""), (b"", b"")]  # the text and ids just before the loose end, with one part and with all

    def _join(self, right: list[tuple[bytes, bytes]]) -> None:
        for (a, before), (z, after) in zip(self.left, right, strict=True):
            found = self.bpe.plain((a + self.loose + z).decode())
            if len(found) >= len(before) + len(after) and found.startswith(before) and found.endswith(after):
                self.out.append(found[len(before) : len(found) - len(after)])
                return
        raise ValueError("the chunks at a join do not agree with its encoding")

    def add(self, chunk: bytes) -> None:
        head, tail, *sizes = _HEAD.unpack_from(chunk)
        at = _HEAD.size
        self.loose += chunk[at : at + head]
        if tail < 0:
            return
        text = at + head + tail
        first, last = chunk[text : text + sizes[2]], chunk[text + sizes[2] : text + sizes[2] + sizes[6]]
        ids = chunk[text + sizes[2] + sizes[6] :]
        self._join([(first[:b], ids[: 2 * n]) for b, n in (sizes[0:2], sizes[2:4])])
        self.out.append(ids)
        self.left = [(last[len(last) - b :], ids[len(ids) - 2 * n :]) for b, n in (sizes[4:6], sizes[6:8])]
        self.loose = chunk[at + head : text]

    def ids(self) -> np.ndarray:
        self._join([(b"", b""), (b"", b"")])
        return np.frombuffer(b"".join(self.out), "<u2")


def _codec(trained: bytes | None) -> tuple:
    """compress and decompress."""
    own = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    return zstandard.ZstdCompressor(level=LEVEL, **own).compress, zstandard.ZstdDecompressor(**own).decompress


def _dictionary(samples: list[bytes]) -> bytes | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return None


def _dictionaries(docs: DataFrame, path: str | None) -> tuple[bytes | None, bytes | None]:
    """For chunks' texts and for encoded chunks."""
    chunks: list[bytes] = []
    for (text,) in docs.select(F.substring(text_of(), 1, SAMPLE_CHARS)).limit(SAMPLE_DOCS).collect():
        data, at = text.encode(), 0
        for end in cuts(data):
            chunks.append(data[at:end])
            at = end
    bpe = tokens.WordBpe(path)
    return _dictionary(chunks), _dictionary([encode_chunk(bpe, c) for c in chunks])


def encode(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document; ids: also the ids and the decoded text."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"), F.monotonically_increasing_id().alias("uid"))
    for_text, for_ids = _dictionaries(docs, path)
    tasks = rows.rdd.getNumPartitions()
    hot, salts = max(1, HOT_ROWS // max(1, tasks)), max(SALTS, tasks // TASKS_A_SALT)
    sent = "key binary, salt int, uid long, doc_id long, pos int, z binary"
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, seen, (pack, _) = 1 + TaskContext.get().partitionId() % salts, {}, _codec(for_text)
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for doc_id, data, uid in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = 0
                for pos, end in enumerate(cuts(data)):
                    chunk = data[at:end]
                    key, at = xxhash.xxh3_128_digest(chunk), end
                    n = seen[key] = seen.get(key, 0) + 1
                    for to, v in zip(out, (key, salt if n > hot else 0, uid, doc_id if pos == 0 else None, pos, pack(chunk) if n in (1, hot + 1) else None), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["key", "salt", "uid", "doc_id", "pos", "z"])

    def encode_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last, made = tokens.shared(tokens.WordBpe, path), None, b""
        (_, unpack), (pack, _) = _codec(for_text), _codec(for_ids)
        for b in batches:
            out = []
            for key, salt, z in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), b.column("z").to_pylist(), strict=True):
                if (key, salt) != last:  # the text sorts before the bare references
                    last, made = (key, salt), pack(encode_chunk(bpe, unpack(z)))
                out.append(made)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("pos"), pa.array(out, pa.binary())], ["uid", "doc_id", "pos", "z"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, (_, unpack) = tokens.shared(tokens.WordBpe, path), _codec(for_ids)
        uid = doc = joiner = None

        def close(to: list[list]) -> None:
            found = joiner.ids()
            text = bpe.decode(found)
            row = [doc, len(found), hashlib.sha256(found.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
            for at, v in zip(to, row + [found.astype(np.int32), text] * ids, strict=True):
                at.append(v)

        def made(to: list[list]) -> pa.RecordBatch:
            t = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            return pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(to, t, strict=False)], names[: len(to)])

        for b in batches:
            out: list[list] = [[] for _ in range(4 + 2 * ids)]
            for u, d, z in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("z").to_pylist(), strict=True):
                if u != uid:  # the first chunk carries the id
                    if joiner:
                        close(out)
                    uid, doc, joiner = u, d, Joiner(bpe)
                joiner.add(unpack(z))
            yield made(out)
        if joiner:
            close(last := [[] for _ in range(4 + 2 * ids)])
            yield made(last)

    chunks = rows.mapInArrow(split, sent).repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("z").isNull())
    back = chunks.mapInArrow(encode_once, "uid long, doc_id long, pos int, z binary").repartition("uid").sortWithinPartitions("uid", "pos")
    return back.mapInArrow(join, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids)
