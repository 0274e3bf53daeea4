"""Alignment of two tokenizers over the same bytes, and how often their ids are linked.

A document is its text after a space, in UTF-8. Every byte gets a label: no token ends there, one of A, one of B, or one of both; a regular expression scans the labels for spans up to each "both", and
the labels counted in a span say how many tokens of A and of B its group has. Neither vocabulary joins a space to what stands before it, so a text's parts (from a space after a non-space to
the next) are aligned on their own, which makes a memo of parts exact; whether the vocabulary of B allows it is looked up when it is loaded, else texts are one part.

Links are all pairs of one A and one B token of a group; they are counted by ids, with multiplicity, never listed one by one. Each task gathers documents in blocks of bounded size and writes per block: results of
documents, the block's distinct id pairs with the number of its documents that hold them, and each document's links as numbers of those pairs. Spark adds the pairs up over the corpus, finds the highest count of each A id, and
sends each block the counts of its own pairs, one row a block.

Defined results: null and empty texts, and those whose tokens' bytes differ from the document's (B knows U+2581 as a space), have no tokens: zeros and no groups; rows that repeat are documents each; null ids stay null;
very long texts are aligned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, text_of

PIECES = "piece_bpe_32k.model"
#: A block ends when its documents have so many bytes, or so many links of distinct ids.
BLOCK_BYTES, BLOCK_LINKS = 8 << 20, 2 << 20
#: Parts that a memo holds at most, and the longest part that it holds.
MEMO_PARTS, MEMO_CHARS = 400_000, 40
#: The labels of a byte: none, A ends, B ends, both; and a span of them.
LABELS, SPAN = np.frombuffer(b".AB#", np.uint8), re.compile(rb"[^#]*#")
PART, ODD = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
GROUP = "array<struct<end:long,a:array<int>,b:array<int>>>"


class PlainByteBpe(tokens.ByteBpe):
    """Strings of special tokens are plain text."""

    def __init__(self, path: str | None = None, ranks: str | None = None) -> None:
        super().__init__(path, ranks)
        self.library.encode_special_tokens = True

    def plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids if len(text) > 1000 else self.fast.encode_ordinary(text)


#: What a memo holds of a part: its groups as text, its links' codes (A id << 16 | B id) and how often each code counts, as 64-bit integers; tokens of A and of B, groups.
Part = tuple[str, bytes, bytes, int, int, int]
ONE = np.array([1], "<i8").tobytes()


def links(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Codes of a group's links and how often each counts; large groups by ids, not by occurrences."""
    if len(a) * len(b) <= 64:
        codes = [x << 16 | y for x in a for y in b]
        return codes, [1] * len(codes)
    (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (a, b))
    return (x[:, None] << 16 | y).ravel().tolist(), (n[:, None] * m).ravel().tolist()


class Aligner:
    def __init__(self, path: str | None = None, ranks: str | None = None, pieces: str | None = None) -> None:
        import sentencepiece

        self.bpe = PlainByteBpe(path, ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path(PIECES))
        self.a_bytes = [self._a_bytes(i) for i in range(self.bpe.library.get_vocab_size())]
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        self.a_lens, self.b_lens = self.a_len.tolist(), self.b_len.tolist()
        self.a_name, self.b_name = [f"{i}" for i in range(len(self.a_bytes))], [f"|{i}" for i in range(len(names))]
        self.space = self.model.piece_to_id("▁")
        self.by_parts = not any("▁" in p.lstrip("▁") for p in names)
        self.known: dict[str, Part | None] = {}

    def _a_bytes(self, i: int) -> bytes:
        try:
            return self.bpe.fast.decode_single_token_bytes(i)
        except KeyError:  # special tokens, which plain texts never have
            return self.bpe.library.id_to_token(i).encode()

    def parts(self, text: str) -> list[str]:
        """The parts of a document, each without the space that it begins with."""
        if not self.by_parts:
            return [text]
        if not text.startswith(" ") and not ODD.search(text):
            return text.split(" ")
        return [p[1:] for p in PART.split(" " + text)]

    def align(self, parts: list[str]) -> list[Part | None]:
        """None for a part whose tokens do not give its bytes."""
        out: list[Part | None] = [None] * len(parts)
        if not parts:
            return out
        of_a, of_b = [self.bpe.plain(" " + p) for p in parts], [b if p else [self.space] for p, b in zip(parts, self.model.encode(parts, num_threads=1), strict=True)]
        sizes = [[sum([len_of[x] for x in ids]) for ids in of] for of, len_of in ((of_a, self.a_lens), (of_b, self.b_lens))]
        good = range(len(parts))
        a_ids, b_ids = (list(chain.from_iterable(of)) for of in (of_a, of_b))
        if sizes[0] != sizes[1] or not (b"".join([self.a_bytes[x] for x in a_ids]) == b"".join([self.b_bytes[x] for x in b_ids]) == (" " + " ".join(parts)).encode()):
            good = [i for i, p in enumerate(parts) if b"".join([self.a_bytes[x] for x in of_a[i]]) == b"".join([self.b_bytes[x] for x in of_b[i]]) == (" " + p).encode()]
            a_ids, b_ids = (list(chain.from_iterable(of[i] for i in good)) for of in (of_a, of_b))
        if not good:
            return out
        ends = np.cumsum([sizes[0][i] for i in good])
        labels = np.zeros(ends[-1], np.uint8)
        labels[np.cumsum(self.a_len[a_ids]) - 1] |= 1
        labels[np.cumsum(self.b_len[b_ids]) - 1] |= 2
        spans = np.fromiter((m.end() for m in SPAN.finditer(LABELS[labels].tobytes())), np.int64)
        to_a, to_b = (np.cumsum(labels & bit > 0)[spans - 1] for bit in (1, 2))  # labels up to each span's end
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        # groups of one token each at once, the others one by one
        codes = np.array(a_ids)[to_a - 1] << 16 | np.array(b_ids)[to_b - 1]
        written = [x + y for x, y in zip(map(self.a_name.__getitem__, (codes >> 16).tolist()), map(self.b_name.__getitem__, (codes & 0xFFFF).tolist()), strict=True)]
        more = {}
        for g in np.flatnonzero((n_a > 1) | (n_b > 1)).tolist():
            a, b = a_ids[to_a[g] - n_a[g] : to_a[g]], b_ids[to_b[g] - n_b[g] : to_b[g]]
            written[g] = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
            more[g] = links(a, b)
        raw, single = codes.astype("<i8").tobytes(), np.cumsum(np.r_[0, (n_a > 1) | (n_b > 1)]).tolist()
        last = (np.searchsorted(spans, ends) + 1).tolist()  # a part ends with a span
        to_a, to_b = ([0, *x.tolist()] for x in (to_a, to_b))
        for i, lo, hi in zip(good, [0, *last], last, strict=False):
            if single[lo] == single[hi]:
                mine, often = raw[8 * lo : 8 * hi], ONE * (hi - lo)
            else:
                of = [more.get(g) or ([int(codes[g])], [1]) for g in range(lo, hi)]
                mine, often = (array("q", [x for v in of for x in v[k]]).tobytes() for k in (0, 1))
            out[i] = ";".join(written[lo:hi]), mine, often, to_a[hi] - to_a[lo], to_b[hi] - to_b[lo], hi - lo
        return out

    def documents(self, texts: list[str]) -> list[list[Part] | None]:
        """Parts of each text; None: no tokens."""
        cut = [self.parts(t) if t else [] for t in texts]
        long: dict[str, Part | None] = {}
        new = [p for p in dict.fromkeys(p for c in cut for p in c) if p not in self.known]
        if len(self.known) > MEMO_PARTS:  # the first seen are the commonest
            kept, needed = dict(islice(self.known.items(), MEMO_PARTS // 2)), {p for c in cut for p in c}
            kept.update((p, v) for p, v in self.known.items() if p in needed)
            self.known = kept
        for i in range(0, len(new), 10_000):
            for p, v in zip(new[i : i + 10_000], self.align(new[i : i + 10_000]), strict=True):
                (self.known if len(p) <= MEMO_CHARS else long)[p] = v
        get = self.known.get
        out: list[list[Part] | None] = []
        for c in cut:
            found = [long[p] if p in long else get(p) for p in c] if long else [*map(get, c)]
            out.append(None if not found or None in found else found)
        return out


def groups(docs: DataFrame, *paths: str) -> DataFrame:
    """doc_id and the groups of each document in order: end (bytes of the document up to it) and the ids of A and B."""
    kind = pa.list_(pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = tokens.shared(Aligner, *paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                some, rows = batch.slice(at, 50), []
                for parts in aligner.documents(some.column("text").to_pylist()):
                    row, end = [], 0
                    for written in ";".join([p[0] for p in parts or []]).split(";") if parts else []:
                        a, b = ([*map(int, x.split(","))] for x in written.split("|"))
                        end += int(aligner.a_len[a].sum())
                        row.append({"end": end, "a": a, "b": b})
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(rows, kind)], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, f"doc_id long, groups {GROUP}")


DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_codes array<int>, nth binary, often binary, pairs array<long>, n_docs array<int>"


def blocks(docs: DataFrame, *paths: str, block_bytes: int = BLOCK_BYTES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """A row per block, as written in the shared folder: arrays over its documents, its distinct pairs with their numbers of documents, and each document's links (nth: numbers of pairs, often: how many)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = tokens.shared(Aligner, *paths), TaskContext.get().partitionId() << 32
        docs_held: list[tuple] = []
        codes_held: list[np.ndarray] = []
        often_held: list[np.ndarray] = []
        held = [0, 0]

        def flush() -> pa.RecordBatch:
            nonlocal block
            codes, often = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (codes_held, often_held))
            pairs, nth = np.unique(codes, return_inverse=True)
            kinds = [pa.int64()] * 5 + [pa.string(), pa.int32()]
            cols = [[block], *([pa.array(v, t)] for v, t in zip(zip(*docs_held, strict=True), kinds, strict=True)), [nth.astype("<i4").tobytes()], [often.astype("<i8").tobytes()], [pairs], [np.bincount(nth, minlength=len(pairs)).astype(np.int32)]]
            types = [pa.int64(), *map(pa.list_, kinds), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = [x.split()[0] for x in BLOCK.split(", ")]
            arrays = [pa.array(v, t) if not isinstance(v[0], pa.Array) else pa.ListArray.from_arrays([0, len(v[0])], v[0]) for v, t in zip(cols, types, strict=True)]
            block += 1
            for v in (docs_held, codes_held, often_held):
                v.clear()
            held[:] = [0, 0]
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for at in range(0, b.num_rows, 100):
                ids, texts = (b.column(c).slice(at, 100).to_pylist() for c in ("doc_id", "text"))
                for doc_id, text, parts in zip(ids, texts, aligner.documents(texts), strict=True):
                    if parts is None:
                        docs_held.append((doc_id, 0, 0, 0, 0, "", 0))
                    else:
                        codes, back = np.unique(np.frombuffer(b"".join([p[1] for p in parts]), "<i8"), return_inverse=True)
                        often = np.zeros(len(codes), np.int64)
                        np.add.at(often, back, np.frombuffer(b"".join([p[2] for p in parts]), "<i8"))
                        digest = hashlib.sha256(";".join([p[0] for p in parts]).encode()).hexdigest()
                        docs_held.append((doc_id, *(sum([p[k] for p in parts]) for k in (3, 4, 5)), int(often.sum()), digest, len(codes)))
                        codes_held.append(codes)
                        often_held.append(often)
                        held[0] += len(text)
                        held[1] += len(codes)
                    if held[0] >= block_bytes or held[1] >= block_links or len(docs_held) >= 100_000:
                        yield flush()
        if docs_held:
            yield flush()

    return materialize(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, BLOCK), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b and n_docs: the number of documents that hold the pair linked; best: no pair of its A id has more."""
    each = found.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n_docs")).select(F.expr("cast(pair >> 16 as int)").alias("a"), F.expr("cast(pair & 65535 as int)").alias("b"), "n_docs")
    counts = materialize(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row per id of A's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def score(docs: DataFrame, *paths: str, block_bytes: int = BLOCK_BYTES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, groups_sha256 (of `a1,a2|b1;...`), n_best (links of best pairs) and count_sum (the pairs' counts over all links)."""
    found = blocks(docs, *paths, block_bytes=block_bytes, block_links=block_links)
    counts = pair_counts(found).select(F.expr("cast(a as long) << 16 | b").alias("pair"), "n_docs", "best")
    asked = found.select("block", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "n_docs", "best"))).alias("known"))
    answers = answers.select("block", F.col("known.n_docs").alias("count"), F.col("known.best").alias("best"))
    rows = found.drop("pairs", "n_docs").join(answers, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = {c: b.column(c)[k] for c in b.schema.names}
                nth, often = np.frombuffer(one["nth"].as_py(), "<i4"), np.frombuffer(one["often"].as_py(), "<i8")
                of = np.repeat(np.arange(len(one["n_codes"])), one["n_codes"].values.to_numpy())
                sums = np.zeros((2, len(one["n_codes"])), np.int64)
                if len(nth):
                    np.add.at(sums[0], of, often * one["best"].values.to_numpy(zero_copy_only=False)[nth])
                    np.add.at(sums[1], of, often * one["count"].values.to_numpy()[nth])
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
                yield pa.RecordBatch.from_arrays([*(one[c].values for c in names), pa.array(sums[0]), pa.array(sums[1])], [*names, "n_best", "count_sum"])

    return rows.mapInArrow(run, f"{DOC}, n_best long, count_sum long")
