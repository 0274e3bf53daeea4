"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its sequence of lower-case words; its k-mers are runs of five words, told apart by how often they occurred before (occurrence labels). Each of
SKETCHES permutations samples the MINIMA smallest labelled k-mers and keeps them in the order of the text; that ordered sample is a bucket key, so texts meet
where they share k-mers in the same order. Two texts are near copies when aligning their k-mer sequences within a band matches L of a and b k-mers with
L / (a + b - L) >= 0.8 (the edit-sensitive form of the Jaccard similarity). Sketches are
kept by texts of more than SHORT k-mers: there a pair at 0.8 misses all buckets with a chance of (1 - 0.8 ** 5) ** 40 = 1e-7 for long texts and 4e-7 for the shortest, while one at 0.25 (a shared passage) meets with 4 %.
Texts of up to 1.25 SHORT k-mers meet without any chance (`prefix`): two similar texts share at least 0.8 n of the n k-mers of each, so in one order of all k-mers their first n - 0.8 n + 1 share one; each of these is a key.

Equal word sequences are one node (a 64-bit hash of 64-bit word hashes). First each node of a bucket is aligned with the bucket's smallest node, and links are joined to
components. Then every bucket that still holds several components is gone through in full (`finish`): its nodes are dealt into blocks of bounded size, and for each
pair of blocks one task counts the k-mers that each two texts share, exactly, by matrix products, and aligns those pairs of different components that share enough; a link found joins
the components at once, so pairs it settles need no alignment. So classes are the components of all similar pairs that share a bucket; no pair is left out, and a family of unlike edits costs the square of its size in numpy, not in rows.

Texts travel as 32-bit word hashes: a changed word passes for unchanged once in 4e9. Labels spread by neighbours' minima and pointer jumping at every size; every round is written in the
shared folder. Keys that hold a large share of all rows are joined by broadcast (`join_hot`).

Defined results: null texts are empty; texts without words are copies of each other; a text of fewer than five words is one k-mer; the smallest doc_id of a class names it and stays
(null ids sort last); very long texts are sketched permutation by permutation and take blocks of their own; repeated ids and rows are answered each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_hot, materialize, text_of

K, SIMILAR = 5, 0.8
SKETCHES, MINIMA = 40, 5
#: K-mers of texts that meet by prefixes alone.
SHORT = 40
#: Weight of a block of a bucket (a text weighs one and one more per HEAVY packed bytes), and rows of blocks that one task gets on average.
BLOCK, HEAVY, ROWS = 1024, 2048, 2048
#: K-mers of a matrix product, and pairs of texts that share one from which it takes part in products; the others are counted by pairs, so many at once.
COLUMNS, DENSE, PAIRS = 1024, 4096, 1 << 22
WORD = re.compile(r"\w+")
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_XOR = _RANDOM.integers(0, 1 << 64, SKETCHES, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, SKETCHES, np.uint64) | np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Word hashes that a worker remembers, and k-mers of a text up to which all permutations are taken at once.
MEMO, AT_ONCE = 300_000, 4096


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()


def words(text: str) -> np.ndarray:
    """A 64-bit hash per word."""
    return np.array([*map(_hashes.__getitem__, WORD.findall(text.lower()))], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def kmers(h: np.ndarray) -> np.ndarray:
    """A hash per run of K words; one for a shorter text, none for none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    h = h.astype(np.uint64)
    k, n = min(K, len(h)), max(1, len(h) - K + 1)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = _mixed(out * _STEP + h[i : i + n])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """With each k-mer's number of earlier occurrences mixed in."""
    order = np.argsort(s, kind="stable")
    r = s[order]
    new = np.concatenate([[True], r[1:] != r[:-1]])
    if new.all():
        return s
    at = np.arange(len(s))
    seen = np.empty(len(s), np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(seen > 0, _mixed(s + seen * _STEP), s)


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCHES bucket keys of a k-mer sequence."""
    x, few = labelled(s), min(MINIMA, len(s))
    if len(x) <= AT_ONCE:
        v = (x ^ _XOR[:, None]) * _TIMES[:, None]
        at = np.argpartition(v, few - 1, axis=1)[:, :few] if few < len(x) else np.tile(np.arange(few), (SKETCHES, 1))
    else:
        at = np.stack([np.argpartition((x ^ a) * b, few - 1)[:few] for a, b in zip(_XOR, _TIMES, strict=True)])
    at.sort(axis=1)  # as they stand in the text
    key = _mixed(_XOR.copy())
    for i in range(few):
        key = _mixed(key * _STEP + x[at[:, i]])
    return key.view(np.int64)


def prefix(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a k-mer sequence, of which any two similar ones share one: its smallest labelled k-mers."""
    most = len(s) - -(-len(s) * 4 // 5) + 1
    return _mixed(np.sort(labelled(s))[:most] * _STEP + _MIX).view(np.int64)


def keys_of(s: np.ndarray) -> np.ndarray:
    """All bucket keys: texts of up to SHORT k-mers meet those of up to 1.25 times as many by prefixes, longer ones each other by sketches."""
    found = [prefix(s)] if 4 * len(s) <= 5 * SHORT else []
    return np.concatenate([*found, sketch(s)]) if len(s) > SHORT else found[0]


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of a and b within |i - j| <= band, by big-integer bit rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    window, row = (1 << (2 * band + 1)) - 1, full
    for j, y in enumerate(b.tolist()):
        m = where.get(y, 0)
        if m:
            m &= window << (j - band) if j >= band else window >> (band - j)
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def needed(total: int | np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """Matches that make the ratio of two sequences of `total` k-mers together `least`."""
    return np.ceil(total * least / (1 + least) - 1e-9).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Of two word sequences."""
    return alike(kmers(a), kmers(b), least)


def alike(s: np.ndarray, t: np.ndarray, least: float = SIMILAR) -> bool:
    """Of two k-mer sequences."""
    if not len(s) or not len(t):
        return len(s) == len(t)
    total = len(s) + len(t)
    need = int(needed(total, least))
    if min(len(s), len(t)) < need:
        return False
    n = min(len(s), len(t))
    d = np.flatnonzero(s[:n] != t[:n])
    head = int(d[0]) if len(d) else n
    d = np.flatnonzero(s[::-1][: n - head] != t[::-1][: n - head])
    tail = int(d[0]) if len(d) else n - head
    x, y = s[head : len(s) - tail], t[head : len(t) - tail]
    if head + tail >= need:
        return True
    (u, cu), (v, cv) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    if head + tail + int(np.minimum(cu[i], cv[j]).sum()) < need:  # no order can match more
        return False
    return head + tail + aligned(x, y, total - 2 * need) >= need


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), node (a hash of the word sequence), and, with a node's first document in a task, its keys and packed words."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for b in batches:
            rows: list[list] = [[] for _ in kinds]
            for doc_id, text, row in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                h = words(text)
                node = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)
                keys = packed = None
                if node not in seen:
                    seen.add(node)
                    packed = pack(h.astype("<u4").tobytes())
                    keys = keys_of(kmers(h)) if len(h) else None
                for to, v in zip(rows, (doc_id, row, node, keys, packed), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], ["doc_id", "h", "node", "keys", "words"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("h"))
    return materialize(d.mapInArrow(run, "doc_id long, h long, node long, keys array<long>, words binary"), "sketches")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes that are similar."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, other = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            keep = []
            for b, wa, wb in zip(*(batch.column(c).to_pylist() for c in ("b", "wa", "wb")), strict=True):
                if b != last:  # pairs come in runs of one leader
                    last, other = b, kmers(np.frombuffer(unpack(wb), "<u4"))
                keep.append(alike(kmers(np.frombuffer(unpack(wa), "<u4")), other))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.mapInArrow(run, "a long, b long"), "links")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many labelled k-mers each text of `left` shares with each of `right`. K-mers of many pairs are counted by matrix products, the others pair by pair."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not out.size:
        return out
    n = sum(map(len, left))
    _, col = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    of = lambda some: np.repeat(np.arange(len(some)), [len(x) for x in some])
    (li, lc), (ri, rc) = (of(left), col[:n]), (of(right), col[n:])
    dl, dr = (np.bincount(c, minlength=int(col.max(initial=-1)) + 1) for c in (lc, rc))
    many = np.flatnonzero(dl * dr > DENSE)
    place = np.full(len(dl), -1)
    place[many] = np.arange(len(many))
    for at in range(0, len(many), COLUMNS):
        a, b = (np.zeros((len(x), COLUMNS), np.float32) for x in (left, right))
        for m, i, c in ((a, li, place[lc]), (b, ri, place[rc])):
            ok = (c >= at) & (c < at + COLUMNS)
            m[i[ok], c[ok] - at] = 1
        out += a @ b.T
    ok = (dl[lc] * dr[lc] <= DENSE) & (dr[lc] > 0)
    li, lc = li[ok], lc[ok]
    order = np.argsort(rc, kind="stable")
    ri, first = ri[order], np.cumsum(dr) - dr
    ends = np.cumsum(dr[lc])
    lo = 0
    while lo < len(lc):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        reps = dr[lc[lo:hi]]
        nth = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        pair = np.repeat(li[lo:hi], reps) * len(right) + ri[np.repeat(first[lc[lo:hi]], reps) + nth]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape)
        lo = hi
    return out


def joined(slot: np.ndarray, s: int, t: int, label: np.ndarray, texts: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (larger label, smaller label) that connect whatever components the similar pairs between the blocks s and t of a bucket connect."""
    left, right = np.flatnonzero(slot == s), np.flatnonzero(slot == t)
    if not len(left) or not len(right):
        return []
    grams = [*map(kmers, texts)]
    marked = [*map(labelled, grams)]
    n = np.array([len(x) for x in grams])
    need = needed(n[left][:, None] + n[right])
    fits = shared([marked[i] for i in left], [marked[j] for j in right]) >= need
    root, links = label.copy(), []
    for i, ok in zip(left, fits, strict=True):
        ok = right[ok]
        while len(ok := ok[root[ok] != root[i]]):
            j, ok = ok[0], ok[1:]
            if alike(grams[i], grams[j]):
                links.append((int(max(label[i], label[j])), int(min(label[i], label[j]))))
                root[root == root[j]] = root[i]
    return links


def finish(live: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of labels: `live` has the rows (key, node, label) of buckets with several labels."""
    rows = live.join(texts.select("node", "words", (1 + F.octet_length("words") / HEAVY).alias("weight")), "node")
    parts = materialize(rows.groupBy("key").agg(F.ceil(F.sum("weight") / BLOCK).cast("long").alias("parts")), "parts")
    rows = rows.join(parts, "key").withColumn("slot", F.pmod(F.xxhash64("node", F.lit("slot")), F.col("parts")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least(o, "slot").alias("s"), F.greatest(o, "slot").alias("t")))
    total = live.join(parts, "key").agg(F.sum("parts")).first()[0] or 0
    rows = rows.withColumn("at", F.explode(meets)).select("key", "at.s", "at.t", "slot", "label", "words")
    rows = rows.repartition(max(total // ROWS, live.sparkSession.sparkContext.defaultParallelism), "key", "s", "t").sortWithinPartitions("key", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, held = zstandard.ZstdDecompressor().decompress, None, []

        def close() -> pa.RecordBatch:
            slot, label = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            found = joined(slot, last[1], last[2], label, [np.frombuffer(unpack(r[2]), "<u4") for r in held])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *at, slot, label, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != last:
                    if held:
                        yield close()
                    last, held = at, []
                held.append((slot, label, packed))
        if held:
            yield close()

    return materialize(rows.mapInArrow(run, "a long, b long"), "joins")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for nodes with links (a, b): the smallest node that they reach."""
    both = materialize(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "both")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("low", "node").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("best"))
        own = labels.join(near, "node").select("node", F.least("label", "best").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        labels = materialize(own.join(jump, "new", "left").select("node", F.least("new", "far").alias("label"), "old"), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.drop("old")
        labels = labels.drop("old")


def _labelled_rows(docs: DataFrame) -> DataFrame:
    """doc_id, h, node and label (the smallest node of its class) per document."""
    found = sketches(docs)
    entries = found.where(F.col("keys").isNotNull()).select("node", F.explode("keys").alias("key"))
    ends = entries.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").drop("last")
    buckets = materialize(entries.join(ends, "key"), "buckets")
    texts = found.where(F.col("words").isNotNull()).select("node", "words").join(buckets.select("node").distinct(), "node", "left_semi")
    texts = materialize(texts.dropDuplicates(["node"]), "texts")
    pairs = materialize(buckets.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    labels = components(verify(pairs, texts))
    mine = buckets.select("key", "node").distinct().join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mine = materialize(mine, "mine")
    mixed = mine.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    more = components(finish(materialize(mine.join(mixed, "key", "left_semi"), "mixed"), texts))
    more = more.select(F.col("node").alias("first"), F.col("label").alias("final"))
    nodes = mine.select("node", F.col("label").alias("first")).distinct()
    label = F.coalesce("final", "first").alias("label")
    labels = materialize(nodes.join(more, "first", "left").select("node", label).where("label <> node"), "labels")  # what is left out names itself
    rows = found.select("doc_id", "h", "node")
    own = join_hot(rows, labels, "node", rows.groupBy("node").count())
    return materialize(own.select("doc_id", "h", "node", F.coalesce("label", "node").alias("label")), "own")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, class_size, kept per document."""
    own = _labelled_rows(docs)
    named = materialize(own.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    d = join_hot(own, named, "label", named.select("label", F.col("class_size").alias("count")))
    return d.select("doc_id", "node", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document of each class that stays, with all its columns; of a class's rows that repeat that id, one. Rows are told apart by id and text, so ids that repeat (or are null) in several classes stay once in each."""
    own_id, own_h, n, key = fresh(docs, "id", "h", "n", "key")
    own = _labelled_rows(docs).groupBy("label", F.col("doc_id").alias(own_id), F.col("h").alias(own_h)).agg(F.count("*").alias(n))
    first = F.min(F.struct(F.col(own_id).isNull().alias("none"), own_id, own_h, n)).alias("kept")  # null ids last
    kept = own.groupBy("label").agg(first).select(*[F.col(f"kept.{c}").alias(c) for c in (own_id, own_h, n)])
    rows = docs.withColumn(key, F.xxhash64(text_of()))
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept[own_id]) & (rows[key] == kept[own_h]))
    plain, again = rows.where(F.col(n) == 1), rows.where(F.col(n) > 1)
    return plain.unionByName(again.dropDuplicates([own_id, own_h])).select(*[rows[f"`{c}`"] for c in docs.columns])
