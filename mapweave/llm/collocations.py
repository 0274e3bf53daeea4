"""Phrases of two to four words that occur more often together than their parts suggest, per language.

Words are counted first; those below LEAST are gone for good, since no phrase that holds one can be a candidate. The corpus is written once as sequences of word numbers with gaps where a word is rare or a
piece ends. From then on all lengths go alike: neighbours in the sequences (two overlapping frequent phrases, so that every part of a candidate is frequent) are counted by hash first, and only those whose
hash bucket reaches LEAST can be candidates, which loses none; a minimal perfect hash in shards is built over the distinct ones, its slots holding the keys; tasks look their sequences up, count slots with bincount into one array a shard, and the arrays are added up in a tree. A phrase's number is
its slot, a key is the two numbers of the overlapping shorter phrases, so keys are exact and the phrases that candidates are cut into are read by number. Then each sequence of frequent phrases is written for the next length.

Shards have about SHARD_KEYS keys, and a task holds tables of TABLE_BYTES at a time, so memory does not grow with the corpus; a corpus with more tables than that reads them again for every READ_IDS numbers. Buckets number a quarter of all words,
up to MOST_BUCKETS (a bitmap of 64 MB); beyond that more candidates pass that turn out rare.

Defined results: null texts are empty, null languages are `und`; a piece's words are counted whole however long the text; repeated rows count each; ties are ordered by the phrase's bytes; an empty table gives no rows; other columns are
ignored. More than 4 billion candidates of one length are an error.
"""

from __future__ import annotations

import string
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, remove, text_of, work_dir
from .perfect_hash import PerfectHash, hashed, shard_of

LONGEST, LEAST, TOP, UNKNOWN = 4, 30, 2000, "und"
#: A phrase goes if a longer candidate around it has so many hundredths of its count.
COVERED = 80
SHARD_KEYS, TABLE_BYTES = 1 << 20, 128 << 20
#: Words of the corpus for each candidate that a shard is made for: there are usually fewer.
WORDS_A_KEY = 16
#: Bytes of text that are split at a time; entries of a task's counter or memo of words; numbers that a task looks up at a time; distinct keys that it holds.
SPLIT_BYTES, WORDS_HELD, READ_IDS, KEYS_HELD = 1 << 20, 300_000, 1 << 20, 2 << 20
#: Arrays that one task adds up; buckets of a shard of hashed counts, and of all shards at most.
FAN, BUCKETS, MOST_BUCKETS = 32, 1 << 20, 1 << 29
NONE, BY_BUCKET = 0xFFFFFFFF, 77
#: The marks that end a piece. All become dots, which no word holds; capitals A-Z become small, tabs spaces.
BREAKS = ".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans((BREAKS + "\t" + string.ascii_uppercase).encode(), ("." * len(BREAKS) + " " + string.ascii_lowercase).encode())


def split(texts: list[str]) -> Iterator[list[bytes]]:
    """The words of texts in order, b"." where a piece ends, in lists of a bounded number of bytes (a longer word is one list)."""
    data = b".".join([t.encode() for t in texts]).translate(TABLE)
    at = 0
    while at < len(data):
        end = at + SPLIT_BYTES
        if end < len(data):
            stops = [x for x in (data.find(b" ", end), data.find(b".", end)) if x >= 0]
            end = min(stops, default=len(data))
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def _by_lang(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[str, list[str]]]:
    for at in range(0, batch.num_rows, rows):
        found = defaultdict(list)
        for lang, text in zip(*(batch.column(c).slice(at, rows).to_pylist() for c in ("lang", "text")), strict=True):
            found[lang].append(text)
        yield from found.items()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n; a null word has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        total: Counter = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([w.decode() for w in c], pa.string()), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for b in batches:
            for lang, texts in _by_lang(b):
                for words in split(texts):
                    c = counts[lang]
                    c.update(words)
                    total[lang] += len(words) - c.pop(b".", 0)
                    if sum(map(len, counts.values())) > WORDS_HELD:
                        yield from rows()
        yield from rows()
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([None] * len(total), pa.string()), pa.array(total.values(), pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# ---- tables: shards of perfect hashes, their keys and counts, in files of their own ----


def _pack_words(keys: list[bytes]) -> bytes:
    return np.array([len(k) for k in keys], "<u4").tobytes() + b"".join(keys)


def _unpack_words(data: bytes, n: int) -> list[bytes]:
    ends = (4 * n + np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 * n, *ends], ends, strict=False)]


class Table:
    """Numbers of keys: shard * stride + slot. Shards are read when needed; those used last stay, up to TABLE_BYTES."""

    def __init__(self, root: str, counts: str, shards: int, stride: int, words: bool, least: int) -> None:
        self.root, self.counts, self.shards, self.stride, self.words, self.least = root, counts, shards, stride, words, least
        self.held: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = 0

    @staticmethod
    def _row(root: str, shard: int) -> dict | None:
        store, top = pafs.FileSystem.from_uri(f"{root}/shard={shard}")
        found = [f.path for f in store.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if f.base_name.endswith(".parquet")]
        rows = [r for path in found for r in pq.ParquetFile(store.open_input_file(path)).read().to_pylist()]
        return rows[0] if rows else None

    def shard(self, s: int) -> tuple[PerfectHash, np.ndarray] | None:
        """The hash and the counts by slot (those before counting: empty); None: no key fell into the shard."""
        if s in self.held:
            self.held.move_to_end(s)
            return self.held[s][0]
        row = self._row(self.root, s)
        if row is None:
            return None
        keys = _unpack_words(row["keys"], row["n"]) if self.words else np.frombuffer(row["keys"], "<i8")
        n = self._row(self.counts, s) if self.counts else None
        found = PerfectHash.load(row["hash"], keys), np.frombuffer(n["counts"], "<i8") if n else np.zeros(0, np.int64)
        size = 40 * row["n"] + (4 * len(row["keys"]) if self.words else 0)
        self.held[s] = found, size
        self.bytes += size
        while self.bytes > TABLE_BYTES and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1][1]
        return found

    def slots(self, keys) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By shard: where its keys are among `keys`, their slots (-1: none) and the counts by slot."""
        shard = shard_of(keys, self.shards)
        order = np.argsort(shard, kind="stable")
        which, first = np.unique(shard[order], return_index=True)
        for s, at in zip(which.tolist(), np.split(order, first[1:]), strict=False):
            if (found := self.shard(s)) is not None:
                yield s, at, found[0].find(keys[at] if isinstance(keys, np.ndarray) else [keys[i] for i in at.tolist()]), found[1]

    def find(self, keys) -> np.ndarray:
        """Numbers of keys; NONE for those that are not here or have a count below `least`."""
        out = np.full(len(keys), NONE, np.uint32)
        for s, at, slot, counts in self.slots(keys) if len(keys) else ():
            good = slot >= 0
            if len(counts):
                good &= counts[slot] >= self.least
            out[at[good]] = s * self.stride + slot[good]
        return out


_open: list = []


def _table(*args) -> Table:
    """The worker's open table: it outlives a task, until another is asked for."""
    if not _open or _open[0] != args:
        _open[:] = [args, Table(*args)]
    return _open[1]


def _shard_row(shard: int, made: PerfectHash, raw: bytes, counts: bytes) -> dict:
    return {"shard": pa.array([shard], pa.int64()), "n": pa.array([len(made.keys)], pa.int64()), "hash": pa.array([made.dump()], pa.binary()), "keys": pa.array([raw], pa.binary()), "counts": pa.array([counts], pa.binary())}


SHARD = "shard long, n long, hash binary, keys binary, counts binary"


def _shards_written(rows: DataFrame) -> tuple[str, int]:
    """Writes shards in files of their own; returns where, and how many numbers a shard has at most."""
    root = work_dir(rows.sparkSession, "phrases")
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(root)
    stride = rows.sparkSession.read.schema("n long").parquet(root).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return root, max(1, stride)


def _numbers_fit(shards: int, stride: int) -> None:
    if shards * stride > NONE:
        raise ValueError("more candidates than 32-bit numbers")


def word_table(keys: DataFrame, n: int, shard_keys: int) -> tuple[str, int, int]:
    """The perfect hash over n words (key, n) with their counts: root, shards and stride."""
    shards = max(1, -(-n // shard_keys))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column("key").to_pylist(), shards), pa.int64()), *b.columns], ["shard", *b.schema.names])

    def build(t: pa.Table) -> pa.Table:
        mine = t.column("key").to_pylist()
        made, counts = PerfectHash.of(mine), np.zeros(len(mine), "<i8")
        counts[made.find(mine)] = t.column("n").to_numpy()
        return pa.table(_shard_row(t.column("shard")[0].as_py(), made, _pack_words(made.keys), counts.tobytes()))

    root, stride = _shards_written(keys.mapInArrow(deal, "shard long, key binary, n long").groupBy("shard").applyInArrow(build, SHARD))
    _numbers_fit(shards, stride)
    return root, shards, stride


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=0).astype("<i8").tobytes())


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8"))


def candidate_table(found: DataFrame, tasks: int, shards: int) -> tuple[str, int, int]:
    """The perfect hash over the distinct keys that tasks found (shard, task, counts: their keys): root, shards and stride. Keys of a shard are united in a tree."""

    def unite(blobs: Iterator[bytes]) -> bytes:
        return _pack_keys(np.unique(np.concatenate([_unpack_keys(raw) for raw in blobs])))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw in zip(b.column("shard").to_pylist(), b.column("counts").to_pylist(), strict=True):
                made = PerfectHash.of(_unpack_keys(raw))
                row = _shard_row(shard, made, made.keys.astype("<i8").tobytes(), b"")
                yield pa.RecordBatch.from_arrays([*row.values()], [*row])

    root, stride = _shards_written(_tree(found, tasks, unite).mapInArrow(build, SHARD))
    _numbers_fit(shards, stride)
    return root, shards, stride


# ---- sequences of numbers ----


def _closed(ids: np.ndarray) -> np.ndarray:
    """Without gaps at the ends and with one gap for several; without numbers that have no neighbour."""
    known = ids != NONE
    beside = np.zeros(len(ids), bool)
    beside[1:] |= known[:-1]
    beside[:-1] |= known[1:]
    ids = ids[known & beside | ~known]
    gap = ids == NONE
    return ids[~gap | np.r_[False, ~gap[:-1]]]


def _numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sequences of a batch, READ_IDS at least at a time but for the last, gaps between rows."""
    held, n = [], 0
    for raw in batch.column("ids"):
        held += [np.frombuffer(raw.as_buffer(), "<u4"), np.array([NONE], "<u4")]
        n += len(held[-2])
        if n >= READ_IDS:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where neighbours both have a number, and their keys."""
    at = np.flatnonzero((ids[:-1] != NONE) & (ids[1:] != NONE))
    return at, (ids[at].astype(np.uint64) << np.uint64(32) | ids[at + 1]).astype(np.int64)


def _rows(ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(ids := _closed(ids)):
        yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["ids"])


def _write(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    path = work_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, table: tuple) -> DataFrame:
    """The corpus as sequences of word numbers: rows of 32-bit integers, NONE at gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        words_of = _table(*table)
        for b in batches:
            for lang, texts in _by_lang(b):
                if sum(map(len, known.values())) > WORDS_HELD:
                    known.clear()
                memo, out = known[lang], []
                for words in split(texts):
                    if new := [w for w in set(words) if w not in memo]:
                        memo.update(zip(new, words_of.find([w + b" " + lang.encode() for w in new]).tolist(), strict=True))
                    out.append(np.fromiter(map(memo.__getitem__, words), np.uint32, len(words)))
                if out:
                    yield from _rows(np.concatenate(out))

    return docs.mapInArrow(run, "ids binary")


def _merged(keys: list[np.ndarray], counts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts, no more than `least`."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.minimum(np.bincount(at, np.concatenate(counts), len(found)), least).astype(np.uint8)


def _sparse(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys below BUCKETS with counts below 256."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=0).astype("<u4").tobytes() + counts.tobytes())


def _dense(total: np.ndarray, raw: bytes) -> None:
    """Adds what _sparse packed."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = len(data) // 5
    total[np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64)] += np.frombuffer(data, np.uint8, n, 4 * n)


SUMS = "shard long, task long, counts binary"


def _sum_rows(shard: list[int], task: list[int], counts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(task, pa.int64()), pa.array(counts, pa.binary())], ["shard", "task", "counts"])


def _tree(sums: DataFrame, tasks: int, add) -> DataFrame:
    """Arrays of tasks added up by shard, FAN at a time."""

    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_sum_rows([t.column("shard")[0].as_py()], [t.column("task")[0].as_py() // FAN], [add(x.as_py() for x in t.column("counts"))])])

    while True:
        sums = sums.groupBy("shard", F.expr(f"task div {FAN}").alias("of")).applyInArrow(run, SUMS)
        if tasks <= FAN:
            return sums
        tasks = -(-tasks // FAN)


def buckets(sequences: DataFrame, n: int, least: int) -> tuple[str, int]:
    """Counts neighbours by hash; writes which buckets reach `least` and returns where, and the number of buckets (n: about how many neighbours there are)."""
    size = BUCKETS
    while size < min(n // 4, MOST_BUCKETS):
        size *= 2
    most = min(least, 255)  # counts are kept up to what matters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, task = [], [], TaskContext.get().partitionId()

        def rows() -> Iterator[pa.RecordBatch]:
            found, n = _merged(keys, counts, most)
            shard = found // BUCKETS
            which, first = np.unique(shard, return_index=True)
            for s, k, c in zip(which.tolist(), np.split(found, first[1:]), np.split(n, first[1:]), strict=False):
                yield _sum_rows([s], [task], [_sparse(k - s * BUCKETS, c)])
            keys.clear()
            counts.clear()

        for b in batches:
            for ids in _numbers(b):
                k, c = np.unique(hashed(_pairs(ids)[1], BY_BUCKET) & np.uint64(size - 1), return_counts=True)
                keys.append(k.astype(np.int64))
                counts.append(np.minimum(c, most))
                if sum(map(len, keys)) > KEYS_HELD:
                    k, c = _merged(keys, counts, most)
                    keys[:], counts[:] = [k], [c]
                    if len(k) > KEYS_HELD // 2:
                        yield from rows()
        if keys:
            yield from rows()

    def add(blobs: Iterator[bytes]) -> bytes:
        total = np.zeros(BUCKETS, np.int64)
        for raw in blobs:
            _dense(total, raw)
        at = np.flatnonzero(total)
        return _sparse(at, np.minimum(total[at], most).astype(np.uint8))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column("counts").to_pylist():
                total = np.zeros(BUCKETS, np.int64)
                _dense(total, raw)
                out.append(np.packbits(total >= most, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(out, pa.binary())], ["shard", "bits"])

    root = work_dir(sequences.sparkSession, "buckets")
    _tree(sequences.mapInArrow(run, SUMS), sequences.rdd.getNumPartitions(), add).mapInArrow(bits, "shard long, bits binary").write.parquet(root)
    return root, size


def _bits(root: str, size: int) -> np.ndarray:
    store, top = pafs.FileSystem.from_uri(root)
    out = np.zeros(size // 8, np.uint8)
    for f in store.get_file_info(pafs.FileSelector(top)):
        if f.base_name.endswith(".parquet"):
            for b in pq.ParquetFile(store.open_input_file(f.path)).iter_batches(100):
                for s, bits in zip(*(b.column(c).to_pylist() for c in ("shard", "bits")), strict=True):
                    out[s * BUCKETS // 8 : (s + 1) * BUCKETS // 8] = np.frombuffer(bits, np.uint8)
    return out


def candidates(sequences: DataFrame, root: str, size: int, shards: int) -> DataFrame:
    """The keys of neighbours whose bucket is full enough, as arrays of distinct ones by task and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n, task = _bits(root, size), [], 0, TaskContext.get().partitionId()

        def rows(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            shard = shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            which, first = np.unique(shard[order], return_index=True)
            for s, mine in zip(which.tolist(), np.split(keys[order], first[1:]), strict=False):
                yield _sum_rows([s], [task], [_pack_keys(mine)])

        for b in batches:
            for ids in _numbers(b):
                keys = _pairs(ids)[1]
                at = (hashed(keys, BY_BUCKET) & np.uint64(size - 1)).astype(np.int64)
                held.append(np.unique(keys[bits[at >> 3] >> (at & 7) & 1 > 0]))
                n += len(held[-1])
                if n > KEYS_HELD:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
                    if n > KEYS_HELD // 2:
                        yield from rows(held[0])
                        held, n = [], 0
        if held:
            yield from rows(np.unique(np.concatenate(held)))

    return sequences.mapInArrow(run, SUMS)


def counted(sequences: DataFrame, table: tuple) -> DataFrame:
    """shard and its counts by slot: arrays of tasks, added up FAN at a time."""
    pack = lambda x: zstandard.ZstdCompressor(level=1).compress(x.astype("<i8").tobytes())
    unpack = lambda x: np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_table, task, sums = _table(*table), TaskContext.get().partitionId(), OrderedDict()
        for b in batches:
            for ids in _numbers(b):
                for s, _, slot, _ in open_table.slots(_pairs(ids)[1]):
                    found = np.bincount(slot[slot >= 0], minlength=len(open_table.shard(s)[0].keys))
                    if s in sums:
                        sums[s] += found
                    else:
                        sums[s] = found
                    if sum(map(len, sums.values())) * 8 > TABLE_BYTES:  # the array held longest goes out early
                        old, values = sums.popitem(last=False)
                        yield _sum_rows([old], [task], [pack(values)])
        for s, values in sums.items():
            yield _sum_rows([s], [task], [pack(values)])

    def add(blobs: Iterator[bytes]) -> bytes:
        total = unpack(next(blobs)).copy()
        for raw in blobs:
            total += unpack(raw)
        return pack(total)

    sums = _tree(sequences.mapInArrow(run, SUMS), sequences.rdd.getNumPartitions(), add)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array([unpack(x.as_py()).tobytes() for x in b.column("counts")], pa.binary())], ["shard", "counts"])

    return sums.mapInArrow(plain, "shard long, counts binary")


def longer(sequences: DataFrame, table: tuple) -> DataFrame:
    """The sequences of the frequent phrases that neighbours make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_table = _table(*table)
        for b in batches:
            for ids in _numbers(b):
                at, keys = _pairs(ids)
                out = np.full(len(ids), NONE, np.uint32)
                out[at] = open_table.find(keys)
                yield from _rows(out)

    return sequences.mapInArrow(run, "ids binary")


def _frequent(spark: SparkSession, table: tuple) -> DataFrame:
    """id, a and the keys of a table's frequent entries: key (words) or left and right."""
    shards, stride, words, least = table[2:6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_table = Table(*table)
        for b in batches:
            for s in b.column("id").to_pylist():
                if (found := open_table.shard(s)) is None:
                    continue
                at = np.flatnonzero(found[1] >= least)
                for i in range(0, len(at), 100_000):
                    some = at[i : i + 100_000]
                    ids, a = pa.array(some + s * stride, pa.int64()), pa.array(found[1][some])
                    if words:
                        yield pa.RecordBatch.from_arrays([ids, a, pa.array([found[0].keys[k] for k in some.tolist()], pa.binary())], ["id", "a", "key"])
                    else:
                        key = found[0].keys[some].astype(np.uint64)
                        left, right = (pa.array(x.astype(np.int64)) for x in (key >> np.uint64(32), key & np.uint64(NONE)))
                        yield pa.RecordBatch.from_arrays([ids, a, left, right], ["id", "a", "left", "right"])

    return spark.range(0, shards, 1, shards).mapInArrow(run, "id long, a long, key binary" if words else "id long, a long, left long, right long")


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, DataFrame]:
    """All candidates: lang, phrase, size, a, heads and tails (counts of its first and last 1, 2 .. words, itself last), covered (the highest count of a longer candidate around it, or null); and the languages with n."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of().alias("text"))
    words = materialize(word_counts(rows).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = words.where("word is null").select("lang", "n")
    words_in_all = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = words.where("word is not null")
    key = F.concat(F.col("word").cast("binary"), F.lit(b" "), F.col("lang").cast("binary")).alias("key")
    root, shards, stride = word_table(frequent.select(key, "n"), frequent.count(), shard_keys)
    table = (root, root, shards, stride, True, least)
    text = F.col("key").cast("string")
    level = _frequent(spark, table).select("id", F.expr("substring(cast(key as string), instr(cast(key as string), ' ') + 1)").alias("lang"), F.substring_index(text, " ", 1).alias("phrase"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
    path, sequences = _write(numbered(rows, table), "sequences")
    found = []
    for size in range(2, longest + 1):
        shards, tasks = max(1, words_in_all // (WORDS_A_KEY * shard_keys)), sequences.rdd.getNumPartitions()
        root, shards, stride = candidate_table(candidates(sequences, *buckets(sequences, words_in_all, least), shards), tasks, shards)
        sums = work_dir(spark, "sums")
        counted(sequences, (root, "", shards, stride, False, least)).write.partitionBy("shard").parquet(sums)
        table = (root, sums, shards, stride, False, least)
        grams = _frequent(spark, table)
        left, right = (level.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lang", "phrase", "heads", "tails")]) for side in ("left", "right"))
        last = F.substring_index("right_phrase", " ", -1)
        made = grams.join(left, "left").join(right, "right").select("id", "left", "right", F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_phrase", last).alias("phrase"), "a", F.concat("left_heads", F.array("a")).alias("heads"), F.concat("right_tails", F.array("a")).alias("tails"))
        made = materialize(made, "made")
        if size > 2:
            around = made.select(F.col("left").alias("id"), "a").unionByName(made.select(F.col("right").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("covered"))
            found[-1] = found[-1].drop("covered").join(around, "id", "left")
        found.append(made.withColumns({"size": F.lit(size), "covered": F.lit(None).cast("long")}))
        level = made
        if size < longest:
            old = path
            path, sequences = _write(longer(sequences, table), "sequences")
            remove(spark, old)
    remove(spark, path)
    columns = ["lang", "phrase", "size", "a", "heads", "tails", "covered"]
    out = found[0].select(columns)
    for part in found[1:]:
        out = out.unionByName(part.select(columns))
    return out, totals


def scored() -> Column:
    """The lowest-scoring cut of a candidate as a struct: score, k, l, r."""
    return F.expr("array_min(transform(sequence(1, size - 1), k -> struct((cast(a as decimal(20, 0)) * 2000000) div (cast(heads[k - 1] as decimal(20, 0)) + tails[size - k - 1]) as score, k as k, heads[k - 1] as l, tails[size - k - 1] as r)))")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    found, totals = phrases(docs, longest, least, shard_keys)
    kept = found.where(F.col("covered").isNull() | (F.col("covered").cast("decimal(20, 0)") * 100 < F.col("a").cast("decimal(20, 0)") * COVERED))
    cut = kept.select("lang", "phrase", "a", scored().alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
