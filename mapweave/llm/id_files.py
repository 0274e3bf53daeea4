"""Token ids in files of fixed-width bits.

An id takes as many bits as the largest id of the vocabulary needs. Eight ids take `width` bytes, so ids are packed and unpacked by groups of eight with numpy shifts. A file is

    header      MAGIC, width and ids a block (two u32)
    blocks      BLOCK_IDS ids each, the last one fewer, padded to a group of eight
    index       offsets of the blocks and the file's end of blocks (u64), crc32 of the blocks (u32), ids before the end of each document (u64), doc ids (i64), whether the doc id is null (u8)
    footer      blocks, documents, ids and the index's place (four u64), crc32 of the index (u32), MAGIC

all little-endian. Any run of ids is read from the blocks that hold it and nothing else. Documents are range-sorted by id, encoded by the task of their range and written in that order: every task rolls
files at FILE_IDS ids, under an attempt's own name, renamed when complete; only files named by the manifest of the successful attempts are read. Where a file's ids start in the whole follows from
sums over the manifest.

Defined results: null texts are empty and have the end id alone; null doc ids come first; rows that repeat an id are in the order of a hash of their texts, equal rows in that in which they are read (so any number of them is spread over ranges);
very long texts are one document of one file; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, text_of, work_dir

MAGIC = b"BITIDS01"
END_ID = 0
#: Ids of a block (a multiple of eight) and, but for a longer document, of a file; bytes of text that a task encodes on average; parts whose files one task adds up.
BLOCK_IDS, FILE_IDS, TASK_BYTES, SUM_ROWS = 1 << 16, 1 << 25, 64 << 20, 1000
HEADER, FOOTER = struct.Struct("<8sII"), struct.Struct("<QQQQI8s")
MANIFEST = "part int, nth int, path string, n_docs long, n_ids long, n_bytes long"


def width_of(vocabulary: int) -> int:
    """The bits that any id below `vocabulary` fits in."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id has more than {width} bits")
    groups = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    groups[: len(ids)] = ids
    groups = groups.reshape(-1, 8)
    out = np.zeros((len(groups), width), np.uint8)
    for byte in range(width):  # the ids that share bits 8 * byte .. 8 * byte + 7 of a group
        for i in range(8 * byte // width, (8 * byte + 7) // width + 1):
            by = 8 * byte - i * width
            out[:, byte] |= (groups[:, i] >> np.uint64(by) if by >= 0 else groups[:, i] << np.uint64(-by)).astype(np.uint8)
    return out.tobytes()


def unpack_bits(data: bytes, width: int, first: int, n: int) -> np.ndarray:
    """Ids first .. first + n - 1 of packed ones; only their groups are touched."""
    lo, hi = first // 8, -(-(first + n) // 8)
    raw = np.frombuffer(data, np.uint8, (hi - lo) * width, lo * width).reshape(-1, width)
    out = np.zeros((hi - lo, 8), np.uint64)
    for i in range(8):
        for byte in range(i * width // 8, (i * width + width - 1) // 8 + 1):
            by = 8 * byte - i * width
            part = raw[:, byte].astype(np.uint64)
            out[:, i] |= part << np.uint64(by) if by >= 0 else part >> np.uint64(-by)
    out &= np.uint64((1 << width) - 1)
    return out.reshape(-1)[first - 8 * lo : first - 8 * lo + n].astype(np.uint32)


class Writer:
    """One file, written as ids come."""

    def __init__(self, stream, width: int, block_ids: int = BLOCK_IDS) -> None:
        if block_ids % 8:
            raise ValueError("a block has a multiple of eight ids")
        self.stream, self.width, self.block_ids = stream, width, block_ids
        self.at, self.n_ids = HEADER.size, 0
        self.offsets, self.sums, self.ends, self.doc_ids = [], [], [], []
        self.held, self.n_held = [], 0
        stream.write(HEADER.pack(MAGIC, width, block_ids))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.doc_ids.append(doc_id)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(self.n_held // self.block_ids * self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for at in range(0, n, self.block_ids):
            block = pack_bits(ids[at : min(at + self.block_ids, n)], self.width)
            self.offsets.append(self.at)
            self.sums.append(zlib.crc32(block))
            self.stream.write(block)
            self.at += len(block)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> int:
        """The file's bytes; the stream stays open."""
        self._flush(self.n_held)
        known = [0 if d is None else d for d in self.doc_ids]
        index = b"".join(np.array(v, t).tobytes() for v, t in (([*self.offsets, self.at], "<u8"), (self.sums, "<u4"), (self.ends, "<u8"), (known, "<i8"), ([d is None for d in self.doc_ids], "u1")))
        self.stream.write(index)
        self.stream.write(FOOTER.pack(len(self.offsets), len(self.ends), self.n_ids, self.at, zlib.crc32(index), MAGIC))
        return self.at + len(index) + FOOTER.size


class Reader:
    """One file: an open seekable stream."""

    def __init__(self, stream, size: int) -> None:
        self.stream = stream
        magic, self.width, self.block_ids = HEADER.unpack(self._bytes(0, HEADER.size))
        blocks, docs, self.n_ids, at, crc, last = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        index = self._bytes(at, size - FOOTER.size - at)
        if magic != MAGIC or last != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole file of ids")
        cut = np.cumsum([0, 8 * (blocks + 1), 4 * blocks, 8 * docs, 8 * docs, docs])
        self.offsets, self.sums, self.ends, self.doc_ids, null = (np.frombuffer(index[a:b], t) for a, b, t in zip(cut, cut[1:], ("<u8", "<u4", "<u8", "<i8", "u1"), strict=False))
        self.null = null.astype(bool)

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        found = self.stream.read(n)
        if len(found) != n:
            raise ValueError("a file of ids is cut short")
        return found

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first .. first + n - 1 of the file."""
        if first < 0 or n < 0 or first + n > self.n_ids:
            raise IndexError("no such ids")
        out = [np.zeros(0, np.uint32)]
        while n:
            k, inside = divmod(first, self.block_ids)
            here = min(n, self.block_ids - inside)
            block = self._bytes(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))
            if zlib.crc32(block) != self.sums[k]:
                raise ValueError(f"block {k} differs from its checksum")
            out.append(unpack_bits(block, self.width, inside, here))
            first, n = first + here, n - here
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        start = int(self.ends[k - 1]) if k else 0
        return self.ids(start, int(self.ends[k]) - start)


def write(docs: DataFrame, vocabulary: int, root: str | None = None, file_ids: int = FILE_IDS, task_bytes: int = TASK_BYTES, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Encodes the documents and writes their ids in ascending order of doc_id; returns the manifest of the files: part, nth, path, n_docs, n_ids, n_bytes, start (ids in all files before it) and root."""
    root, width = root or work_dir(docs.sparkSession, "ids"), width_of(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        store.create_dir(top, recursive=True)
        bpe, end = tokens.shared(tokens.ByteBpe, path, ranks), np.array([END_ID], "<u2").tobytes()
        part, done, out, name = TaskContext.get().partitionId(), [], None, ""

        def close() -> None:
            size = out.close()
            out.stream.close()
            store.move(name + ".part", name)
            done.append((part, len(done), name, len(out.ends), out.n_ids, size))

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.frombuffer(bpe.encode(text.as_py()) + end, "<u2")
                if out is not None and out.n_ids + len(ids) > file_ids:
                    close()
                    out = None
                if out is None:
                    name = f"{top}/part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids"
                    out = Writer(store.open_output_stream(name + ".part", compression=None), width)
                out.add(doc_id, ids)
        if out is not None:
            close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], ["part", "nth", "path", "n_docs", "n_ids", "n_bytes"])

    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("row")]
    dealt = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(max(1, -(-total // task_bytes)), *order).sortWithinPartitions(*order)
    made = materialize(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")
    # ids before a file: those of whole groups of parts before it, and those before it in its own group
    group = F.expr(f"part div {SUM_ROWS}").alias("group")
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = made.groupBy(group).agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    files = made.withColumn("group", group).join(groups, "group")
    start = (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start")
    return materialize(files.select(*made.columns, start, F.lit(root).alias("root")), "starts")


def read(manifest: DataFrame) -> DataFrame:
    """A row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, root, base, size in zip(*(b.column(c).to_pylist() for c in ("path", "root", "start", "n_bytes")), strict=True):
                with pafs.FileSystem.from_uri(root)[0].open_input_file(path) as f:
                    file = Reader(f, size)
                    starts = np.r_[0, file.ends.astype(np.int64)]
                    k = 0
                    while k < len(file.ends):  # as many documents as about sixteen blocks hold
                        to = max(k + 1, int(np.searchsorted(starts, starts[k] + 16 * file.block_ids, "right")) - 1)
                        raw = file.ids(int(starts[k]), int(starts[to] - starts[k])).astype("<u4").tobytes()
                        cut = (4 * (starts[k : to + 1] - starts[k])).tolist()
                        ids = pa.array([raw[x:y] for x, y in zip(cut, cut[1:], strict=False)], pa.binary())
                        doc_ids = pa.array(file.doc_ids[k:to], pa.int64(), mask=file.null[k:to])
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(base + starts[k:to]), pa.array(np.diff(starts[k : to + 1])), ids], ["doc_id", "start", "n_tokens", "ids"])
                        k = to

    spread = manifest.select("path", "root", "start", "n_bytes").repartitionByRange(max(1, manifest.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
