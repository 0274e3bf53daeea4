"""A voxel map in few bytes: sorted grid keys, gaps between them, LEB128 and gzip. Blocks of a range-sorted map are packed by the task that holds them."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.geometry import voxel_key


def varints(v: np.ndarray) -> bytes:
    """LEB128 of unsigned integers, seven bits a byte, low bits first."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >> np.uint64(7 * k) > 0
    out, at = np.zeros(size.sum(), np.uint8), np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[at[on] + k] = (v[on] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[on] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def integers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if len(b) and (not len(ends) or ends[-1] != len(b) - 1):
        raise ValueError("the last number is cut short")
    start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    shift = np.arange(len(b)) - np.repeat(start, ends - start + 1) if len(ends) else np.zeros(0, np.int64)
    return np.add.reduceat(((b & 127).astype(np.uint64) << (7 * shift).astype(np.uint64)), start) if len(ends) else np.zeros(0, np.uint64)


def pack(keys: np.ndarray) -> bytes:
    """Distinct integer keys (n, 3), in any order."""
    if not len(keys):
        return gzip.compress(struct.pack("<6q", *[0] * 6), mtime=0)
    low = keys.min(0)
    span = keys.max(0) - low + 1
    k = (keys - low).astype(np.uint64)
    flat = np.unique((k[:, 2] * np.uint64(span[1]) + k[:, 1]) * np.uint64(span[0]) + k[:, 0])
    return gzip.compress(struct.pack("<6q", *low, *span) + varints(np.diff(flat, prepend=np.uint64(0))), mtime=0)


def unpack(data: bytes) -> np.ndarray:
    raw = gzip.decompress(data)
    head = np.array(struct.unpack_from("<6q", raw), np.int64)
    flat = np.cumsum(integers(raw[48:])).astype(np.int64)
    if not head[3]:
        return np.zeros((0, 3), np.int64)
    return np.c_[flat % head[3], flat // head[3] % head[4], flat // head[3] // head[4]] + head[:3]


def packed(points: DataFrame, voxel: float) -> DataFrame:
    """(block, voxels, data): a row per task of the range-sorted map."""
    keys = points.select(*[voxel_key(F.col(c), voxel).alias(f"k{c}") for c in "xyz"]).distinct().repartitionByRange("kz", "ky", "kx").sortWithinPartitions("kz", "ky", "kx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("kx", "ky", "kz")], 1)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([len(a)], pa.int64()), pa.array([pack(a)], pa.binary())], ["voxels", "data"])

    return keys.mapInArrow(run, "voxels long, data binary")


def unpacked(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                a = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, k], pa.int64()) for k in range(3)], ["kx", "ky", "kz"])

    return blocks.mapInArrow(run, "kx long, ky long, kz long")
