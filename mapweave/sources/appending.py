"""Appending to finished .mcap recordings in place, and replacing generated topics there.

New chunks go behind the file's end, followed by a summary that covers old and new chunks, so an append costs the new bytes and a summary, whatever the recording's size. Until the last bytes (footer and magic) are there and the new chunks have been read back, not one old byte
is touched: what fails is cut off again and the recording is as before. Then the old summary, and each chunk of a replaced channel with its message indexes, gets the header of a filler record, which every reader skips.

Messages come as a DataFrame: they are sorted by time over ranges, tasks cut chunks (CHUNK_BYTES or CHUNK_SPAN) and compress them, and the driver writes the finished chunks one after another, a partition at a time. A recording is one file with one writer, on a local or
mounted path. A recording without a summary (cut short) is refused.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mcap

ATTACHMENT_INDEX, METADATA_INDEX, SUMMARY_OFFSET = 10, 13, 14
FOOTER_BYTES = 9 + 20 + 8


@dataclass
class Spec:
    """A channel to write to: topic, message encoding, schema (name; encoding and data as in the file), metadata."""

    topic: str
    encoding: str
    kind: str = ""
    schema_encoding: str = ""
    schema_data: bytes = b""
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Known:
    """A channel of the file: its topic and metadata, and the contents of its records."""

    topic: str
    metadata: dict[str, str]
    schema: int
    content: bytes


def _chunk_of(index: bytes) -> tuple[int, int, frozenset[int], int]:
    """Start, length, channels and bytes of message indexes of a chunk index record."""
    _, _, start, length, n = struct.unpack_from("<QQQQI", index)
    inside = frozenset(struct.unpack_from("<HQ", index, 36 + i)[0] for i in range(0, n, 10))
    return start, length, inside, struct.unpack_from("<Q", index, 36 + n)[0]


class Appender:
    """An open recording. Leaving it without `finish` cuts off what was written."""

    def __init__(self, path: str) -> None:
        self.f = open(path, "r+b")  # noqa: SIM115  closed on leaving
        self.size = self.f.seek(0, 2)
        self.f.seek(max(0, self.size - FOOTER_BYTES))
        end = self.f.read()
        op, _, self.summary = struct.unpack_from("<BQQ", end) if len(end) == FOOTER_BYTES else (0, 0, 0)
        if op != mcap.FOOTER or end[-8:] != mcap.MAGIC or not 8 <= self.summary < self.size:
            self.f.close()
            raise ValueError("a recording without a summary cannot be appended to")
        self.f.seek(self.summary)
        self.schemas: dict[int, bytes] = {}
        self.channels: dict[int, Known] = {}
        self.chunks: list[bytes] = []
        self.others: list[tuple[int, bytes]] = []
        self.counts: dict[int, int] = {}
        self.attachments = self.metadata = 0
        for op, _, c in mcap.records(self.f.read(self.size - FOOTER_BYTES - self.summary)):
            if op == mcap.SCHEMA:
                self.schemas[struct.unpack_from("<H", c)[0]] = c
            elif op == mcap.CHANNEL:
                ident, schema = struct.unpack_from("<HH", c)
                topic, at = mcap._text(c, 4)
                _, at = mcap._text(c, at)
                self.channels[ident] = Known(topic, mcap._pairs(c, at), schema, c)
            elif op == mcap.CHUNK_INDEX:
                self.chunks.append(c)
            elif op == mcap.STATISTICS:
                self.attachments, self.metadata = struct.unpack_from("<II", c, 14)
                (n,) = struct.unpack_from("<I", c, 42)
                self.counts = dict(struct.unpack_from("<HQ", c, 46 + i) for i in range(0, n, 10))
            elif op in (ATTACHMENT_INDEX, METADATA_INDEX):
                self.others.append((op, c))
        # the data section ends with the record before the summary
        self.data_end = self.summary - 9 - 4
        self.at, self.new, self.retired = self.size, [], []
        self.ids = 1 + max([0, *self.channels, *self.counts, *self.schemas])
        self.held: list[tuple[int, bytes, int]] = []
        self.held_bytes, self.done = 0, False

    def __enter__(self) -> Appender:
        return self

    def __exit__(self, *exc: object) -> None:
        if not self.done:
            self.f.truncate(self.size)
        self.f.close()

    def channel(self, spec: Spec) -> int:
        """The channel that says the same, or a new one under an id that the file does not know."""
        schema = 0
        if spec.kind:
            body = mcap.text(spec.kind) + mcap.text(spec.schema_encoding or spec.encoding) + struct.pack("<I", len(spec.schema_data)) + spec.schema_data
            schema = next((k for k, c in self.schemas.items() if c[2:] == body), 0)
            if not schema:
                schema, self.ids = self.ids, self.ids + 1
                self.schemas[schema] = struct.pack("<H", schema) + body
        rest = struct.pack("<H", schema) + mcap.text(spec.topic) + mcap.text(spec.encoding) + mcap.pairs(spec.metadata)
        for ident, c in self.channels.items():
            if c.content[2:] == rest:
                return ident
        ident, self.ids = self.ids, self.ids + 1
        if ident > 0xFFFF:
            raise ValueError("the recording has no channel ids left")
        self.channels[ident] = Known(spec.topic, spec.metadata, schema, struct.pack("<H", ident) + rest)
        return ident

    def declared(self, channels: list[int] | None = None) -> dict[int, tuple[bytes, bytes]]:
        return {k: (self.schemas.get(self.channels[k].schema, b""), self.channels[k].content) for k in channels or self.channels}

    def retire(self, channels: set[int]) -> list[tuple[int, int]]:
        """Takes channels out of the recording. Returns the chunks (start, length) that hold others too: those go as well, so their other messages must be written again."""
        mixed, kept = [], []
        for c in self.chunks:
            start, length, inside, marks = _chunk_of(c)
            if not inside & channels:
                kept.append(c)
                continue
            self.retired.append((start, length + marks))
            if inside - channels:
                mixed.append((start, length))
        self.chunks = kept
        for k in channels:
            self.channels.pop(k, None)
            self.counts.pop(k, None)
        used = {c.schema for c in self.channels.values()}
        self.schemas = {k: v for k, v in self.schemas.items() if k in used}
        return mixed

    def write(self, channel: int, seq: int, log: int, data: bytes, published: int | None = None) -> None:
        """One message; chunks are cut as messages come, so they should come in order of time."""
        if self.held and (self.held_bytes + len(data) > mcap.CHUNK_BYTES or abs(log - self.held[0][0]) > mcap.CHUNK_SPAN):
            self.flush()
        self.held.append((log, struct.pack("<HIQQ", channel, seq, log, log if published is None else published) + data, channel))
        self.held_bytes += len(data)

    def flush(self) -> None:
        if self.held:
            self.held.sort(key=lambda m: m[0])
            self.place(mcap.pack_chunk(self.held, self.declared(sorted({m[2] for m in self.held}))))
            self.held, self.held_bytes = [], 0

    def place(self, made: mcap.Packed) -> None:
        self.f.seek(self.at)
        index = made.index(self.at)
        raw = made.chunk + b"".join(m for _, m in made.marks)
        self.f.write(raw)
        self.new.append((self.at, len(made.chunk), sum(made.counts.values())))
        self.chunks.append(index)
        for k, n in made.counts.items():
            self.counts[k] = self.counts.get(k, 0) + n
        self.at += len(raw)

    def finish(self) -> int:
        """Writes the summary, reads the new chunks back, and only then covers what is no longer used. Returns the messages written."""
        self.flush()
        out = bytearray(mcap.record(mcap.DATA_END, struct.pack("<I", 0)))
        summary, groups = self.at + len(out), []

        def group(op: int, contents: list[bytes]) -> None:
            start = self.at + len(out)
            for c in contents:
                out.extend(mcap.record(op, c))
            if contents:
                groups.append((op, start, self.at + len(out) - start))

        group(mcap.SCHEMA, [*self.schemas.values()])
        group(mcap.CHANNEL, [c.content for c in self.channels.values()])
        times = [struct.unpack_from("<QQ", c) for c in self.chunks]
        counts = b"".join(struct.pack("<HQ", k, v) for k, v in self.counts.items())
        ends = min((t[0] for t in times), default=0), max((t[1] for t in times), default=0)
        group(mcap.STATISTICS, [struct.pack("<QHIIIIQQI", sum(self.counts.values()), len(self.schemas), len(self.channels), self.attachments, self.metadata, len(self.chunks), *ends, len(counts)) + counts])
        group(mcap.CHUNK_INDEX, self.chunks)
        for op in (ATTACHMENT_INDEX, METADATA_INDEX):
            group(op, [c for o, c in self.others if o == op])
        offsets = self.at + len(out)
        for op, start, n in groups:
            out.extend(mcap.record(SUMMARY_OFFSET, struct.pack("<BQQ", op, start, n)))
        out.extend(mcap.record(mcap.FOOTER, struct.pack("<QQI", summary, offsets, 0)) + mcap.MAGIC)
        self.f.seek(self.at)
        self.f.write(out)
        self._sync()
        for start, length, n in self.new:
            if sum(1 for _ in mcap.messages(self.f, start, length, None)) != n:
                raise ValueError(f"the chunk at {start} does not read back")
        self.done = True
        for start, n in [*self.retired, (self.data_end, self.size - self.data_end)]:
            self.f.seek(start)
            self.f.write(struct.pack("<BQ", mcap.FILLER, n - 9))
        self._sync()
        return sum(n for _, _, n in self.new)

    def _sync(self) -> None:
        self.f.flush()
        os.fsync(self.f.fileno())


PACKED = "part int, nth int, chunk binary, marks array<struct<channel:int,mark:binary>>, low long, high long, packed long, raw long, counts map<int,long>"


def packed(messages: DataFrame, declared: dict[int, tuple[bytes, bytes]]) -> DataFrame:
    """Finished chunks of messages (channel, seq, log, published, payload; times in ns), sorted by time over all ranges: (part, nth) is their order. Chunks of a range do not overlap in time."""
    from pyspark import TaskContext

    chunk_bytes, span = mcap.CHUNK_BYTES, mcap.CHUNK_SPAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            nonlocal nth, held, size
            c = mcap.pack_chunk(held, declared)
            one = {"part": part, "nth": nth, "chunk": c.chunk, "marks": [{"channel": k, "mark": m} for k, m in c.marks], "low": c.low, "high": c.high, "packed": c.packed, "raw": c.raw, "counts": [*c.counts.items()]}
            nth, held, size = nth + 1, [], 0
            return pa.RecordBatch.from_pylist([one], kind)

        kind = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("chunk", pa.binary()), ("marks", pa.list_(pa.struct([("channel", pa.int32()), ("mark", pa.binary())]))), ("low", pa.int64()), ("high", pa.int64()), ("packed", pa.int64()), ("raw", pa.int64()), ("counts", pa.map_(pa.int32(), pa.int64()))])
        for b in batches:
            for channel, seq, log, published, data in zip(*(b.column(c).to_pylist() for c in ("channel", "seq", "log", "published", "payload")), strict=True):
                if held and (size + len(data) > chunk_bytes or log - held[0][0] > span):
                    yield row()
                held.append((log, struct.pack("<HIQQ", channel, seq, log, published) + data, channel))
                size += len(data)
        if held:
            yield row()

    order = ["log", "channel", "seq"]
    m = messages.select(F.col("channel").cast("int"), F.pmod(F.col("seq").cast("long"), F.lit(1 << 32)).alias("seq"), F.greatest(F.col("log").cast("long"), F.lit(0)).alias("log"), F.greatest(F.coalesce(F.col("published").cast("long"), F.col("log").cast("long")), F.lit(0)).alias("published"), F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"))
    return m.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PACKED)


def _messages_in(spark: SparkSession, path: str, chunks: list[tuple[int, int]], without: set[int]) -> DataFrame:
    """channel, seq, log, published, payload of chunks, read by tasks."""
    gone = frozenset(without)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                for start, length in zip(b.column("start").to_pylist(), b.column("length").to_pylist(), strict=True):
                    rows = [m for m in mcap.messages(f, start, length, None) if m[0] not in gone]
                    if rows:
                        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["channel", "seq", "log", "published", "payload"])

    d = spark.createDataFrame(chunks or [(0, 0)], "start long, length long")
    return (d if chunks else d.limit(0)).mapInArrow(run, "channel int, seq long, log long, published long, payload binary")


def append(spark: SparkSession, path: str, messages: DataFrame, specs: list[Spec], replace: bool = False) -> int:
    """Appends messages (topic, seq, log, published or null, payload; times in ns) to the recording at path; returns how many. specs: the channel of each topic; a channel that the file has already goes on.

    replace: the messages are the topics' whole new contents, and what was generated on them before goes (with the older generations of other generated topics, where a newer one is there). A topic that was recorded (a channel without a generation) is refused then, and specs need a generation."""
    path = path.removeprefix("file://")
    topics = [s.topic for s in specs]
    if len(set(topics)) < len(topics):
        raise ValueError("a topic has one channel")
    with Appender(path) as a:
        carried: list[tuple[int, int]] = []
        gone: set[int] = set()
        if replace:
            if any("generation" not in s.metadata for s in specs):
                raise ValueError("a channel that replaces others has a generation")
            for c in a.channels.values():
                if c.topic in topics and "generation" not in c.metadata:
                    raise ValueError(f"{c.topic} was recorded; it is not replaced")
            gone = {k for k, c in a.channels.items() if c.topic in topics} | superseded(a.channels)
            carried = a.retire(gone)
        ids = {s.topic: a.channel(s) for s in specs}
        number = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])[F.col("topic")] if ids else F.lit(None).cast("int")
        new = messages.select(F.coalesce(number, F.raise_error(F.concat(F.lit("no channel for "), F.coalesce("topic", F.lit("null"))))).alias("channel"), "seq", "log", "published", "payload")
        if carried:  # what else stood in chunks that go; it is counted anew
            others = _messages_in(spark, path, carried, gone)
            for r in others.groupBy("channel").count().collect():
                a.counts[r["channel"]] -= r["count"]
            new = new.unionByName(others)
        for r in packed(new, a.declared()).orderBy("part", "nth").toLocalIterator():
            a.place(mcap.Packed(bytes(r["chunk"]), [(m["channel"], bytes(m["mark"])) for m in r["marks"]], r["low"], r["high"], r["packed"], r["raw"], r["counts"]))
        return a.finish()


def superseded(channels: dict[int, Known]) -> set[int]:
    """Generated channels whose topic has a newer generation."""
    newest: dict[str, float] = {}
    for c in channels.values():
        if "generation" in c.metadata:
            newest[c.topic] = max(newest.get(c.topic, float("-inf")), float(c.metadata["generation"]))
    return {k for k, c in channels.items() if "generation" in c.metadata and float(c.metadata["generation"]) < newest[c.topic]}


def migrate(spark: SparkSession, path: str) -> bool:
    """Takes older generations out of a recording in place; False where there are none."""
    path = path.removeprefix("file://")
    with Appender(path) as a:
        gone = superseded(a.channels)
        if not gone:
            a.done = True
            return False
        carried = a.retire(gone)
        if carried:
            others = _messages_in(spark, path, carried, gone)
            for r in others.groupBy("channel").count().collect():
                a.counts[r["channel"]] -= r["count"]
            for r in packed(others, a.declared()).orderBy("part", "nth").toLocalIterator():
                a.place(mcap.Packed(bytes(r["chunk"]), [(m["channel"], bytes(m["mark"])) for m in r["marks"]], r["low"], r["high"], r["packed"], r["raw"], r["counts"]))
        a.finish()
        return True
