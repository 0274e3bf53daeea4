"""Spark data sources over recordings: format "recording" with option path (.db or .mcap) and, optionally, streams (comma-separated).

Rows: stream, seq, log_time (seconds), encoding, type_name, payload, pose, tags. Filters on stream are pushed down: an .mcap is read by
groups of chunks that hold a wanted channel, a .db stream by stream. Files are opened through pyarrow's file systems, so a path may be local, on hdfs:// or in an object store; SQLite
needs a local or mounted path.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import mcap

SCHEMA = "stream string, seq long, log_time double, encoding string, type_name string, payload binary, pose array<double>, tags string"
POSE = "struct<t: struct<x: double, y: double, z: double>, q: struct<x: double, y: double, z: double, w: double>>"
#: Bytes of chunks that one task reads.
TASK_BYTES = 64 << 20


def kind_of(path: str) -> str:
    for end in (".db", ".mcap"):
        if path.endswith(end):
            return end[1:]
    raise ValueError("a recording is a .db or an .mcap file")


def opened(path: str):
    """(file, size)."""
    store, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return store.open_input_file(at), store.get_file_info(at).size


def database(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def type_name(module: str) -> str:
    """Module paths of five parts name the package third and the class last."""
    p = module.split(".")
    return f"{p[2]}.{p[4]}" if len(p) == 5 and p[1] == "msgs" else module


def db_streams(db: sqlite3.Connection) -> list[tuple[str, str, str]]:
    """(name, type, codec), without counting rows."""
    out = []
    for name, config in db.execute("SELECT name, config FROM _streams ORDER BY name"):
        c = json.loads(config or "{}")
        out.append((name, type_name(c.get("payload_module", "")), c.get("codec_id", c.get("codec", "lcm"))))
    return out


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Part(InputPartition):
    stream: str | None = None
    chunks: tuple = ()
    channels: tuple = ()


class Reader(DataSourceReader):
    def __init__(self, path: str, streams: list[str] | None, until: int | None = None) -> None:
        self.path, self.kind, self.streams, self.until = path, kind_of(path), None if streams is None else set(streams), until

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the API's name
        for f in filters:
            own = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if own is not None and f.attribute == ("stream",):
                self.streams = own if self.streams is None else self.streams & own
            else:
                yield f

    def partitions(self) -> list[Part]:
        wanted = lambda name: self.streams is None or name in self.streams
        if self.kind == "db":
            with database(self.path) as db:
                return [Part(stream=n, channels=(t, c)) for n, t, c in db_streams(db) if wanted(n)] or [Part()]
        f, size = opened(self.path)
        found = mcap.index(f, size)
        f.close()
        channels = tuple((c.id, c.topic, c.encoding, c.type) for c in found.channels.values() if wanted(c.topic))
        ids = {c[0] for c in channels}
        parts, group, held = [], [], 0
        for start, length, inside in sorted(found.chunks, key=lambda c: c[0]):
            if self.until is not None and start >= self.until:
                break
            if inside is not None and inside != mcap.LOOSE and not inside & ids:
                continue
            group.append((start, length))
            held += length
            if held >= TASK_BYTES:
                parts.append(Part(chunks=tuple(group), channels=channels))
                group, held = [], 0
        if group:
            parts.append(Part(chunks=tuple(group), channels=channels))
        return parts or [Part()]

    def read(self, partition: Part) -> Iterator[tuple]:
        if self.kind == "mcap":
            if not partition.chunks:
                return
            by = {c[0]: c for c in partition.channels}
            f, _ = opened(self.path)
            try:
                for start, length in partition.chunks:
                    for channel, seq, log, _, data in mcap.messages(f, start, length, frozenset(by)):
                        _, topic, encoding, kind = by[channel]
                        yield topic, seq, log / 1e9, encoding, kind, data, None, None
            except mcap.Unreadable:  # what stands before it was read
                return
            finally:
                f.close()
        elif partition.stream is not None:
            kind, codec = partition.channels
            if codec not in ("lcm", "jpeg"):
                raise ValueError(f"payloads in {codec} cannot be read here")
            with database(self.path) as db:
                own, blob = quoted(partition.stream), quoted(f"{partition.stream}_blob")
                if not db.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", [f"{partition.stream}_blob"]).fetchone()[0]:
                    return
                names = {r[1] for r in db.execute(f"PRAGMA table_info({own})")}
                tags = "json(m.tags)" if "tags" in names else "NULL"
                poses = ", ".join(f"m.pose_{c}" if f"pose_{c}" in names else "NULL" for c in ("x", "y", "z", "qx", "qy", "qz", "qw"))
                # the order is made without the payloads; each is fetched when its row is reached
                fetch = db.cursor()
                for ident, ts, note, *pose in db.execute(f"SELECT m.id, m.ts, {tags}, {poses} FROM {own} m WHERE EXISTS (SELECT 1 FROM {blob} b WHERE b.id = m.id) ORDER BY m.ts, m.id"):
                    (data,) = fetch.execute(f"SELECT data FROM {blob} WHERE id = ?", [ident]).fetchone()
                    yield partition.stream, ident, float(ts), codec, kind, data, None if None in pose else [float(x) for x in pose], note


class Recording(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        streams = self.options.get("streams")
        until = self.options.get("until")
        return Reader(self.options["path"], streams.split(",") if streams else None, int(until) if until else None)


def first_unreadable(spark: SparkSession, path: str) -> int | None:
    """Where the first chunk of an .mcap that cannot be unpacked begins; None if all can. Chunks are tried by tasks of TASK_BYTES each, so a read can be cut there whatever task holds it."""
    f, size = opened(path)
    chunks = sorted((start, length) for start, length, _ in mcap.index(f, size).chunks)
    f.close()
    if not chunks:
        return None

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        f, _ = opened(path)
        try:
            for b in batches:
                starts, lengths = (b.column(c).to_pylist() for c in ("start", "length"))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, n in zip(starts, lengths, strict=True) if not mcap.readable(f, s, n)], pa.int64())], ["start"])
        finally:
            f.close()

    tasks = max(1, -(-sum(n for _, n in chunks) // TASK_BYTES))
    d = spark.createDataFrame(chunks, "start long, length long").repartition(tasks)
    return d.mapInArrow(run, "start long").agg(F.min("start")).first()[0]


def messages(spark: SparkSession, path: str, streams: list[str] | None = None) -> DataFrame:
    """The messages of a recording; those of an .mcap up to its first chunk that cannot be read, which a pass over all chunks looks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recording)
    r = spark.read.format("recording").option("path", path)
    if kind_of(path) == "mcap" and (until := first_unreadable(spark, path)) is not None:
        r = r.option("until", until)
    return (r.option("streams", ",".join(streams)) if streams else r).load()


def streams(spark: SparkSession, path: str) -> DataFrame:
    """Streams from the index alone: name, type_name, encoding, count (null in a .db, where counting means reading)."""
    if kind_of(path) == "db":
        with database(path) as db:
            rows = [(n, t, c, None) for n, t, c in db_streams(db)]
    else:
        f, size = opened(path)
        found = mcap.index(f, size)
        f.close()
        rows = [(c.topic, c.type, c.encoding, found.counts.get(c.id) if found.complete else None) for c in found.channels.values()]
    return spark.createDataFrame(rows, "stream string, type_name string, encoding string, count long")


def counted(messages_: DataFrame) -> DataFrame:
    return messages_.groupBy("stream", "type_name").agg(F.count("*").alias("count"), F.min("log_time").alias("first"), F.max("log_time").alias("last"))


def _of_type(messages_: DataFrame, *kinds: str) -> DataFrame:
    kind = F.regexp_replace("type_name", "/(msg/)?", ".")
    return messages_.where(kind.isin(*kinds)).withColumn("kind", kind)


def _decoded(kind: str, encoding: str, payload: bytes) -> dict | None:
    """None for what cannot be read as that kind."""
    from . import messages as M

    try:
        return M.decode_cdr(payload, kind) if encoding == "cdr" else M.decode_lcm(payload, kind)
    except (ValueError, KeyError):
        return None


def _micros(seconds: float) -> int:
    return round(seconds * 1e6)


def edges(messages_: DataFrame) -> DataFrame:
    """parent, child, t (long microseconds: the header's stamp, else the log time), seq, pose of all edges in TFMessages; leading slashes go. Undecodable messages are skipped."""
    from . import messages as M

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for kind, encoding, payload, log, seq in zip(b["kind"], b["encoding"], b["payload"], b["log_time"], b["seq"], strict=True):
                for e in (_decoded(kind, encoding, payload) or {}).get("edges", []):
                    stamp = M.seconds(e["header"])
                    pose = {"t": dict(zip("xyz", e["translation"], strict=True)), "q": dict(zip("xyzw", e["rotation"], strict=True))}
                    rows.append((e["header"]["frame"].lstrip("/"), e["child"].lstrip("/"), _micros(stamp if stamp > 0 else log), seq, pose))
            yield pd.DataFrame(rows, columns=["parent", "child", "t", "seq", "pose"])

    d = _of_type(messages_, "tf2_msgs.TFMessage").select("kind", "encoding", "payload", "log_time", "seq")
    return d.mapInPandas(run, f"parent string, child string, t long, seq long, pose {POSE}")


def trajectories(messages_: DataFrame) -> DataFrame:
    """stream, seq, t (log time, long microseconds), frame, pose of all Odometry and PoseStamped messages."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for kind, encoding, payload, log, seq, stream in zip(b["kind"], b["encoding"], b["payload"], b["log_time"], b["seq"], b["stream"], strict=True):
                m = _decoded(kind, encoding, payload)
                if m is not None:
                    pose = {"t": dict(zip("xyz", m["pose"]["position"], strict=True)), "q": dict(zip("xyzw", m["pose"]["orientation"], strict=True))}
                    rows.append((stream, seq, _micros(log), m["header"]["frame"].lstrip("/"), pose))
            yield pd.DataFrame(rows, columns=["stream", "seq", "t", "frame", "pose"])

    d = _of_type(messages_, "nav_msgs.Odometry", "geometry_msgs.PoseStamped").select("kind", "encoding", "payload", "log_time", "seq", "stream")
    return d.mapInPandas(run, f"stream string, seq long, t long, frame string, pose {POSE}")


def scans(messages_: DataFrame) -> DataFrame:
    """The points of all PointCloud2 messages: stream, seq, log and stamp (long microseconds; stamp 0: none), frame, stored (the pose kept with the message, or null), offset (a point's nanoseconds after the stamp, or null), x, y, z."""
    import pyarrow as pa

    from . import messages as M

    kinds = [("stream", pa.string()), ("seq", pa.int64()), ("log", pa.int64()), ("stamp", pa.int64()), ("frame", pa.string()), ("stored", pa.list_(pa.float64())), ("offset", pa.int64()), ("x", pa.float32()), ("y", pa.float32()), ("z", pa.float32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, seq, log, kind, encoding, payload, pose in zip(*(b.column(c).to_pylist() for c in ("stream", "seq", "log_time", "kind", "encoding", "payload", "pose")), strict=True):
                m = _decoded(kind, encoding, payload)
                if m is None:
                    continue
                try:
                    p, times = M.cloud(m, keep_all=True), M.point_times(m)
                except (ValueError, KeyError):
                    continue
                good = np.isfinite(p[:, :3]).all(1)
                n, p = int(good.sum()), p[good]
                offset = pa.nulls(n, pa.int64()) if times is None else pa.array(times[good].astype(np.int64))
                head = (stream, seq, _micros(log), _micros(M.seconds(m["header"])), m["header"]["frame"].lstrip("/"), pose)
                cols = [pa.array([v] * n, t) for v, (_, t) in zip(head, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*cols, offset, *(pa.array(p[:, k]) for k in range(3))], [k for k, _ in kinds])

    d = _of_type(messages_, "sensor_msgs.PointCloud2").select("stream", "seq", "log_time", "kind", "encoding", "payload", "pose")
    d = d.mapInArrow(run, "stream string, seq long, log long, stamp long, frame string, stored array<double>, offset long, x float, y float, z float")
    q = F.struct(*[F.col("stored")[i].alias(c) for i, c in enumerate("xyzw", 3)])
    t = F.struct(*[F.col("stored")[i].alias(c) for i, c in enumerate("xyz")])
    return d.withColumn("stored", F.when(F.size("stored") == 7, F.struct(t.alias("t"), q.alias("q"))).cast(POSE))


def points(messages_: DataFrame) -> DataFrame:
    """stream, seq, ts, frame, x, y, z, intensity of all PointCloud2 messages; undecodable ones are skipped. A cloud's own time 0 is replaced by the log time."""
    from collections.abc import Iterator as It

    import pyarrow as pa

    from . import messages as M

    def run(batches: It[pa.RecordBatch]) -> It[pa.RecordBatch]:
        for b in batches:
            for stream, seq, log, encoding, payload in zip(*(b.column(c).to_pylist() for c in ("stream", "seq", "log_time", "encoding", "payload")), strict=True):
                try:
                    m = M.decode_cdr(payload, "sensor_msgs.PointCloud2") if encoding == "cdr" else M.decode_lcm(payload, "sensor_msgs.PointCloud2")
                    p = M.cloud(m)
                except (ValueError, KeyError):
                    continue
                n, ts = len(p), M.seconds(m["header"]) or log
                cols = [pa.array([stream] * n, pa.string()), pa.array([seq] * n, pa.int64()), pa.array([ts] * n, pa.float64()), pa.array([m["header"]["frame"]] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(p[:, k], pa.float32(), from_pandas=k == 3) for k in range(4)], ["stream", "seq", "ts", "frame", "x", "y", "z", "intensity"])

    d = messages_.where(F.regexp_replace("type_name", "/(msg/)?", ".") == "sensor_msgs.PointCloud2").select("stream", "seq", "log_time", "encoding", "payload")
    return d.mapInArrow(run, "stream string, seq long, ts double, frame string, x float, y float, z float, intensity float")
