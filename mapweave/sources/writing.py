"""Writing streams back into recordings, and saving maps.

SQLite recordings are one file with one writer, so their rows come in order through one connection, in bounded batches. MCAP files are
appended to in place (`appending`): old messages stay, a generated topic's new generation gets channel metadata `generation`, and readers take the newest. Maps are saved as Parquet tables per name and version;
a version counts once its marker is written, and the newest complete one is read.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.work import shared_dir

from . import appending
from .recordings import quoted

POSE = ["pose_x", "pose_y", "pose_z", "pose_qx", "pose_qy", "pose_qz", "pose_qw"]
Row = tuple[float, bytes, list[float] | None, str | None]  # time, payload, pose, tags


def _create(db: sqlite3.Connection, name: str, module: str, codec: str) -> None:
    db.execute("CREATE TABLE IF NOT EXISTS _streams (name TEXT PRIMARY KEY, config TEXT)")
    db.execute("INSERT OR REPLACE INTO _streams VALUES (?, ?)", [name, json.dumps({"payload_module": module, "codec_id": codec})])
    db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(name)} (id INTEGER PRIMARY KEY, ts REAL NOT NULL, value REAL, {', '.join(c + ' REAL' for c in POSE)}, tags TEXT)")
    db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(name + '_blob')} (id INTEGER PRIMARY KEY, data BLOB NOT NULL)")


def append_rows(path: str, name: str, rows: Iterable[Row], module: str, codec: str = "lcm") -> int:
    """Adds rows to a stream (made if it is missing) in one transaction."""
    with sqlite3.connect(path) as db:
        _create(db, name, module, codec)
        n = 0
        for ts, payload, pose, tags in rows:
            ident = db.execute(f"INSERT INTO {quoted(name)} (ts, {', '.join(POSE)}, tags) VALUES ({', '.join('?' * 9)})", [ts, *(pose or [None] * 7), tags]).lastrowid
            db.execute(f"INSERT INTO {quoted(name + '_blob')} VALUES (?, ?)", [ident, payload])
            n += 1
    return n


def delete_stream(path: str, name: str) -> None:
    with sqlite3.connect(path) as db:
        for t in (name, f"{name}_blob", f"{name}_rtree"):
            db.execute(f"DROP TABLE IF EXISTS {quoted(t)}")
        db.execute("DELETE FROM _streams WHERE name = ?", [name])


def write_stream(path: str, name: str, rows: Iterable[Row], module: str, codec: str = "lcm") -> int:
    """Replaces a stream; the old rows stay if the new ones cannot be written."""
    new = f"{name}__{uuid.uuid4().hex[:8]}"
    n = append_rows(path, new, rows, module, codec)
    with sqlite3.connect(path) as db:
        for end in ("", "_blob"):
            db.execute(f"DROP TABLE IF EXISTS {quoted(name + end)}")
            db.execute(f"ALTER TABLE {quoted(new + end)} RENAME TO {quoted(name + end)}")
        db.execute("DELETE FROM _streams WHERE name = ?", [name])
        db.execute("UPDATE _streams SET name = ? WHERE name = ?", [name, new])
    return n


def messages_of(rows: DataFrame) -> Iterable[Row]:
    """A stream's messages in time order, a partition at a time."""
    for r in rows.orderBy("log_time", "seq").select("log_time", "payload", "pose", "tags").toLocalIterator():
        yield r["log_time"], bytes(r["payload"]), r["pose"], r["tags"]


def append_generation(path: str, topic: str, encoding: str, kind: str, rows: Iterable[tuple[float, bytes]]) -> int:
    """Appends one more generation of a generated topic in place. A topic that was recorded (a channel without a generation) is refused."""
    with appending.Appender(path) as a:
        own = [c for c in a.channels.values() if c.topic == topic]
        if any("generation" not in c.metadata for c in own):
            raise ValueError(f"{topic} was recorded; it is not replaced")
        generation = 1 + max((int(float(c.metadata["generation"])) for c in own), default=0)
        channel = a.channel(appending.Spec(topic, encoding, kind, metadata={"generation": str(generation)}))
        n = 0
        for n, (ts, data) in enumerate(rows, 1):
            a.write(channel, n, max(0, int(ts * 1e9)), data)
        a.finish()
    return n


class Maps:
    """Saved maps under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/maps"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self, name: str) -> list[int]:
        """Complete ones, oldest first."""
        return sorted(int(v) for v in self._names(f"{self.root}/{name}") if self._fs(f"{self.root}/{name}/{v}/.complete")[0].exists(self._fs(f"{self.root}/{name}/{v}/.complete")[1]))

    def save(self, name: str, tables: dict[str, DataFrame]) -> int:
        version = 1 + max([0, *(int(v) for v in self._names(f"{self.root}/{name}"))])
        for t, d in tables.items():
            d.write.parquet(f"{self.root}/{name}/{version}/{t}")
        fs, p = self._fs(f"{self.root}/{name}/{version}/.complete")
        fs.create(p).close()
        return version

    def load(self, name: str, version: int | None = None) -> dict[str, DataFrame]:
        """The newest complete version, or the one asked for."""
        known = self.versions(name)
        if not known or (version and version not in known):
            raise KeyError(name)
        at = f"{self.root}/{name}/{version or known[-1]}"
        return {t: self.spark.read.parquet(f"{at}/{t}") for t in self._names(at) if not t.startswith(".")}

    def names(self) -> list[str]:
        return [n for n in self._names(self.root) if self.versions(n)]

    def newest(self) -> str | None:
        """The name that was saved last."""
        best = None
        for n in self.names():
            fs, p = self._fs(f"{self.root}/{n}/{self.versions(n)[-1]}/.complete")
            key = (fs.getFileStatus(p).getModificationTime(), n)
            best = max(best, key) if best else key
        return best[1] if best else None


def current(messages: DataFrame, generations: DataFrame) -> DataFrame:
    """Messages without those of superseded generations. generations: stream, generation (null: recorded), channel; messages: stream, channel."""
    newest = generations.groupBy("stream").agg(F.max_by("channel", "generation").alias("__c"), F.max("generation").alias("__g")).where("__g is not null")
    d = messages.join(newest, "stream", "left")
    return d.where(F.col("__g").isNull() | (F.col("__c") == F.col("channel"))).drop("__c", "__g")
