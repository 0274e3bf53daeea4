"""Structured Streaming forms of the stateful operators: live gap sessions, newest per topic, and a pending buffer with late drop."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mapweave.functions.work import work_dir

#: Seconds after which a waiting scan is given up.
PENDING_S = 5.0


def sessions(rows: DataFrame, by: list[str], ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end when more than `gap` passes; rows exactly one gap apart stay together."""
    d = rows.withWatermark(ts, late) if rows.isStreaming else rows
    g = d.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return g.drop("w")


def newest(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The newest row per key as an upsert view: state holds one row per key (output mode update or complete)."""
    g = rows.groupBy(*by).agg(F.max(F.struct(*order, *[c for c in values if c not in order])).alias("v"))
    return g.select(*by, *[F.col(f"v.{c}").alias(c) for c in values])


@dataclass
class Pending:
    """Scans wait for the pose that ends nearest to them. A scan more than PENDING_S behind the newest scan is dropped; a pose takes the nearest-ending waiting scan and discards the older ones."""

    waiting: list[tuple[float, float, int]] = field(default_factory=list)  # (begin, end, id)
    newest: float = float("-inf")
    dropped: int = 0

    def scan(self, begin: float, end: float, ident: int) -> None:
        self.newest = max(self.newest, begin)
        self.waiting.append((begin, end, ident))
        kept = [w for w in self.waiting if self.newest - w[0] <= PENDING_S]
        self.dropped += len(self.waiting) - len(kept)
        self.waiting = kept

    def pose(self, at: float) -> int | None:
        if not self.waiting:
            return None
        best = min(range(len(self.waiting)), key=lambda i: (abs(self.waiting[i][1] - at), i))
        ident = self.waiting[best][2]
        self.dropped += best
        self.waiting = self.waiting[best + 1 :]
        return ident


def matched(rows: DataFrame, by: str, timeout_ms: int = 60_000) -> DataFrame:
    """(key, scan_id, pose_at, dropped) as poses arrive. rows: the key (string), kind ('scan' or 'pose'), begin, end, id; within a micro-batch they are taken in order of end. The state of a key that is silent for timeout_ms goes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        p = Pending()
        if state.exists:
            begins, ends, ids, newest_, dropped = state.get
            p = Pending([*zip(begins, ends, ids, strict=True)], newest_, dropped)
        rows_ = pd.concat(list(batches)).sort_values(["end", "id"])
        out = []
        for r in rows_.itertuples():
            if r.kind == "scan":
                p.scan(r.begin, r.end, r.id)
            elif (got := p.pose(r.end)) is not None:
                out.append((key[0], got, r.end, p.dropped))
        state.update(([w[0] for w in p.waiting], [w[1] for w in p.waiting], [w[2] for w in p.waiting], p.newest, p.dropped))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["key", "scan_id", "pose_at", "dropped"])

    held = "begins array<double>, ends array<double>, ids array<long>, newest double, dropped long"
    return rows.groupBy(by).applyInPandasWithState(run, "key string, scan_id long, pose_at double, dropped long", held, "append", GroupStateTimeout.ProcessingTimeTimeout)


def in_order(rows: DataFrame, by: str, late: str, start: tuple, step: Callable[[tuple, str, float, float], tuple[tuple, float | None]]) -> DataFrame:
    """Several streams as one, in order of event time, through one state machine per key: (key, source, id, ts, out) for each row at which the machine says something.

    rows: the key (string), ts (timestamp), source (string), id (long), value (double), of all streams together. Rows wait in the state until the watermark (`late` behind the newest) has passed them, are taken in order of (ts, source, id) and given to
    step(state, source, seconds, value), which returns the new state (numbers, as many as start) and what it says, or None. So the result does not depend on the order of arrival as long as nothing is later than that; what is, is dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, values, done = [], start, -1
        if state.exists:
            ts, sources, ids, numbers, values, done = state.get
            held, values = [*zip(ts, sources, ids, numbers, strict=True)], tuple(values)
        passed = state.getCurrentWatermarkMs() * 1000
        done = max(done, passed)
        for b in batches if not state.hasTimedOut else ():
            micros = b["ts"].astype("datetime64[us]").astype("int64")
            held += [r for r in zip(micros.tolist(), b["source"].tolist(), b["id"].tolist(), b["value"].tolist(), strict=True) if r[0] > done]
        held.sort(key=lambda r: r[:3])
        out = []
        n = next((i for i, r in enumerate(held) if r[0] > passed), len(held))
        for t, source, ident, value in held[:n]:
            values, said = step(values, source, t / 1e6, value)
            if said is not None:
                out.append((key[0], source, ident, pd.Timestamp(t, unit="us"), said))
        held = held[n:]
        ts, sources, ids, numbers = ([r[i] for r in held] for i in range(4))
        state.update((ts, sources, ids, numbers, list(values), done))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, passed // 1000 + 1))
        yield pd.DataFrame(out, columns=["key", "source", "id", "ts", "out"])

    held = "ts array<long>, source array<string>, id array<long>, value array<double>, state array<double>, done long"
    d = rows.withWatermark("ts", late).groupBy(by)
    return d.applyInPandasWithState(run, "key string, source string, id long, ts timestamp, out double", held, "append", GroupStateTimeout.EventTimeTimeout)


class Broadcast:
    """Events to slow readers: a reader that falls behind by more than the capacity loses the oldest and is told how many."""

    def __init__(self, capacity: int = 256) -> None:
        self.capacity, self.readers = capacity, []

    def reader(self) -> Callable[[], tuple[list, int]]:
        queue, lost = deque(), [0]
        self.readers.append((queue, lost))

        def take() -> tuple[list, int]:
            out, n = list(queue), lost[0]
            queue.clear()
            lost[0] = 0
            return out, n

        return take

    def emit(self, event) -> None:  # noqa: ANN001
        for queue, lost in self.readers:
            if len(queue) == self.capacity:
                queue.popleft()
                lost[0] += 1
            queue.append(event)

    def sink(self, df: DataFrame, _: int) -> None:
        """For foreachBatch over a small stream of events."""
        for row in df.toLocalIterator():
            self.emit(row.asDict())


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its last result, written in the shared folder by the executors."""
    spark: SparkSession = stream.sparkSession
    out, state = work_dir(spark, "live-out"), work_dir(spark, "live-state")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    q.foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
