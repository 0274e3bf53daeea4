"""Streaming queries, each run over the events table as a stream until it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.streaming import live

from .registry import query, table


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    d = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: the table may be a file or a folder
    return d.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("""SELECT user_id, n, epoch_us(first) AS first_us, epoch_us(last) AS last_us FROM (
  SELECT user_id, session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
      SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, session)""")
def live_sessions(spark, sf_dir):
    d = live.drained(live.sessions(_stream(spark, sf_dir), ["user_id"], "ts", "6 hours"))
    return d.select("user_id", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def live_newest(spark, sf_dir):
    return live.drained(live.newest(_stream(spark, sf_dir), ["event_type"], ["ts", "event_id"], ["event_id", "value"]))


@query("""SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, round(out, 4) AS total FROM (SELECT *, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS out FROM events WHERE event_type IN ('view', 'click'))
 WHERE event_type = 'click' AND epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events WHERE event_type IN ('view', 'click'))""")
def live_in_order(spark, sf_dir):
    """Two streams of each user in order of time: views add up, a click asks for the total; what the watermark (an hour behind the newest) has not passed still waits."""

    def step(state, source, t, value):  # noqa: ANN001, ANN202
        return ((state[0] + value,), None) if source == "view" else (state, state[0])

    rows = _stream(spark, sf_dir).where("event_type in ('view', 'click')")
    rows = rows.select(F.col("user_id").cast("string").alias("k"), "ts", F.col("event_type").alias("source"), F.col("event_id").cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    d = live.drained(live.in_order(rows, "k", "1 hour", (0.0,), step), "append")
    return d.select("key", "id", F.round("out", 4).alias("total"))
