"""Registered queries: a Spark function per name and, where SQL can express it, DuckDB SQL with the same column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: lineitem as points with pseudo normals; the same columns in both dialects.
PTS = """(SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag, CAST(l_quantity AS FLOAT) AS x, CAST(l_extendedprice / 1000 AS FLOAT) AS y,
  CAST(l_discount * 100 AS FLOAT) AS z, CAST((l_linenumber - 4) / 4.0 AS DOUBLE) AS nz, CAST(l_tax * 10 AS DOUBLE) AS nx, CAST(0 AS DOUBLE) AS ny, CAST(l_quantity AS DOUBLE) AS h FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda e, t, n: F.expr(e).cast(t).alias(n)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("flag"),
        f("l_quantity", "float", "x"), f("l_extendedprice / 1000", "float", "y"), f("l_discount * 100", "float", "z"),
        f("(l_linenumber - 4) / 4.0D", "double", "nz"), f("l_tax * 10", "double", "nx"), f("0D", "double", "ny"), f("l_quantity", "double", "h"),
    )


#: embeddings as points and normals.
EMB = "(SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])


#: events with integer times.
EV = "(SELECT event_id AS id, epoch_us(ts) AS t, user_id AS u, event_type AS kind, value AS v, props FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").alias("u"), F.col("event_type").alias("kind"), F.col("value").alias("v"), "props")
