"""Shared helpers: text columns, the shared work folder and tables written there."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, in local mode only, one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "mapweave-shared")
    os.makedirs(own, exist_ok=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def work_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/mapweave/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop, whatever its store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone when Python ends
            return


def materialize(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and files outlive executors."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__mw_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, counts: DataFrame, share: int = 1000) -> DataFrame:
    """Left join of rows with keyed, which has a row a key at most. Keys with more than one in `share` of all rows (counts: key, count), of which there can be
    no more than `share`, are joined by broadcast, so no task gets all rows of a hot key."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = materialize(keyed.join(counts.where(F.col("count") > total / share).select(key), key), "hot")
    hot_rows = rows.join(F.broadcast(hot), key)
    return hot_rows.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed, key, "left"))
