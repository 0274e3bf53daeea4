"""Order statistics as picks of an index of the sorted values, without interpolation, and ranks without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import written


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Adds a global rank from 0. Rows are dealt by range and written with the number of their range, so that ranks within a range and counts of earlier ranges see the same rows."""
    dealt = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    own = Window.partitionBy("__part").orderBy(*order)
    numbered = dealt.withColumn("__nth", F.row_number().over(own) - 1)
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    return numbered.join(before, "__part").withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def pick_all(df: DataFrame, by: list[str], value: str, indexes: dict[str, Column]) -> DataFrame:
    """Per group, n and the values at several indexes (expressions of the group's size n) of its sorted values, a column each; nulls left out. Values are dealt over ranges of (group, value) and counted by range, so only the ranges that hold an index are ranked, and no task needs a whole group."""
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    dealt = written(d.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()), "values")
    own, parts = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__part", *by).agg(F.count("*").alias("__c"))  # a row per range and group
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__c").over(parts), F.lit(0)), "n": F.sum("__c").over(own)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), i.cast("long").alias("i")) for name, i in indexes.items()]))
    held = counts.select("*", wanted.alias("__w")).where((F.col("__w.i") >= F.col("__before")) & (F.col("__w.i") < F.col("__before") + F.col("__c")))
    held = held.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in by], "n", F.col("__w.name").alias("__name"), (F.col("__w.i") - F.col("__before")).alias("__at"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = dealt.join(held, same).withColumn("__nth", F.row_number().over(Window.partitionBy("__part", *by, "__name").orderBy("__v")) - 1)
    found = rows.where(F.col("__nth") == F.col("__at"))
    return found.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in indexes])


def first_rows(df: DataFrame, by: list[str], order: list[str], wanted: Column) -> DataFrame:
    """Per group the first rows in the order, as many as `wanted` (an expression of the group's size n) says. Rows are dealt over ranges of (group, order) and counted by range: ranges before the cut are taken as they are, only the one that it falls into is ranked, and no task needs a whole group."""
    dealt = written(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "first-rows")
    own, parts = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__part", *by).agg(F.count("*").alias("__c"))  # a row per range and group
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__c").over(parts), F.lit(0)), "n": F.sum("__c").over(own)})
    left = written(counts.select("__part", *by, "__c", (wanted - F.col("__before")).alias("__left")).where("__left > 0"), "cuts")
    rows = dealt.join(left, ["__part", *by])
    cut = rows.where("__left < __c").withColumn("__nth", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))).where("__nth <= __left")
    return rows.where("__left >= __c").select(*df.columns).unionByName(cut.select(*df.columns))


def pick(df: DataFrame, by: list[str], value: str, index: Column, name: str = "picked") -> DataFrame:
    """Per group, n and the value at `index`; groups that have no such index are left out."""
    return pick_all(df, by, value, {name: index})


def upper_median(df: DataFrame, by: list[str], value: str, name: str = "picked") -> DataFrame:
    """sorted[n div 2]: of an even number of values the upper middle one."""
    return pick(df, by, value, F.floor(F.col("n") / 2), name)


def percentile(df: DataFrame, by: list[str], value: str, q: float, name: str = "picked") -> DataFrame:
    """sorted[round((n - 1) q)], halves away from zero."""
    return pick(df, by, value, _at(q), name)


def percentiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Several percentiles, a column each."""
    return pick_all(df, by, value, {name: _at(q) for name, q in qs.items()})


def _at(q: float) -> Column:
    return F.floor((F.col("n") - 1) * F.lit(q) + 0.5)
