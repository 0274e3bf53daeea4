"""Time series: as-of lookups, gap sessions, scans that depend on the last kept row.

Times are long microseconds. Windows are partitioned by the series' key; a lookup is one union and two running windows, one per direction of time, never a range join. Frames that
end at unboundedFollowing are evaluated anew for each row, which is quadratic in a series, so the later sample is found by a running window over descending times.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.work import written


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def bracket(probes: DataFrame, samples: DataFrame, by: list[str], t: str, value: str, seq: str) -> DataFrame:
    """Probes with the sample at or before (t0, v0) and the one at or after (t1, v1), by key. Among samples of one time the first by seq counts."""
    one = Window.partitionBy(*by, t).orderBy(seq)
    s = samples.withColumn("__r", F.row_number().over(one)).where("__r = 1").select(*by, F.col(t).alias("__t"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("__s"))
    p = probes.select(*by, F.col(t).alias("__t"), F.struct(*[F.col(c) for c in probes.columns]).alias("__p"))
    both = s.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    u = Window.partitionBy(*by).orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, 0)
    d = both.withColumns({"__a": F.last("__s", ignorenulls=True).over(w), "__b": F.last("__s", ignorenulls=True).over(u)}).where("__p is not null")
    return d.select("__p.*", F.col("__a.t").alias("t0"), F.col("__a.v").alias("v0"), F.col("__b.t").alias("t1"), F.col("__b.v").alias("v1"))


def ranged_bracket(probes: DataFrame, samples: DataFrame, by: list[str], t: str, value: str, seq: str) -> DataFrame:
    """As `bracket`, for a few series of any length: rows are range-sorted by (key, time) and written with the number of their range; windows stay inside a range, and what a range's first and last rows need from others
    comes from one row a range and key. Keys are not null."""
    s = samples.groupBy(*by, F.col(t).alias("__t")).agg(F.min_by(F.struct(F.col(t).alias("t"), F.col(value).alias("v")), seq).alias("__s"))
    p = probes.select(*by, F.col(t).alias("__t"), F.struct(*[F.col(c) for c in probes.columns]).alias("__p"))
    dealt = written(s.unionByName(p, allowMissingColumns=True).repartitionByRange(*by, "__t").withColumn("__part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("__part", *by)
    up, down = (own.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("__t"), F.desc("__t")))
    d = dealt.withColumns({"__a": F.last("__s", True).over(up), "__b": F.last("__s", True).over(down)}).where("__p is not null")
    edge = dealt.where("__s is not null").groupBy("__part", *by).agg(F.max_by("__s", "__t").alias("__last"), F.min_by("__s", "__t").alias("__first"))
    edge = dealt.select("__part", *by).distinct().join(edge, ["__part", *by], "left")
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__part"), F.desc("__part")))
    edge = edge.select("__part", *by, F.last("__last", True).over(up).alias("__before"), F.last("__first", True).over(down).alias("__after"))
    d = d.join(edge, ["__part", *by]).select("__p", F.coalesce("__a", "__before").alias("__a"), F.coalesce("__b", "__after").alias("__b"))
    return d.select("__p.*", F.col("__a.t").alias("t0"), F.col("__a.v").alias("v0"), F.col("__b.t").alias("t1"), F.col("__b.v").alias("v1"))


def interpolated(probes: DataFrame, samples: DataFrame, by: list[str], t: str, value: str, seq: str, tolerance: int) -> DataFrame:
    """Adds `at`: linear between the bracketing samples, the end sample up to `tolerance` outside, else null. A series whose samples are all equal (within 1e-6), or a single one, always answers."""
    d = bracket(probes, samples, by, t, value, seq)
    own = samples.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    d = d.join(own, by, "left")
    u = (F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    inside = F.when(F.col("t0") == F.col("t1"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * u)
    before = F.when(F.col("t1") - F.col(t) <= tolerance, F.col("v1"))
    after = F.when(F.col(t) - F.col("t0") <= tolerance, F.col("v0"))
    both = F.col("t0").isNotNull() & F.col("t1").isNotNull()
    at = F.when(F.col("__hi") - F.col("__lo") <= 1e-6, F.coalesce("v0", "v1")).when(both, inside).when(F.col("t0").isNull(), before).otherwise(after)
    return d.withColumn("at", at).drop("__lo", "__hi")


def gap_sessions(rows: DataFrame, by: list[str], t: str, gap: int, order: list[str]) -> DataFrame:
    """Adds `session` (from 0): a new one where more than `gap` passed since the row before."""
    w = Window.partitionBy(*by).orderBy(t, *order)
    new = F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def last_kept(rows: DataFrame, by: list[str], order: list[str], far) -> DataFrame:
    """Rows of each series that are far from the row kept before: far(kept, row) over records of the sorted series. The first stays. A chain of decisions, so it runs in order per series."""
    schema = rows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        keep, kept = [], None
        for row in pdf.itertuples(index=False):
            stays = kept is None or far(kept, row)
            keep.append(stays)
            if stays:
                kept = row
        return pdf[keep]

    return rows.groupBy(*by).applyInPandas(run, schema)


def neighbour_speed(rows: DataFrame, by: list[str], t: str, value: str, order: list[str], least: int, most: int) -> DataFrame:
    """Adds `speed` per second from the row before if its time step is in [least, most], else from the row after."""
    w = Window.partitionBy(*by).orderBy(t, *order)
    step = lambda f: (F.abs(F.col(t) - f(t).over(w)), F.abs(F.col(value) - f(value).over(w)))
    (bt, bv), (at, av) = step(F.lag), step(F.lead)
    return rows.withColumn("speed", F.coalesce(F.when(bt.between(least, most), bv / bt * 1e6), F.when(at.between(least, most), av / at * 1e6)))


def grid(rows: DataFrame, by: list[str], t: str, step: int) -> DataFrame:
    """Times every `step` from each series' first to its last."""
    ends = rows.groupBy(*by).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return ends.select(*by, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias(t))


def clock_offset(rows: DataFrame, stamp: str, log: str, slack: int = 500_000) -> DataFrame:
    """min(log - stamp) over stamped rows, 0 when within `slack`."""
    d = rows.where(F.col(stamp) > 0).agg(F.min(F.col(log) - F.col(stamp)).alias("o"))
    return d.select(F.when(F.abs("o") <= slack, 0).otherwise(F.coalesce("o", F.lit(0))).cast("long").alias("offset"))
