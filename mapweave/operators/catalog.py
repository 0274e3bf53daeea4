"""Rules over streams, topics and generations: newest wins, overrides, replacement, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.work import written


def newest(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row per key by order, as one aggregate (combined before the shuffle)."""
    d = rows.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"))
    return d.select(*by, *[F.col(f"__v.{c}").alias(c) for c in values])


def generations(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds `age`: 1 for the current generation of a topic, more for superseded ones."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("age", F.row_number().over(w).cast("long"))


def overridden(edges: DataFrame, overrides: DataFrame, by: list[str], channel: str) -> DataFrame:
    """Edges that no override names, or that are on the channel it names."""
    o = overrides.select(*by, F.col(channel).alias("__want"))
    return edges.join(o, by, "left").where(F.col("__want").isNull() | (F.col("__want") == F.col(channel))).drop("__want")


def replaced(rows: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key the new ones do not have, and the new ones."""
    return rows.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def first_free(names: DataFrame, column: str, prefix: str = "v") -> DataFrame:
    """The first of prefix1, prefix2, .. that is not taken. Only numbers up to the count of names + 1 can be it."""
    taken = names.select(F.regexp_extract(column, f"^{prefix}([1-9][0-9]*)$", 1).alias("n")).where("n <> ''").select(F.col("n").cast("long").alias("n")).distinct()
    w = Window.orderBy("n")
    gap = taken.withColumn("at", F.row_number().over(w)).agg(F.min(F.when(F.col("n") != F.col("at"), F.col("at"))).alias("g"), F.count("*").alias("c"))
    return gap.select(F.concat(F.lit(prefix), F.coalesce("g", F.col("c") + 1).cast("string")).alias("name"))


def zipped(left: DataFrame, right: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Joins the n-th row of left with the n-th of right, per key; columns of right get the suffix _tag, and are null where right is shorter."""
    w = Window.partitionBy(*by).orderBy(*order)
    a = left.withColumn("__n", F.row_number().over(w))
    b = right.withColumn("__n", F.row_number().over(w))
    b = b.select(*by, "__n", *[F.col(c).alias(f"{c}_tag") for c in right.columns if c not in by])
    return a.join(b, [*by, "__n"], "left").drop("__n")


def every_nth(rows: DataFrame, by: list[str], order: list[str], every: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w) - 1).where(F.col("__n") % every == 0).drop("__n")


def json_number(props: Column, path: str) -> Column:
    """A JSON number, or a string that holds one."""
    return F.get_json_object(props, path).try_cast("double")


def first_failing(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that fails, in order; null where all pass."""
    out = None
    for name, fails in gates:
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def replayed(log: DataFrame, target: str, order: list[str], removes: Column, restores: Column) -> DataFrame:
    """State per target after an edit log: visible unless its last action removed it."""
    d = log.where(removes | restores).withColumn("__gone", removes)
    return newest(d, [target], order, ["__gone"]).select(target, (~F.col("__gone")).alias("visible"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, root, depth) of a forest of child -> parent edges of any depth, by pointer doubling: a row knows how far up it has come and whether that is a root. Rounds are written once each, so plans do not grow."""
    child = edges.select(F.col("child").alias("node"))
    tops = edges.select(F.col("parent").alias("node")).distinct().join(child, "node", "left_anti")
    first = edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done"))
    known = written(first.unionByName(tops.select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("done"))), "steps")
    there, hops, most = known.where("done"), 1, known.count()
    todo = known.where("not done")
    while True:
        far = todo.unionByName(there).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("end"))
        moved = written(todo.join(far, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done")), "steps")
        there, todo = there.unionByName(moved.where("done")), moved.where("not done")
        if todo.isEmpty():
            return there.select("node", F.col("up").alias("root"), "depth")
        if hops > most:
            raise ValueError("the edges have a cycle")
        hops *= 2
