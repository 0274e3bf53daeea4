"""The transform tree: edge statistics, paths through the frame graph, timed lookups, and placing scans.

The frame graph has as many edges as a recording has frames (tens), so it lives on the driver; samples and probes stay distributed: all edges of a path are looked up at once over range-sorted runs, so no task sees a whole series.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.geometry import compose, invert, let, place, quaternion, slerp
from mapweave.functions.work import written

from .temporal import ranged_bracket

POSE = "struct<t: struct<x: double, y: double, z: double>, q: struct<x: double, y: double, z: double, w: double>>"
_IDENTITY = "named_struct('t', named_struct('x', 0D, 'y', 0D, 'z', 0D), 'q', named_struct('x', 0D, 'y', 0D, 'z', 0D, 'w', 1D))"
#: Times are long microseconds; a constant edge's samples agree within this.
SAME = 1e-6


def distinct_samples(tf: DataFrame) -> DataFrame:
    """tf (parent, child, t, seq, pose): of samples of one edge and time the first by seq."""
    w = Window.partitionBy("parent", "child", "t").orderBy("seq")
    return tf.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def edges(tf: DataFrame) -> DataFrame:
    """parent, child, samples, first, last, fixed (all poses agree)."""
    spread = [F.max(F.col(f"pose.{a}.{b}")) - F.min(F.col(f"pose.{a}.{b}")) for a, n in (("t", "xyz"), ("q", "xyzw")) for b in n]
    agg = distinct_samples(tf).groupBy("parent", "child").agg(F.count("*").alias("samples"), F.min("t").alias("first"), F.max("t").alias("last"), F.greatest(*spread).alias("__s"))
    return agg.withColumn("fixed", (F.col("samples") == 1) | (F.col("__s") <= SAME)).drop("__s")


def path(known: list[tuple[str, str]], target: str, source: str) -> list[tuple[str, str, bool]] | None:
    """Edges (parent, child, inverted) that lead from target down to source over an undirected graph, fewest first; None without a way."""
    near: dict[str, list[tuple[str, tuple[str, str, bool]]]] = {}
    for parent, child in sorted(known):
        near.setdefault(parent, []).append((child, (parent, child, False)))
        near.setdefault(child, []).append((parent, (parent, child, True)))
    seen, queue = {target: []}, deque([target])
    while queue:
        at = queue.popleft()
        if at == source:
            return seen[at]
        for to, step in near.get(at, []):
            if to not in seen:
                seen[to] = [*seen[at], step]
                queue.append(to)
    return None


def root_of(known: list[tuple[str, str]], frame: str) -> tuple[str, int]:
    """The topmost ancestor and the depth under it; a cycle stops where it closes."""
    up, depth, seen = {c: p for p, c in sorted(known, reverse=True)}, 0, {frame}
    while frame in up and up[frame] not in seen:
        frame, depth = up[frame], depth + 1
        seen.add(frame)
    return frame, depth


def edge_poses(times: DataFrame, samples: DataFrame, tolerance: int) -> DataFrame:
    """step, t and the pose of that step's edge: interpolated, held up to `tolerance` past either end, else null. A constant edge always answers. times: step, t. samples: step, t, seq, pose. No window holds a whole series."""
    d = ranged_bracket(times, samples, ["step"], "t", "pose", "seq")
    fixed = edges(samples.withColumns({"parent": F.col("step"), "child": F.col("step")})).select(F.col("parent").alias("step"), F.col("fixed").alias("__f"))
    d = d.join(F.broadcast(fixed), "step", "left")  # a row per edge of a path
    u = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    a, b = F.col("v0"), F.col("v1")
    mid = F.struct(F.struct(*[(a["t"][c] + (b["t"][c] - a["t"][c]) * u).alias(c) for c in "xyz"]).alias("t"), slerp(quaternion(a["q"]), quaternion(b["q"]), u).alias("q")).cast(POSE)
    end = lambda c: F.struct(c["t"].alias("t"), quaternion(c["q"]).alias("q")).cast(POSE)
    got = (
        F.when(F.col("__f"), F.coalesce(F.when(a.isNotNull(), end(a)), F.when(b.isNotNull(), end(b))))
        .when(F.col("t0") == F.col("t1"), end(a))
        .when(a.isNotNull() & b.isNotNull(), mid)
        .when(a.isNull() & (F.col("t1") - F.col("t") <= tolerance), end(b))
        .when(b.isNull() & (F.col("t") - F.col("t0") <= tolerance), end(a))
    )
    return d.select("step", "t", got.alias("pose"))


def poses_at(times: DataFrame, tf: DataFrame, target: str, source: str, tolerance: int, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """t and the pose of source in target at each distinct time; times where any edge does not answer are left out, and all of them where there is no way. All edges of the way are looked up at once."""
    if known is None:
        known = [(r["parent"], r["child"]) for r in tf.select("parent", "child").distinct().collect()]  # the frame graph: tens of edges
    steps = path(known, target, source)
    times = times.select("t").where("t is not null").distinct()
    if steps is None:
        return times.limit(0).withColumn("pose", F.lit(None).cast(POSE))
    if not steps:
        return times.withColumn("pose", F.expr(_IDENTITY).cast(POSE))
    number = F.lit(None).cast("int")
    for i, (parent, child, _) in enumerate(steps):
        number = F.when((F.col("parent") == parent) & (F.col("child") == child), F.lit(i)).otherwise(number)
    samples = tf.withColumn("step", number).where("step is not null").select("step", "t", "seq", "pose")
    asked = times.select(F.explode(F.array(*[F.lit(i) for i in range(len(steps))])).alias("step"), "t")
    at = edge_poses(asked, samples, tolerance).where("pose is not null")
    each = at.groupBy("t").agg(*[F.max(F.when(F.col("step") == i, F.col("pose"))).alias(f"s{i}") for i in range(len(steps))])
    d = each.where(" and ".join(f"s{i} is not null" for i in range(len(steps))))
    turned = [invert(F.col(f"s{i}.t"), F.col(f"s{i}.q")).cast(POSE) if inverted else F.col(f"s{i}") for i, (_, _, inverted) in enumerate(steps)]
    pose = turned[0]
    for step in turned[1:]:
        pose = let(F.struct(pose.alias("a"), step.alias("b")), lambda s: compose(s["a"]["t"], s["a"]["q"], s["b"]["t"], s["b"]["q"])).cast(POSE)
    return d.select("t", pose.alias("pose"))


def lookup(probes: DataFrame, tf: DataFrame, target: str, source: str, tolerance: int, name: str = "pose") -> DataFrame:
    """Adds the pose of source in target at each probe's t; null where any edge does not answer or there is no way. Probes of one time share its lookup."""
    return probes.join(poses_at(probes, tf, target, source, tolerance).withColumnRenamed("pose", name), "t", "left").select(*probes.columns, name)


def placed(points: DataFrame, pose: str = "pose") -> DataFrame:
    """Points with x, y, z moved by their pose column; rows without a pose go. Results are 32-bit."""
    args = F.struct(F.col(pose).alias("m"), F.struct(*[F.col(c).cast("double").alias(c) for c in "xyz"]).alias("p"))
    d = points.where(F.col(pose).isNotNull()).withColumn("__m", let(args, lambda s: place(s["m"]["t"], s["m"]["q"], s["p"])))
    return d.withColumns({c: F.col(f"__m.{c}").cast("float") for c in "xyz"}).drop("__m")


def first_pose(*candidates: str) -> Column:
    """Stamp lookup, else log-time lookup, else stored pose, else the identity."""
    return F.coalesce(*[F.col(c) for c in candidates], F.expr(_IDENTITY))


def deskewed(points: DataFrame, motion: DataFrame, tolerance: int) -> DataFrame:
    """Each point (t, end, x, y, z) as seen at its scan's end: through the motion's pose at t, back through its pose at `end`. motion: t, seq, pose. Times are looked up once each, all in one pass."""
    times = points.select("t").unionByName(points.select(F.col("end").alias("t"))).where("t is not null").distinct()
    at = edge_poses(times.withColumn("step", F.lit(0)), motion.select(F.lit(0).alias("step"), "t", "seq", "pose"), tolerance).where("pose is not null")
    at = written(at.select("t", "pose"), "motion")
    d = points.join(at.withColumnRenamed("pose", "__at"), "t").join(at.select(F.col("t").alias("end"), F.col("pose").alias("__end")), "end")
    back = let(invert(F.col("__end.t"), F.col("__end.q")), lambda b: compose(b["t"], b["q"], F.col("__at.t"), F.col("__at.q")))
    return placed(d.withColumn("__pose", back.cast(POSE)), "__pose").select(*points.columns)
