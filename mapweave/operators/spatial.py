"""Neighbour joins and components over points, by cell keys and equi joins; no nested loops.

A radius join keys both sides by cells of that radius, explodes one side to the 27 cells around, joins on the cell and filters by distance. k nearest
neighbours begin with a radius that fits the density and repeat that with a growing one for the places that have not k yet, so the answer is exact for any spread of points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.work import shared_dir

OFFSETS = [-1, 0, 1]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder of spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cells(df: DataFrame, size: float, axes: str = "xyz") -> DataFrame:
    return df.withColumns({f"c{a}": F.floor(F.col(a) / size).cast("long") for a in axes})


def around(df: DataFrame, axes: str = "xyz") -> DataFrame:
    """Each row once per neighbour cell, itself included."""
    for a in axes:
        df = df.withColumn("__d", F.explode(F.array(*[F.lit(o) for o in OFFSETS]))).withColumn(f"c{a}", F.col(f"c{a}") + F.col("__d")).drop("__d")
    return df


def radius_join(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz") -> DataFrame:
    """(id, other, distance) of left and right points within radius, equal ids included."""
    keys = [f"c{a}" for a in axes]
    a = around(cells(left.select("id", *axes), radius, axes), axes)
    b = cells(right.select(F.col("id").alias("other"), *[F.col(x) for x in axes]), radius, axes).select("other", *keys, *[F.col(x).alias(f"o{x}") for x in axes])
    square = sum(((F.col(x) - F.col(f"o{x}")) * (F.col(x) - F.col(f"o{x}")) for x in axes[1:]), (F.col(axes[0]) - F.col(f"o{axes[0]}")) * (F.col(axes[0]) - F.col(f"o{axes[0]}")))
    return a.join(b, keys).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius).select("id", "other", "distance")


def fitting_radius(points: DataFrame, most: float, axes: str, wanted: int) -> float:
    """`most`, or a smaller cell size at which a point shares its cell with no more than about twice `wanted` points (itself included) on average. One count by cell for each size tried; what lies in a line or a plane takes a few more."""
    limit = 2 * wanted
    while True:
        n = cells(points, most, axes).groupBy(*[f"c{a}" for a in axes]).agg(F.count("*").alias("n"))
        share = n.agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("m")).first()["m"]
        if share is None or share <= limit:
            return most
        most *= max((limit / share) ** (1 / len(axes)) * 0.99, 1 / 64)


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float, axes: str = "xyz", skip_self: bool = True, most: float | None = None) -> DataFrame:
    """(id, other, distance, rank): the k nearest others by (distance, id). Places without k within the radius try twice that, up to `most`, or until the radius spans the data; dense clouds begin with less than `radius`, so pairs grow with the points, not with their square.

    Neighbours are looked for once per place: of the others at one place only the first k by id (one more where a point may meet itself) can be among the k nearest of anyone, so copies are not paired with each other."""
    if most is None:
        ends = right.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
        low = left.agg(*[f(a).alias(f"{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
        far = right.agg(*[f(a).alias(f"{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
        if ends[axes[0]] is None or low[f"lo{axes[0]}"] is None:
            most = radius
        else:
            most = sum((max(low[f"hi{a}"], far[f"hi{a}"]) - min(low[f"lo{a}"], far[f"lo{a}"])) ** 2 for a in axes) ** 0.5 + radius
    wanted = k + 1 if skip_self else k
    first = Window.partitionBy(*axes).orderBy("id")
    others = right.where("id is not null").select("id", *axes).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= wanted).drop("__r")
    others = checkpointed(others)
    radius = fitting_radius(others, min(radius, most), axes, wanted)
    out, at = None, checkpointed(left.select(*axes).distinct().withColumn("id", F.struct(*axes)))
    while True:
        w = Window.partitionBy("id").orderBy("distance", "other")
        found = radius_join(at, others, radius, axes).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= wanted)
        near = checkpointed(found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("near")))  # at most `wanted` each
        full = near.where(F.size("near") >= wanted)
        done = near if radius >= most else full
        out = done if out is None else out.unionByName(done)
        if radius >= most:
            break
        at = checkpointed(at.join(full.select("id"), "id", "left_anti"))
        if at.isEmpty():
            break
        radius = min(2 * radius, most)
    d = left.select("id", *axes).join(out.select("id.*", "near"), [*axes])
    own = F.filter("near", lambda p: p["other"] != F.col("id")) if skip_self else F.col("near")
    return d.select("id", F.posexplode(F.slice(own, 1, k)).alias("rank", "p")).select("id", "p.other", "p.distance", (F.col("rank") + 1).alias("rank"))


def mean_distances(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(id, mean): of each point's k nearest others."""
    return nearest(points, points, k, radius).groupBy("id").agg(F.avg("distance").alias("mean"))


def outliers(points: DataFrame, k: int, sigmas: float, radius: float) -> DataFrame:
    """Points whose mean neighbour distance exceeds mean + sigmas * population deviation; none where there are k points or fewer."""
    d = mean_distances(points, k, radius)
    limit = d.agg((F.avg("mean") + sigmas * F.stddev_pop("mean")).alias("limit"), F.count("*").alias("n"))
    return d.join(F.broadcast(limit), F.col("mean") > F.col("limit")).where(F.col("n") > k).select("id", "mean")  # one row


def inliers(points: DataFrame, k: int, sigmas: float, radius: float) -> DataFrame:
    """Points whose mean neighbour distance is at most mean + sigmas * sample deviation; all of them where there are k + 1 points or fewer."""
    if k == 0:
        return points.select("id", F.lit(None).cast("double").alias("mean"))
    d = mean_distances(points, k, radius)
    limit = d.agg((F.avg("mean") + sigmas * F.stddev_samp("mean")).alias("limit"), F.count("*").alias("n"))
    return d.join(F.broadcast(limit), (F.col("mean") <= F.col("limit")) | (F.col("n") <= k + 1)).select("id", "mean")


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component. nodes: node; edges: a, b in either direction.

    Minima of neighbours and pointer jumping, checkpointed each round, so a path of n nodes takes about log n rounds.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = checkpointed(nodes.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        low = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        own = labels.join(low, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = checkpointed(own.join(jump, "new", "left").select("node", F.least("new", "far").alias("label"), "old"))
        if moved.where("label <> old").isEmpty():
            return labels
        labels = moved.drop("old")


def cell_components(points: DataFrame, size: float, axes: str = "xyz") -> tuple[DataFrame, DataFrame]:
    """Components of occupied cells, neighbours by face, edge or corner: (cell keys, label) and the points with their keys. Labels are the smallest cell's (keys as a struct)."""
    keys = [f"c{a}" for a in axes]
    keyed = cells(points, size, axes)
    occupied = checkpointed(keyed.select(*keys).distinct().withColumn("node", F.struct(*keys)))
    near = around(occupied.select(F.col("node").alias("a"), *keys), axes)
    edges = near.join(occupied.select(F.col("node").alias("b"), *keys), keys).where("a <> b").select("a", "b")
    labels = label_components(occupied, edges)
    return labels.select("node.*", "label"), keyed


def floating(points: DataFrame, size: float, least: int, axes: str = "xyz") -> DataFrame:
    """Points in components of fewer than `least` cells; cells are counted, not points."""
    labels, keyed = cell_components(points, size, axes)
    small = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return keyed.join(labels.join(small, "label").drop("label"), [f"c{a}" for a in axes])


def covariance(points: DataFrame, by: list[str], axes: str = "xyz") -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"s{a}{b}") for a, b in pairs])


def normals(points: DataFrame, radius: float, k: int = 24, least: int = 5) -> DataFrame:
    """(id, nx, ny, nz): the direction of least spread of up to k neighbours within radius (the point included), turned upward; zeros for fewer than `least`."""
    near = nearest(points, points, k, radius, skip_self=False, most=radius)
    near = near.join(points.select(F.col("id").alias("other"), "x", "y", "z"), "other")
    cov = covariance(near, ["id"])

    @F.pandas_udf("nx double, ny double, nz double")
    def direction(n: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
        v = np.linalg.eigh(m)[1][:, :, 0]
        v = v * np.where(v[:, 2:] < 0, -1.0, 1.0)
        v[n.to_numpy() < least] = 0
        return pd.DataFrame(v, columns=["nx", "ny", "nz"])

    return cov.select("id", direction("n", "sxx", "sxy", "sxz", "syy", "syz", "szz").alias("d")).select("id", "d.*")
