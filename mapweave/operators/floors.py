"""Columns of voxels, floors and flood fills on raster cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import around, checkpointed, label_components


def neighbour_counts(voxels: DataFrame) -> DataFrame:
    """Adds `near`: how many of the 3 x 3 columns around hold a voxel at the same layer (itself counts)."""
    keys = ["cx", "cy", "layer"]
    v = voxels.select(*keys).distinct()
    near = around(v.select("layer", "cx", "cy"), "xy").groupBy(*keys).agg(F.count("*").alias("near"))
    return v.join(near, keys)


def top_surfaces(voxels: DataFrame, full: int = 7, above: int = 3) -> DataFrame:
    """Per column the highest layer with at least `full` of 3 x 3 occupied and at most `above` occupied layers over it."""
    d = neighbour_counts(voxels)
    over = Window.partitionBy("cx", "cy").orderBy(F.desc("layer"))
    d = d.withColumn("over", F.row_number().over(over) - 1)
    return d.where((F.col("near") >= full) & (F.col("over") <= above)).groupBy("cx", "cy").agg(F.max("layer").alias("layer"))


def column_floors(voxels: DataFrame, low: int, high: int, least: int = 5) -> DataFrame:
    """Per column the highest layer in [low, high] that has at least `least` of 3 x 3."""
    d = neighbour_counts(voxels).where(F.col("layer").between(low, high) & (F.col("near") >= least))
    return d.groupBy("cx", "cy").agg(F.max("layer").alias("layer"))


def column_heights(points: DataFrame, least: int = 3) -> DataFrame:
    """Per column the lowest layer whose count with the next adjacent layer is at least `least`, and the mean z of the two. points: cx, cy, layer, z."""
    g = points.groupBy("cx", "cy", "layer").agg(F.count("*").alias("n"), F.sum("z").alias("s"))
    w = Window.partitionBy("cx", "cy").orderBy("layer")
    follows = F.lead("layer").over(w) == F.col("layer") + 1
    d = g.withColumns({"nn": F.col("n") + F.when(follows, F.lead("n").over(w)).otherwise(0), "ss": F.col("s") + F.when(follows, F.lead("s").over(w)).otherwise(0.0)})
    best = d.where(F.col("nn") >= least).groupBy("cx", "cy").agg(F.min(F.struct("layer", "nn", "ss")).alias("b"))
    return best.select("cx", "cy", (F.col("b.ss") / F.col("b.nn")).alias("height"))


def flooded(cells: DataFrame, level: float, seed: float = 0.1, step: float = 0.25) -> DataFrame:
    """Cells (cx, cy, height) that are reached from seeds within `seed` of the level over 4-neighbours whose heights differ by at most `step`."""
    c = checkpointed(cells.select("cx", "cy", "height").withColumn("node", F.struct("cx", "cy")))
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1))])
    to = c.select(F.col("node").alias("a"), F.col("height").alias("ha"), "cx", "cy", F.explode(moves).alias("m"))
    to = to.select("a", "ha", (F.col("cx") + F.col("m.dx")).alias("cx"), (F.col("cy") + F.col("m.dy")).alias("cy"))
    edges = to.join(c.select(F.col("node").alias("b"), F.col("height").alias("hb"), "cx", "cy"), ["cx", "cy"]).where(F.abs(F.col("ha") - F.col("hb")) <= step).select("a", "b")
    labels = label_components(c, edges)
    d = c.join(labels, "node")
    good = d.where(F.abs(F.col("height") - level) <= seed).select("label").distinct()
    return d.join(good, "label", "left_semi").select("cx", "cy", "height")


def filled(cells: DataFrame, width: int, height: int, passes: int) -> DataFrame:
    """Cells of the grid with holes filled by the mean of known 8-neighbours, pass after pass, each from the one before only; measured tells which were known."""
    known = checkpointed(cells.select("cx", "cy", F.col("height").cast("double").alias("height"), F.lit(True).alias("measured")))
    for _ in range(passes):
        spread = around(known.select("cx", "cy", "height"), "xy").groupBy("cx", "cy").agg(F.avg("height").alias("height"))
        inside = spread.where(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1))
        new = inside.join(known.select("cx", "cy"), ["cx", "cy"], "left_anti").withColumn("measured", F.lit(False))
        known = checkpointed(known.unionByName(new))
    return known


def bands(levels: list[float]) -> list[tuple[float, float]]:
    """The heights that belong to each storey."""
    return [(h - (0.6 if i == 0 else 0.25), levels[i + 1] - 0.25 if i + 1 < len(levels) else h + 1.5) for i, h in enumerate(levels)]


def storey_at(levels: list[float], z: float) -> float | None:
    """The last level at most half a metre above z."""
    under = [h for h in levels if h <= z + 0.5]
    return max(under) if under else None


def height_at(points: DataFrame, cells: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """Adds floor_z: bilinear over the known ones of the four cell centers around."""
    gx, gy = (F.col("x") - x0) / cell - 0.5, (F.col("y") - y0) / cell - 0.5
    d = points.withColumns({"gx": gx, "gy": gy})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    d = d.select("*", corner.alias("k")).withColumns({"cx": (F.floor("gx") + F.col("k.i")).cast("long"), "cy": (F.floor("gy") + F.col("k.j")).cast("long")})
    weight = (1 - F.abs(F.col("gx") - F.col("cx"))) * (1 - F.abs(F.col("gy") - F.col("cy")))
    d = d.join(cells.select("cx", "cy", "height"), ["cx", "cy"]).withColumn("w", weight)
    s = d.groupBy("id").agg(F.sum(F.col("w") * F.col("height")).alias("s"), F.sum("w").alias("w"))
    return points.join(s.where("w > 1e-6").select("id", (F.col("s") / F.col("w")).alias("floor_z")), "id", "left")
