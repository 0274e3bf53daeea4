"""Axis-aligned boxes: pairs that overlap, groups of them, and the best match of each box in another set.

Boxes (id, x0, y0, z0, x1, y1, z1) meet through the grid cells that they cover; a pair is formed only in the first cell that both cover, so no pair appears twice. Boxes should not be many cells wide: choose the cell about as large as a usual box.
Boxes with a side below zero, or a null, meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import label_components

SIDES = ["x0", "y0", "z0", "x1", "y1", "z1"]


def _covered(boxes: DataFrame, cell: float, by: list[str]) -> DataFrame:
    d = boxes.select("id", *by, *[F.col(c).cast("double").alias(c) for c in SIDES]).where(" and ".join(f"{a}0 <= {a}1" for a in "xyz"))
    for a in "xyz":
        low, high = (F.floor(F.col(f"{a}{k}") / cell).cast("long") for k in (0, 1))
        d = d.withColumn(f"c{a}", F.explode(F.sequence(low, high)))
    return d


def overlaps(left: DataFrame, right: DataFrame, cell: float, margin: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """id, other and both boxes' sides (those of the other as o_...), of pairs that share more than `margin` (or just touch, at 0) along each axis. by: columns that must be equal."""
    by = by or []
    keys = [*by, "cx", "cy", "cz"]
    other = _covered(right, cell, by).select(*keys, F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in SIDES])
    d = _covered(left, cell, by).join(other, keys)
    first = d
    for a in "xyz":
        first = first.where((F.col(f"c{a}") == F.floor(F.greatest(f"{a}0", f"o_{a}0") / cell)) & (F.col(f"{a}0") <= F.col(f"o_{a}1") - margin) & (F.col(f"o_{a}0") <= F.col(f"{a}1") - margin))
    return first.drop("cx", "cy", "cz")


def groups(boxes: DataFrame, cell: float, margin: float = 0.01, by: list[str] | None = None, least: float = 0.0, most: float | None = None) -> DataFrame:
    """Per group of boxes that overlap, directly or through others: the smallest id (label), parts, and the sides around them all; groups with a volume below `least`, or that reach beyond `most` from the origin, are left out."""
    by = by or []
    pairs = overlaps(boxes, boxes, cell, margin, by).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    labels = label_components(boxes.select(F.col("id").alias("node")), pairs).withColumnRenamed("node", "id")
    lows, highs = [F.min(f"{a}0").alias(f"{a}0") for a in "xyz"], [F.max(f"{a}1").alias(f"{a}1") for a in "xyz"]
    d = boxes.select("id", *by, *SIDES).join(labels, "id").groupBy(*by, "label").agg(F.count("*").alias("parts"), *lows, *highs)
    d = d.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0")) >= least)
    return d if most is None else d.where(F.greatest(*[F.abs(c) for c in SIDES]) <= most)


def shared(a: str = "", b: str = "o_") -> Column:
    """Intersection over union of the two boxes of a row."""
    side = lambda p, x: F.col(f"{p}{x}1") - F.col(f"{p}{x}0")
    both = lambda x: F.greatest(F.least(f"{a}{x}1", f"{b}{x}1") - F.greatest(f"{a}{x}0", f"{b}{x}0"), F.lit(0.0))
    inside = both("x") * both("y") * both("z")
    either = side(a, "x") * side(a, "y") * side(a, "z") + side(b, "x") * side(b, "y") * side(b, "z") - inside
    return F.when(either > 0, inside / either).otherwise(0.0)


def best_match(truth: DataFrame, found: DataFrame, cell: float) -> DataFrame:
    """Per truth box the found one with the highest intersection over union (the smaller id of equals) and that; 0 and null where none overlaps."""
    pairs = overlaps(truth, found, cell).select("id", "other", F.round(shared(), 12).alias("iou")).where("iou > 0")
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("iou"), "other"))).where("r = 1")
    return truth.select("id").join(best.select("id", "other", "iou"), "id", "left").select("id", "other", F.coalesce("iou", F.lit(0.0)).alias("iou"))
