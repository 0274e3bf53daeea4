"""Straightening walls: one straight slab per stroke, fitted to the wall voxels that the stroke's band holds.

All strokes are done at once, keyed by `wall`: points meet the strokes whose band they are near by cells of a metre, and every step is a grouping, a window within a wall or a join on voxel columns. A line is fitted (`trimmed_axis`),
its thickness and middle are measured (`cores`), it is fitted again on the wall around it; heights come from bins a voxel long (`stretches`, `doorways`, `extents`), the slab from samples half a voxel apart; what stands beside the slab goes, unless it carries on past the
band's side (`carrying_on`). Only voxels whose column is in the band are removed or added.

Windows are over a wall's columns or bins, never over its points: the closest points are cut off by ranges (`picks.first_rows`). Tables of a row per wall are written before points are joined with them, so that their size is known and they are sent to the points:
else few walls mean few tasks, as AQE sends no table that leaves most partitions empty. Ties: equal distances to a line by id, equally full bins by the nearer to the line, then the lower one. Distances that decide an order are compared at 1e-9, and a
column center on the band's edge is inside.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions import geometry as G
from mapweave.functions.picks import first_rows
from mapweave.functions.work import written

from .profiles import profiles
from .spatial import around

#: Read this far around a band; tolerance at its edge; how far past the side something must carry on.
MARGIN, EDGE, PAST = 0.5, 1e-6, 0.15
#: Degrees: a line this near an axis is that axis (short strokes: the second); a fit further than the third from its stroke is overruled.
SNAP, SNAP_SHORT, OVERRULED = 2.0, 10.0, 20.0
STROKE = ["wall", "from_x", "from_y", "to_x", "to_y", "width", "thickness", "bottom", "top", "above_floor"]


def along(x: Column | str, y: Column | str) -> Column:
    """Along the line of the row: ox, oy, dx, dy."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return (x - F.col("ox")) * F.col("dx") + (y - F.col("oy")) * F.col("dy")


def across(x: Column | str, y: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return (y - F.col("oy")) * F.col("dx") - (x - F.col("ox")) * F.col("dy")


def at(t: Column, d: Column) -> tuple[Column, Column]:
    return F.col("ox") + F.col("dx") * t - F.col("dy") * d, F.col("oy") + F.col("dy") * t + F.col("dx") * d


def _axis(d: DataFrame, by: list[str]) -> DataFrame:
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.var_pop("x").alias("sxx"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("y").alias("syy"))
    angle = 0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))
    half, root = (F.col("sxx") + F.col("syy")) / 2, F.sqrt(F.pow((F.col("sxx") - F.col("syy")) / 2, 2) + F.pow("sxy", 2))
    small = F.greatest(half - root, F.lit(1e-9) / F.col("n"))
    return s.select(*by, "n", "ox", "oy", F.cos(angle).alias("dx"), F.sin(angle).alias("dy"), ((half + root) / small).alias("ratio"))


def trimmed_axis(points: DataFrame, by: list[str], rounds: int = 2, least: int = 4) -> DataFrame:
    """Per group the principal axis of x, y: mean (ox, oy), direction (dx, dy), ratio of the spreads, n points of the last fit; fitted again `rounds` times on the closest n * 6 div 10 (`least` at least) of all. points: by, id, x, y."""
    axis = _axis(points, by)
    for _ in range(rounds):
        near = points.join(written(axis.select(*by, "ox", "oy", "dx", "dy"), "axes"), by).withColumn("off", F.round(F.abs(across("x", "y")), 9)).select(*by, "id", "x", "y", "off")
        axis = _axis(first_rows(near, by, ["off", "id"], F.greatest(F.expr("n * 6 div 10"), F.lit(least))), by)
    return axis


def cores(offsets: DataFrame, by: list[str], voxel: float, stretch: float = 0.1, least: int = 3) -> DataFrame:
    """Per group, over its stretches: medians of the width (bins of a voxel) and of the middle of the run of bins around the fullest that have at least half its count. Stretches whose fullest has less than `least` are left out. offsets: by, t (along), d (across)."""
    h = offsets.groupBy(*by, F.floor(F.col("t") / stretch).alias("stretch"), F.floor(F.col("d") / voxel).alias("bin")).agg(F.count("*").alias("n"))
    one = Window.partitionBy(*by, "stretch")
    full = h.withColumn("peak", F.max(F.struct("n", -F.abs("bin"), -F.col("bin"))).over(one)).withColumn("peak_bin", -F.col("peak.col3")).where((F.col("peak.n") >= least) & (2 * F.col("n") >= F.col("peak.n")))
    runs = full.withColumn("run", F.col("bin") - F.row_number().over(one.orderBy("bin")))
    runs = runs.groupBy(*by, "stretch", "run").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.bool_or(F.col("bin") == F.col("peak_bin")).alias("its")).where("its")
    middle = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))  # noqa: E731  as many as stretches
    return runs.groupBy(*by).agg(middle(F.col("high") - F.col("low") + 1).alias("thick"), middle((F.col("low") + F.col("high") + 1) / 2 * voxel).alias("middle"))


def _snapped(dx: Column, dy: Column, degrees: Column) -> Column:
    """The direction, or the axis that it is nearer to than so many degrees."""
    c, d = F.cos(F.radians(degrees)), lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    return F.when(dx > c, d(1.0, 0.0)).when(dy > c, d(0.0, 1.0)).when(-dx > c, d(-1.0, 0.0)).when(-dy > c, d(0.0, -1.0)).otherwise(F.struct(dx.alias("x"), dy.alias("y")))


def lines(points: DataFrame, hints: DataFrame, voxel: float) -> DataFrame:
    """wall, ox, oy, dx, dy, half, forced: a line per wall with at least four points, along its fitted axis turned the hint's way, or along the hint's direction where that is `forced` (null: where the fit is too far off it). points: wall, id, x, y. hints: wall, hx, hy, snap, thickness, forced."""
    axis = trimmed_axis(points, ["wall"]).join(points.groupBy("wall").agg(F.count("*").alias("all"), F.avg("x").alias("mx"), F.avg("y").alias("my")), "wall").where(F.col("all") >= 4).join(hints, "wall")
    turned = F.when(F.col("dx") * F.col("hx") + F.col("dy") * F.col("hy") < 0, -1.0).otherwise(1.0)
    d = axis.withColumn("fitted", _snapped(F.col("dx") * turned, F.col("dy") * turned, F.col("snap")))
    off = F.abs(F.col("fitted.x") * F.col("hx") + F.col("fitted.y") * F.col("hy")) < math.cos(math.radians(OVERRULED))
    d = d.withColumn("forced", F.coalesce("forced", off))
    way = F.when(F.col("forced"), _snapped(F.col("hx"), F.col("hy"), F.lit(SNAP_SHORT))).otherwise(F.col("fitted"))
    d = d.select("wall", "forced", "thickness", F.when(F.col("forced"), F.col("mx")).otherwise(F.col("ox")).alias("ox"), F.when(F.col("forced"), F.col("my")).otherwise(F.col("oy")).alias("oy"), way.alias("way"))
    # along an axis bins begin at a voxel's side
    side = lambda c, other: F.when(F.abs(F.col(f"way.{other}")) > 0.99, F.floor(F.col(c) / voxel) * voxel).otherwise(F.col(c)).alias(c)
    d = written(d.select("wall", "forced", "thickness", side("ox", "y"), side("oy", "x"), F.col("way.x").alias("dx"), F.col("way.y").alias("dy")), "lines")
    offsets = points.join(d, "wall").select("wall", along("x", "y").alias("t"), across("x", "y").alias("d"))
    d = d.join(cores(offsets, ["wall"], voxel), "wall", "left")
    thick = F.when(F.col("thickness").isNotNull(), F.greatest(F.floor(F.col("thickness") / voxel + 0.5), F.lit(1))).otherwise(F.greatest(F.coalesce("thick", F.lit(1)), F.lit(1)))
    x, y = at(F.lit(0.0), F.coalesce("middle", F.lit(0.0)))
    d = d.select("wall", "forced", x.alias("ox"), y.alias("oy"), "dx", "dy", thick.alias("thick"))
    shift = F.when(F.col("thick") % 2 == 1, 0.5).otherwise(0.0)
    grid = lambda c, other: F.when((F.abs(other) > 0.99) & ~F.col("forced"), (F.floor(F.col(c) / voxel - shift + 0.5) + shift) * voxel).otherwise(F.col(c)).alias(c)
    return d.select("wall", grid("ox", F.col("dy")), grid("oy", F.col("dx")), "dx", "dy", (F.col("thick") * voxel / 2).alias("half"), "forced")


def _drawn(strokes: DataFrame) -> DataFrame:
    """Strokes as lines: ox, oy, dx, dy, length, half."""
    x, y = F.col("to_x") - F.col("from_x"), F.col("to_y") - F.col("from_y")
    d = strokes.select(*STROKE).withColumn("length", F.hypot(x, y))
    return d.select("*", F.col("from_x").alias("ox"), F.col("from_y").alias("oy"), (x / F.col("length")).alias("dx"), (y / F.col("length")).alias("dy"), (F.col("width") / 2).alias("half"))


def _in_band(x: Column, y: Column, margin: float = 0.0) -> Column:
    """Inside the drawn band of the row (a stroke joined to it), or a margin around it."""
    return along(x, y).between(-margin - EDGE, F.col("length") + margin + EDGE) & (F.abs(across(x, y)) <= F.col("half") + margin + EDGE)


def _center(key: str, voxel: float) -> Column:
    return (F.col(key) + 0.5) * voxel


def near_points(points: DataFrame, strokes: DataFrame, voxel: float) -> DataFrame:
    """wall, id, x, y, z, kx, ky, kz of the points in each stroke's band and the margin around it; selected: the voxel's column is in the band. Points meet strokes by cells of a metre."""
    s = _drawn(strokes)
    step = lambda n: F.sequence(F.lit(0), F.ceil(n).cast("int"))
    cells = s.select("*", F.explode(step(F.col("length") + 2 * MARGIN)).alias("i")).select("*", F.explode(step(F.col("width") + 2 * MARGIN)).alias("j"))
    x, y = at(F.col("i") - MARGIN, F.col("j") - F.col("half") - MARGIN)
    beside = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    cells = cells.select("wall", F.floor(x).alias("gx"), F.floor(y).alias("gy"), beside.alias("by")).select("wall", (F.col("gx") + F.col("by.i")).alias("gx"), (F.col("gy") + F.col("by.j")).alias("gy")).distinct()
    cells = written(cells, "cells")
    p = points.select("id", *[F.col(a).cast("double").alias(a) for a in "xyz"], *[G.voxel_key(F.col(a), voxel).alias(f"k{a}") for a in "xyz"])
    d = p.withColumns({"gx": F.floor("x"), "gy": F.floor("y")}).join(cells, ["gx", "gy"]).join(s, "wall").where(_in_band(F.col("x"), F.col("y"), MARGIN))
    return d.select("wall", "id", "x", "y", "z", "kx", "ky", "kz", _in_band(_center("kx", voxel), _center("ky", voxel)).alias("selected"))


def column_floors(columns: DataFrame, near: DataFrame, voxel: float, floor_of: Callable[[DataFrame], DataFrame], reach: float = 0.3) -> DataFrame:
    """Adds floor: the highest layer within `reach` of the estimate where at least 7 of the 3 x 3 columns around are occupied outside the band, and at most 3 one layer up; else the estimate; null where there is none. columns: wall, kx, ky. floor_of adds floor_z to rows of id, x, y."""
    named = columns.select("wall", "kx", "ky", F.struct("wall", "kx", "ky").alias("id"), _center("kx", voxel).alias("x"), _center("ky", voxel).alias("y"))
    estimate = floor_of(named).select("wall", "kx", "ky", "floor_z")
    v = near.where(~F.col("selected")).select("wall", F.col("kx").alias("cx"), F.col("ky").alias("cy"), F.col("kz").alias("layer")).distinct()
    count = around(v, "xy").groupBy("wall", "cx", "cy", "layer").agg(F.count("*").alias("near"))
    up = Window.partitionBy("wall", "cx", "cy").orderBy("layer")
    above = F.when(F.lead("layer").over(up) == F.col("layer") + 1, F.lead("near").over(up)).otherwise(0)
    flat = count.withColumn("above", above).where((F.col("near") >= 7) & (F.col("above") <= 3)).select("wall", F.col("cx").alias("kx"), F.col("cy").alias("ky"), "layer")
    low, high = (F.floor((F.col("floor_z") + r) / voxel) for r in (-reach, reach))
    best = estimate.join(flat, ["wall", "kx", "ky"]).where(F.col("layer").between(low, high)).groupBy("wall", "kx", "ky").agg(F.max("layer").alias("layer"))
    return estimate.join(best, ["wall", "kx", "ky"], "left").select("wall", "kx", "ky", F.when(F.col("layer").isNotNull(), _center("layer", voxel)).otherwise(F.col("floor_z")).alias("floor"))


def wall_points(near: DataFrame, strokes: DataFrame, floors: DataFrame, voxel: float) -> DataFrame:
    """The points at wall height: over their column's floor, under the reach, and not the top layer of the floor itself (5 of 3 x 3 at most a voxel and a half over it, at most 3 one layer up)."""
    v = near.select("wall", F.col("kx").alias("cx"), F.col("ky").alias("cy"), F.col("kz").alias("layer")).distinct()
    count = around(v, "xy").groupBy("wall", "cx", "cy", "layer").agg(F.count("*").alias("spread"))
    count = count.select("wall", F.col("cx").alias("kx"), F.col("cy").alias("ky"), F.col("layer").alias("kz"), "spread")
    over = count.select("wall", "kx", "ky", (F.col("kz") - 1).alias("kz"), F.col("spread").alias("spread_over"))
    d = near.join(floors, ["wall", "kx", "ky"]).join(strokes.select("wall", "bottom", "top", "above_floor"), "wall").join(count, ["wall", "kx", "ky", "kz"]).join(over, ["wall", "kx", "ky", "kz"], "left")
    top = F.when(F.col("above_floor").isNotNull(), F.col("floor") + F.col("above_floor"))
    under = (F.col("top").isNull() | (F.col("z") <= F.col("top"))) & (top.isNull() | (F.col("z") <= top))
    layer = (F.col("z") <= F.col("floor") + 1.5 * voxel) & (F.col("spread") >= 5) & (F.coalesce("spread_over", F.lit(0)) <= 3)
    good = (F.col("bottom").isNull() | (F.col("z") >= F.col("bottom"))) & (F.col("z") > F.col("floor") + 0.5 * voxel) & under & ~layer
    return d.where(good).select(*near.columns)


# ---- heights along a wall ----


def doorways(stretches: DataFrame, voxel: float, least: float = 0.6, high: float = 0.5) -> DataFrame:
    """wall, first, last: runs of open bins inside a wall, at least `least` long. A bin is open if it holds nothing or begins more than `high` over where the wall usually starts (the lower quartile of all bins' lows, or its own bottom if that is higher). stretches: wall, bin, bottom, low, high, with a row for every bin."""
    d = profiles(stretches, voxel, least, high).where(F.col("bin") == F.col("first"))
    return d.select("wall", *[F.col(c).cast(stretches.schema["bin"].dataType).alias(c) for c in ("first", "last")])


def extents(stretches: DataFrame, voxel: float) -> DataFrame:
    """wall, bin, bottom, top of the slab: from the bin's own bottom, or the median one around, to the median high around; in a doorway from the median low of its bins. A bin without takes the nearest one's, the lower first. stretches: wall, bin, bottom, low, high, with a row for every bin; bottom is null where no floor is known."""
    return profiles(stretches, voxel, 0.6, 0.5).where("bottom is not null").select("wall", "bin", "bottom", "top")


def additions(heights: DataFrame, held: DataFrame) -> DataFrame:
    """wall, bin, k: the layers of each bin's slab that are not held. heights: wall, bin, bottom, top. held: wall, bin, k. A bin's held layers travel as one array, so the slab's layers are not dealt."""
    layers = held.groupBy("wall", "bin").agg(F.collect_set("k").alias("held"))
    d = heights.where("bottom <= top").join(layers, ["wall", "bin"], "left").withColumn("k", F.sequence("bottom", "top"))
    return d.select("wall", "bin", F.explode(F.when(F.col("held").isNull(), F.col("k")).otherwise(F.array_except("k", "held"))).alias("k"))


# ---- what carries on past the band ----


def carrying_on(columns: DataFrame, full: DataFrame, strokes: DataFrame, voxel: float) -> DataFrame:
    """Those of `columns` (wall, kx, ky) that are full and from which a ray outward, straight or turned by 15, 30 or 45 degrees either way, meets full columns in four of five samples of the 15 cm past the band's side."""
    s = _drawn(strokes).select("wall", "ox", "oy", "dx", "dy", "half")
    p = columns.join(full, ["wall", "kx", "ky"], "left_semi").join(s, "wall").select("*", across(_center("kx", voxel), _center("ky", voxel)).alias("d"))
    p = p.select("*", F.when(F.col("d") >= 0, 1.0).otherwise(-1.0).alias("side"), F.explode(F.array(*[F.lit(math.radians(15 * k)) for k in range(-3, 4)])).alias("angle"))
    # a step of half a voxel along the ray is `rise` away from the line
    rise = F.cos("angle") * voxel / 2
    left = F.col("half") - F.col("d") * F.col("side")
    first, last = F.greatest(F.floor(F.round(left / rise, 9)) + 1, F.lit(1)), F.least(F.floor(F.round((left + PAST) / rise, 9)), F.lit(400))
    p = p.select("*", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))).alias("k"))
    out_x, out_y = -F.col("dy") * F.col("side"), F.col("dx") * F.col("side")
    go = F.col("k") * voxel / 2
    x = _center("kx", voxel) + (out_x * F.cos("angle") - out_y * F.sin("angle")) * go
    y = _center("ky", voxel) + (out_x * F.sin("angle") + out_y * F.cos("angle")) * go
    hits = full.select("wall", F.col("kx").alias("qx"), F.col("ky").alias("qy"), F.lit(1).alias("hit"))
    d = p.select("wall", "kx", "ky", "angle", F.floor(F.round(x / voxel, 9)).alias("qx"), F.floor(F.round(y / voxel, 9)).alias("qy")).join(hits, ["wall", "qx", "qy"], "left")
    rays = d.groupBy("wall", "kx", "ky", "angle").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return rays.where("hits * 5 >= n * 4").select("wall", "kx", "ky").distinct()


def straighten(points: DataFrame, strokes: DataFrame, voxel: float, floor_of: float | Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The points to remove (wall, id) and the voxels to add (wall, x, y, z, nx, ny, nz).

    points: id, x, y, z. strokes: wall, from_x, from_y, to_x, to_y, width and, or null, thickness, bottom, top and above_floor (nothing under bottom, over top, or over that height above the floor is touched). floor_of: a height, or what adds floor_z
    to rows of id, x, y (`floors.height_at`). A wall with fewer than eight voxels in its band, or a stroke shorter than a voxel, changes nothing."""
    if not callable(floor_of):
        level = float(floor_of)
        floor_of = lambda d: d.withColumn("floor_z", F.lit(level))
    strokes = written(_drawn(strokes).where(F.col("length") >= voxel).select(*STROKE, "length"), "strokes")
    near = written(near_points(points, strokes, voxel), "near")
    columns = near.select("wall", "kx", "ky").distinct()
    walls = written(wall_points(near, strokes, column_floors(columns, near, voxel, floor_of), voxel), "wallish")
    # 1. the line, from the band's voxels, then from the wall around it
    hint = walls.where("selected")
    enough = written(hint.groupBy("wall").count().where("count >= 8").select("wall"), "enough")
    drawn = _drawn(strokes).join(enough, "wall", "left_semi")
    snap = F.when(F.col("length") < 1.5, SNAP_SHORT).otherwise(SNAP)
    hints = drawn.select("wall", F.col("dx").alias("hx"), F.col("dy").alias("hy"), snap.alias("snap"), "thickness", F.when(F.col("length") < 1.0, F.lit(True)).alias("forced"))
    first = written(lines(hint.select("wall", "id", "x", "y").join(enough, "wall", "left_semi"), hints, voxel), "first-lines")

    def span(line: DataFrame) -> DataFrame:
        a, b = along("from_x", "from_y"), along("to_x", "to_y")
        return line.join(strokes.select("wall", "from_x", "from_y", "to_x", "to_y", "width"), "wall").withColumns({"start": F.least(a, b), "end": F.greatest(a, b)})

    t, d = along("x", "y"), across("x", "y")
    around_it = walls.join(written(span(first), "spans"), "wall").where(t.between(F.col("start") - MARGIN, F.col("end") + MARGIN) & (F.abs(d) <= F.col("half") + 2 * voxel))
    again = hints.drop("hx", "hy", "forced").join(first.select("wall", F.col("dx").alias("hx"), F.col("dy").alias("hy"), "forced"), "wall")
    second = lines(around_it.select("wall", "id", "x", "y"), again, voxel)
    names = ["ox", "oy", "dx", "dy", "half"]
    both = first.select("wall", F.struct(*names).alias("a")).join(second.select("wall", F.struct(*names).alias("b")), "wall", "left")
    agree = F.abs(F.col("a.dx") * F.col("b.dx") + F.col("a.dy") * F.col("b.dy")) >= math.cos(math.radians(OVERRULED))
    line = both.select("wall", F.when(agree, F.col("b")).otherwise(F.col("a")).alias("l")).select("wall", "l.*")
    line = span(line)
    line = written(line.withColumn("half", F.least("half", F.greatest(F.floor(F.col("width") / 2 / voxel), F.lit(0.5)) * voxel)).select("wall", *names, "start", "end"), "both-lines")
    # 2. free ends: the last voxels of the core
    core = walls.join(line, "wall").where((F.abs(d) <= F.col("half") + EDGE) & t.between(F.col("start"), F.col("end"))).groupBy("wall").agg(F.min(t).alias("data_start"), F.max(t).alias("data_end"))
    line = written(line.join(core, "wall").withColumns({"slab_start": F.greatest(F.col("data_start") - voxel / 2, F.col("start")), "slab_end": F.least(F.col("data_end") + voxel / 2, F.col("end")), "bins": F.greatest(F.ceil(F.round((F.col("end") - F.col("start")) / voxel, 9)), F.lit(1)).cast("int")}), "walls")
    # 3. heights by bin
    bin_of = lambda c: F.least(F.greatest(F.floor(F.round((c - F.col("start")) / voxel, 9)), F.lit(0)), F.col("bins") - 1).cast("int")
    layers = walls.join(line, "wall").where((t >= F.col("start")) & (t < F.col("end")) & (F.abs(d) <= F.col("half") + voxel + EDGE))
    layers = layers.groupBy("wall", bin_of(t).alias("bin")).agg(F.min("kz").alias("low"), F.max("kz").alias("high"))
    bins = line.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    x, y = at(F.col("start") + (F.col("bin") + 0.5) * voxel, F.lit(0.0))
    bins = bins.select("wall", "bin", F.floor(x / voxel).alias("kx"), F.floor(y / voxel).alias("ky"))
    floors = column_floors(bins.select("wall", "kx", "ky").distinct(), near, voxel, floor_of)
    bottom = F.greatest(F.floor(F.col("floor") / voxel + EDGE) + 1, F.ceil(F.coalesce("bottom", F.lit(-1e6)) / voxel))
    bins = bins.join(floors, ["wall", "kx", "ky"], "left").join(strokes.select("wall", "bottom"), "wall").select("wall", "bin", F.when(F.col("floor").isNotNull(), bottom).alias("bottom"))
    height = written(extents(written(bins.join(layers, ["wall", "bin"], "left"), "stretches"), voxel), "extents")
    # 4. the slab, by samples half a voxel apart
    steps = F.ceil(F.round((F.col("slab_end") - F.col("slab_start")) / (voxel / 2), 9)).cast("int")
    rows = F.greatest(F.floor(2 * F.col("half") / voxel + 0.5) * 2 - 1, F.lit(1)).cast("int")
    samples = line.where("slab_end >= slab_start").select("*", F.explode(F.sequence(F.lit(0), steps)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), rows - 1)).alias("j"))
    here = F.greatest(F.least(F.col("slab_start") + F.col("i") * voxel / 2, F.col("slab_end") - 0.01 * voxel), F.col("slab_start") + 0.01 * voxel)
    x, y = at(here, -F.col("half") + voxel / 4 + F.col("j") * voxel / 2)
    samples = samples.select("wall", bin_of(here).alias("bin"), F.floor(x / voxel).alias("kx"), F.floor(y / voxel).alias("ky")).distinct()
    samples = samples.join(drawn, "wall").where(_in_band(_center("kx", voxel), _center("ky", voxel))).select("wall", "bin", "kx", "ky")
    tall = samples.join(height.where("bottom <= top"), ["wall", "bin"])
    slab = written(tall.select("wall", "kx", "ky", F.explode(F.sequence("bottom", "top")).alias("kz")).distinct(), "slab")
    # 5. what goes: all wall voxels of the band beside the slab that do not carry on outward
    of_column = walls.groupBy("wall", "kx", "ky").agg(F.count("*").alias("n"))
    cx, cy = _center("kx", voxel), _center("ky", voxel)
    typical = of_column.join(drawn, "wall").where(_in_band(cx, cy)).select("wall", "kx", "ky", "n").join(line, "wall").where(F.abs(across(cx, cy)) <= F.col("half") + EDGE)
    nth = Window.partitionBy("wall").orderBy("n", "kx", "ky")
    typical = typical.select("wall", "n", (F.row_number().over(nth) - 1).alias("nth"), F.count("*").over(Window.partitionBy("wall")).alias("all")).where("nth = all div 2").select("wall", F.col("n").alias("typical"))
    full = of_column.join(line.select("wall"), "wall").join(typical, "wall", "left").where(F.col("n") >= F.greatest(F.expr("coalesce(typical, 8) div 4"), F.lit(3))).select("wall", "kx", "ky")
    beside = walls.where("selected").join(line, "wall").join(slab, ["wall", "kx", "ky", "kz"], "left_anti").select("wall", "id", "kx", "ky", (F.abs(d) > F.col("half") + EDGE).alias("off"))
    going_on = carrying_on(beside.where("off").select("wall", "kx", "ky").distinct(), full, strokes, voxel).withColumn("off", F.lit(True))
    removed = beside.join(going_on, ["wall", "kx", "ky", "off"], "left_anti").select("wall", "id")
    # 6. what comes: voxels of the slab that nothing occupies
    added = slab.join(near.select("wall", "kx", "ky", "kz").distinct(), ["wall", "kx", "ky", "kz"], "left_anti").join(line.select("wall", (-F.col("dy")).alias("nx"), F.col("dx").alias("ny")), "wall")
    return removed, added.select("wall", *[G.voxel_center(F.col(f"k{a}"), voxel).alias(a) for a in "xyz"], "nx", "ny", F.lit(0.0).alias("nz"))
