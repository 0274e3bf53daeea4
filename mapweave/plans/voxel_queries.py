"""Voxel, region and raster queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from mapweave.functions import geometry as G
from mapweave.functions import picks
from mapweave.operators import slices as SL
from mapweave.operators import voxels as V

from .registry import EMB, PTS, events, points, query, vectors

KEYS = ", ".join(f"CAST(floor({a} / 2.0::FLOAT) AS BIGINT) AS k{a}" for a in "xyz")
R6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


@query(f"SELECT kx, ky, kz, count(*) AS n, round(avg(x::DOUBLE), 4) AS x, round(avg(y::DOUBLE), 4) AS y, round(avg(z::DOUBLE), 4) AS z FROM (SELECT *, {KEYS} FROM {PTS}) GROUP BY kx, ky, kz")
def voxel_mean(spark, sf_dir):
    return V.mean(points(spark, sf_dir), 2.0).select(*V.KEYS, "n", *[F.round(a, 4).alias(a) for a in "xyz"])


@query(f"SELECT kx, ky, kz, o, l, p, s, x, y, z FROM (SELECT *, {KEYS}, row_number() OVER (PARTITION BY floor(x / 2.0::FLOAT), floor(y / 2.0::FLOAT), floor(z / 2.0::FLOAT) ORDER BY o, l, p, s, x, y, z) AS r FROM {PTS}) WHERE r = 1")
def voxel_first(spark, sf_dir):
    return V.first(points(spark, sf_dir), 2.0, ["o", "l", "p", "s"])


@query(f"SELECT DISTINCT kx, ky, kz, ((kx::FLOAT + 0.5::FLOAT) * 2.0::FLOAT)::FLOAT AS x, ((ky::FLOAT + 0.5::FLOAT) * 2.0::FLOAT)::FLOAT AS y, ((kz::FLOAT + 0.5::FLOAT) * 2.0::FLOAT)::FLOAT AS z FROM (SELECT {KEYS} FROM {PTS})")
def voxel_centers(spark, sf_dir):
    return V.centers(points(spark, sf_dir), 2.0)


CENTER, SIZE, YAW = (25.0, 40.0, 5.0), (20.0, 30.0, 6.0), 0.5
_C, _S = repr(math.cos(YAW)), repr(math.sin(YAW))
_IN = f"(abs((x::DOUBLE - 25.0) * {_C} + (y::DOUBLE - 40.0) * {_S}) <= 10.0 AND abs((y::DOUBLE - 40.0) * {_C} - (x::DOUBLE - 25.0) * {_S}) <= 15.0 AND abs(z::DOUBLE - 5.0) <= 3.0)"


def _box(d):
    return G.in_box(F.col("x"), F.col("y"), F.col("z"), CENTER, SIZE, YAW)


@query(f"SELECT o, l, p, s, x, y, z FROM {PTS} WHERE {_IN}")
def box_select(spark, sf_dir):
    d = points(spark, sf_dir)
    return d.where(_box(d)).select("o", "l", "p", "s", "x", "y", "z")


@query(f"SELECT flag, count(*) AS n FROM {PTS} WHERE NOT {_IN} GROUP BY flag")
def box_outside(spark, sf_dir):
    d = points(spark, sf_dir)
    return d.where(~_box(d)).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"SELECT o, l, p, s, z FROM {PTS} WHERE NOT (z BETWEEN 2 AND 9)")
def height_crop(spark, sf_dir):
    return points(spark, sf_dir).where(~F.col("z").between(2, 9)).select("o", "l", "p", "s", "z")


MATRIX = [1.0, 0.1, 0.0, 0.02, 0.0, 0.9, 0.1, 0.03, 0.1, 0.0, 1.0, 0.04, -25.0, -40.0, -5.0, 6.0]
_ROW = lambda r: f"(x::DOUBLE * {MATRIX[r]} + y::DOUBLE * {MATRIX[4 + r]} + z::DOUBLE * {MATRIX[8 + r]} + {MATRIX[12 + r]})"


@query(f"SELECT o, l, p, s FROM {PTS} WHERE {_ROW(3)} > 0 AND abs({_ROW(0)}) <= {_ROW(3)} AND abs({_ROW(1)}) <= {_ROW(3)} AND abs({_ROW(2)}) <= {_ROW(3)}")
def frustum_select(spark, sf_dir):
    return points(spark, sf_dir).where(G.in_view(F.col("x"), F.col("y"), F.col("z"), MATRIX)).select("o", "l", "p", "s")


CORNERS = [(5.0, 10.0), (30.0, 5.0), (45.0, 60.0), (20.0, 40.0), (8.0, 70.0)]
_EDGES = " + ".join(f"(CASE WHEN ({ay} > y::DOUBLE) <> ({by} > y::DOUBLE) AND x::DOUBLE < {bx - ax} * (y::DOUBLE - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END)" for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[-1:] + CORNERS[:-1], strict=True))


@query(f"SELECT flag, count(*) AS n, CAST(sum(p) AS BIGINT) AS parts FROM {PTS} WHERE ({_EDGES}) % 2 = 1 GROUP BY flag")
def polygon_area_select(spark, sf_dir):
    inside = G.in_polygon(F.col("x").cast("double"), F.col("y").cast("double"), CORNERS)
    return points(spark, sf_dir).where(inside).groupBy("flag").agg(F.count("*").alias("n"), F.sum("p").alias("parts"))


PATH = [(5.0, 5.0), (20.0, 30.0), (40.0, 35.0)]


def _segment_sql(a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"greatest(0.0, least(1.0, ((x::DOUBLE - {a[0]}) * {dx} + (y::DOUBLE - {a[1]}) * {dy}) / {dx * dx + dy * dy}))"
    px, py = f"(x::DOUBLE - ({a[0]} + {t} * {dx}))", f"(y::DOUBLE - ({a[1]} + {t} * {dy}))"
    return f"sqrt({px} * {px} + {py} * {py})"


@query(f"SELECT flag, count(*) AS n, CAST(sum(o) AS BIGINT) AS orders FROM {PTS} WHERE least({', '.join(_segment_sql(a, b) for a, b in zip(PATH, PATH[1:], strict=False))}) <= 3.0 GROUP BY flag")
def stroke_select(spark, sf_dir):
    near = G.in_stroke(F.col("x").cast("double"), F.col("y").cast("double"), PATH, 3.0)
    return points(spark, sf_dir).where(near).groupBy("flag").agg(F.count("*").alias("n"), F.sum("o").alias("orders"))


_CORNERS = ", ".join(f"{f}({a}) AS {f}_{a}" for a in "xyz" for f in ("min", "max"))


@query(f"SELECT count(*) AS n, {_CORNERS}, count(*) FILTER (WHERE abs(nz) > 0.8) AS horizontal, count(*) FILTER (WHERE abs(nz) < 0.3 AND (nx <> 0 OR ny <> 0)) AS vertical FROM {PTS} WHERE {_IN}")
def region_summary(spark, sf_dir):
    d = points(spark, sf_dir)
    return V.summary(d.where(_box(d)))


@query(f"SELECT count(*) AS n, {_CORNERS} FROM {PTS}")
def bounds(spark, sf_dir):
    return V.bounds(points(spark, sf_dir))


@query(f"""
WITH b AS (SELECT CAST(floor(h / 3.0) AS BIGINT) AS bin, count(*) AS n FROM {PTS} WHERE abs(nz) > 0.4 GROUP BY 1),
w AS (SELECT bin, n, CASE WHEN lag(bin) OVER o = bin - 1 THEN lag(n) OVER o ELSE 0 END AS below, CASE WHEN lead(bin) OVER o = bin + 1 THEN lead(n) OVER o ELSE 0 END AS above, sum(n) OVER () AS total FROM b WINDOW o AS (ORDER BY bin))
SELECT bin, n, (bin + 0.5) * 3.0 AS height FROM w WHERE n >= below AND n > above AND n >= 0.03 * total""")
def level_peaks(spark, sf_dir):
    return V.levels(points(spark, sf_dir).drop("z").withColumnRenamed("h", "z"), 3.0, 0.03, F.abs("nz") > 0.4)


_WALL = f"(SELECT x / r AS nx, y / r AS ny, z / r AS nz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM {EMB}) WHERE r > 0)"


@query(f"""SELECT CAST(least(floor(d - 90 * floor(d / 90)), 89) AS BIGINT) AS bin, count(*) AS n, round(sum(sqrt(nx * nx + ny * ny)), 6) AS weight
FROM (SELECT *, degrees(atan2(ny, nx)) AS d FROM {_WALL}) WHERE abs(nz) < 0.3 AND sqrt(nx * nx + ny * ny) > 0.5 GROUP BY 1""")
def wall_angle_histogram(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).where("r > 0")
    d = d.select(*[(F.col(a) / F.col("r")).alias(f"n{a}") for a in "xyz"])
    return V.wall_angles(d).select("bin", "n", F.round("weight", 6).alias("weight"))


def _pick_sql(src, by, value, q):
    return f"SELECT {by}, list_sort(list({value}))[CAST(floor((count({value}) - 1) * {q} + 0.5) AS BIGINT) + 1] AS picked FROM {src} GROUP BY {by}"


@query(f"SELECT a.flag, a.picked AS low, b.picked AS high, b.picked - a.picked AS extent FROM ({_pick_sql(PTS, 'flag', 'y', 0.02)}) a JOIN ({_pick_sql(PTS, 'flag', 'y', 0.98)}) b USING (flag)")
def trimmed_extents(spark, sf_dir):
    d = picks.percentiles(points(spark, sf_dir), ["flag"], "y", {"low": 0.02, "high": 0.98}).drop("n")
    return d.withColumn("extent", F.col("high") - F.col("low"))


@query("SELECT event_type AS kind, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY event_type")
def upper_median(spark, sf_dir):
    return picks.upper_median(events(spark, sf_dir), ["kind"], "v", "median")


_RASTER = f"""(SELECT CAST(least(trunc((x::DOUBLE - 10.0) / 2.0), 14) AS BIGINT) AS cx, CAST(least(trunc((y::DOUBLE - 10.0) / 2.0), 19) AS BIGINT) AS cy,
  max(CASE WHEN z::DOUBLE BETWEEN 1 + 0.15 AND 1 + 1.8 THEN 100 WHEN abs(z::DOUBLE - 1.0) <= 0.12 THEN 0 END) AS value
  FROM {PTS} WHERE x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 50 AND (z::DOUBLE BETWEEN 1 + 0.15 AND 1 + 1.8 OR abs(z::DOUBLE - 1.0) <= 0.12) GROUP BY 1, 2)"""


def _raster(spark, sf_dir):
    return V.raster(points(spark, sf_dir), 10.0, 10.0, 2.0, 15, 20, 1.0, None)


@query(f"SELECT cx, cy, CAST(value AS BIGINT) AS value FROM {_RASTER}")
def raster_priority(spark, sf_dir):
    return _raster(spark, sf_dir)


_DENSE = f"(SELECT g.cx, g.cy, CAST(coalesce(r.value, -1) AS BIGINT) AS value FROM (SELECT a.r AS cx, b.r AS cy FROM range(15) a(r), range(20) b(r)) g LEFT JOIN {_RASTER} r ON r.cx = g.cx AND r.cy = g.cy)"


@query(f"SELECT cx, cy, value FROM {_DENSE}")
def raster_dense(spark, sf_dir):
    return V.densify(_raster(spark, sf_dir), 15, 20)


@query(f"SELECT count(*) FILTER (WHERE value = 100) AS occupied, count(*) FILTER (WHERE value = 0) AS free, count(*) FILTER (WHERE value = -1) AS unknown FROM {_DENSE}")
def raster_counts(spark, sf_dir):
    d = V.densify(_raster(spark, sf_dir), 15, 20)
    return d.agg(*[F.count_if(F.col("value") == v).alias(n) for v, n in ((100, "occupied"), (0, "free"), (-1, "unknown"))])


@query(f"SELECT flag, count(*) AS n FROM {PTS} WHERE abs(nz) > 0.7 AND (abs(z - 1.0) <= 0.5 OR abs(z - 7.0) <= 0.5) GROUP BY flag")
def floor_select(spark, sf_dir):
    return V.floor_points(points(spark, sf_dir), [1.0, 7.0], 0.5).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"SELECT o, l, p, s FROM {PTS} WHERE (nx <> 0 OR ny <> 0 OR nz <> 0) AND abs(nz) < 0.3 AND z - (CASE WHEN 6.0 <= z + 0.1 THEN 6.0 WHEN 1.0 <= z + 0.1 THEN 1.0 ELSE 1.0 END) >= 2.0")
def wall_select(spark, sf_dir):
    return V.wall_points(points(spark, sf_dir), [1.0, 6.0], 2.0).select("o", "l", "p", "s")


_TURNED = f"((x::DOUBLE * {_C} - y::DOUBLE * {_S}) BETWEEN -20 AND 30 AND (x::DOUBLE * {_S} + y::DOUBLE * {_C}) BETWEEN 10 AND 70)"


@query(f"SELECT o, l, p, s FROM {PTS} WHERE z::DOUBLE BETWEEN 3 AND 7 AND {_TURNED}")
def slice_crop(spark, sf_dir):
    """What a slice from 2 to 7 and a storey from 3 to 9 both show of a turned map."""
    d = points(spark, sf_dir)
    x, y, z = (F.col(a).cast("double") for a in "xyz")
    return d.where(SL.shown(x, y, z, 2.0, 7.0, (-20.0, 10.0, 30.0, 70.0), YAW, (3.0, 9.0))).select("o", "l", "p", "s")


def _slice_sql(at: str) -> str:
    return f"""SELECT cx, cy, CAST(max(value) AS INTEGER) AS value FROM (SELECT CAST(floor(x::DOUBLE / 2) AS BIGINT) AS cx, CAST(floor(y::DOUBLE / 2) AS BIGINT) AS cy,
 CASE WHEN {at} BETWEEN 4 AND 6 THEN 2 WHEN abs(z::DOUBLE - f) <= 0.1 THEN 1 END AS value FROM (SELECT *, CASE WHEN s % 4 <> 0 THEN CAST(s % 4 AS DOUBLE) END AS f FROM {PTS})) GROUP BY cx, cy HAVING max(value) IS NOT NULL"""


def _sliced(spark, sf_dir, follow):
    floor = F.when(F.col("s") % 4 != 0, (F.col("s") % 4).cast("double"))  # a quarter of the points have no known floor
    d = points(spark, sf_dir).select(*[F.col(a).cast("double").alias(a) for a in "xyz"], floor.alias("floor"))
    return SL.raster(d, 2.0, 4.0, 6.0, follow)


@query(_slice_sql("z::DOUBLE"))
def slice_raster(spark, sf_dir):
    return _sliced(spark, sf_dir, False)


@query(_slice_sql("z::DOUBLE - f"))
def slice_raster_follow(spark, sf_dir):
    return _sliced(spark, sf_dir, True)


_ALONG = "((x::DOUBLE + 5) * 0.6 + (y::DOUBLE - 10) * 0.8 + (z::DOUBLE - 5) * 0.0)"


@query(f"""SELECT id, round(along, 6) AS along FROM (SELECT o * 8 + l AS id, {_ALONG} AS along, sqrt(power(-5 + 0.6 * {_ALONG} - x::DOUBLE, 2) + power(10 + 0.8 * {_ALONG} - y::DOUBLE, 2) + power(5 - z::DOUBLE, 2)) AS off FROM {PTS})
 WHERE along > 0 AND off < 0.75 + along * 0.004 ORDER BY along, id LIMIT 1""")
def ray_pick(spark, sf_dir):
    d = points(spark, sf_dir).select((F.col("o") * 8 + F.col("l")).alias("id"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    return SL.picked(d, (-5.0, 10.0, 5.0), (0.6, 0.8, 0.0), 0.5).select("id", F.round("along", 6).alias("along"))
