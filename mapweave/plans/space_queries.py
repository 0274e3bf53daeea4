"""Neighbour, component and floor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions import picks
from mapweave.operators import floors as L
from mapweave.operators import spatial as S

from .registry import EMB, PTS, points, query, vectors

_PAIRS = f"(SELECT a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM {EMB} a, {EMB} b WHERE a.id <> b.id)"
_KNN = lambda k: f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM {_PAIRS} QUALIFY rank <= {k})"
_MEAN = f"(SELECT id, avg(distance) AS mean FROM {_KNN(8)} GROUP BY id)"
NEAR = 0.1


@query(f"SELECT id, other, rank, round(distance, 6) AS distance FROM {_KNN(3)}")
def knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return S.nearest(v, v, 3, NEAR).select("id", "other", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"SELECT id, other, round(distance, 6) AS distance FROM {_PAIRS} WHERE distance <= 0.05")
def radius_neighbours(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return S.radius_join(v, v, 0.05).where("id <> other").select("id", "other", F.round("distance", 6).alias("distance"))


@query(f"SELECT id, round(mean, 6) AS mean FROM {_MEAN} WHERE mean > (SELECT avg(mean) + 2.0 * stddev_pop(mean) FROM {_MEAN})")
def outliers_pop(spark, sf_dir):
    return S.outliers(vectors(spark, sf_dir), 8, 2.0, NEAR).select("id", F.round("mean", 6).alias("mean"))


@query(f"SELECT id, round(mean, 6) AS mean FROM {_MEAN} WHERE mean <= (SELECT avg(mean) + 2.0 * stddev_samp(mean) FROM {_MEAN})")
def outliers_sample(spark, sf_dir):
    return S.inliers(vectors(spark, sf_dir), 8, 2.0, NEAR).select("id", F.round("mean", 6).alias("mean"))


@query(f"SELECT round(list_sort(list(distance))[count(*) // 2 + 1], 3) AS spacing FROM {_KNN(1)}")
def spacing(spark, sf_dir):
    """Median distance to the nearest other point, to the millimetre."""
    v = vectors(spark, sf_dir)
    d = S.nearest(v, v, 1, NEAR).withColumn("all", F.lit(1))
    return picks.upper_median(d, ["all"], "distance", "spacing").select(F.round("spacing", 3).alias("spacing"))


_COV = ", ".join(f"round(covar_pop({a}, {b}), 6) AS s{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:])


@query(f"SELECT label, count(*) AS n, {_COV} FROM {EMB} GROUP BY label")
def pca_cov(spark, sf_dir):
    d = S.covariance(vectors(spark, sf_dir), ["label"])
    return d.select("label", "n", *[F.round(c, 6).alias(c) for c in d.columns if c.startswith("s")])


@query(f"SELECT label, round(0.5 * atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)), 6) AS yaw FROM {EMB} GROUP BY label")
def principal_yaw(spark, sf_dir):
    d = S.covariance(vectors(spark, sf_dir), ["label"], "xy")
    return d.select("label", F.round(0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")), 6).alias("yaw"))


@query()
def normals(spark, sf_dir):
    return S.normals(vectors(spark, sf_dir), 0.1)


_CELLS = "SELECT DISTINCT CAST(floor(x / 0.03) AS BIGINT) AS cx, CAST(floor(y / 0.03) AS BIGINT) AS cy, CAST(floor(z / 0.03) AS BIGINT) AS cz FROM " + EMB
_FLOOD = f"""WITH RECURSIVE c AS ({_CELLS}), n AS (SELECT *, row_number() OVER (ORDER BY cx, cy, cz) AS node FROM c),
e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
k AS (SELECT node, min(seen) AS label FROM r GROUP BY node)"""


@query(f"{_FLOOD} SELECT l.cx AS lx, l.cy AS ly, l.cz AS lz, count(*) AS cells FROM k JOIN n l ON l.node = k.label GROUP BY l.cx, l.cy, l.cz")
def components(spark, sf_dir):
    """Components of occupied cells (named by their smallest cell) and their sizes."""
    labels, _ = S.cell_components(vectors(spark, sf_dir), 0.03)
    return labels.groupBy("label").agg(F.count("*").alias("cells")).select(F.col("label.cx").alias("lx"), F.col("label.cy").alias("ly"), F.col("label.cz").alias("lz"), "cells")


@query(f"""{_FLOOD}, z AS (SELECT label FROM k GROUP BY label HAVING count(*) < 3)
SELECT p.id FROM {EMB} p JOIN n ON n.cx = floor(p.x / 0.03) AND n.cy = floor(p.y / 0.03) AND n.cz = floor(p.z / 0.03) JOIN k ON k.node = n.node WHERE k.label IN (SELECT label FROM z)""")
def small_components(spark, sf_dir):
    """Points in groups of fewer than three cells."""
    return S.floating(vectors(spark, sf_dir), 0.03, 3).select("id")


@query(f"""{_FLOOD}, p AS (SELECT p.x, p.y, k.label FROM {EMB} p JOIN n ON n.cx = floor(p.x / 0.03) AND n.cy = floor(p.y / 0.03) AND n.cz = floor(p.z / 0.03) JOIN k ON k.node = n.node),
s AS (SELECT label, count(*) AS points, min(sqrt(x * x + y * y)) AS distance FROM p GROUP BY label HAVING count(*) >= 4)
SELECT l.cx AS lx, l.cy AS ly, l.cz AS lz, points, round(distance, 6) AS distance FROM s JOIN n l ON l.node = s.label ORDER BY s.distance, points DESC, l.cx, l.cy, l.cz LIMIT 1""")
def nearest_component(spark, sf_dir):
    """Of the components with at least four points, the one nearest to the origin on the ground plane; ties by size."""
    labels, keyed = S.cell_components(vectors(spark, sf_dir).drop("label"), 0.03)
    p = keyed.join(labels, ["cx", "cy", "cz"]).groupBy("label").agg(F.count("*").alias("points"), F.min(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("distance"))
    best = p.where("points >= 4").orderBy("distance", F.desc("points"), "label").limit(1)
    return best.select(F.col("label.cx").alias("lx"), F.col("label.cy").alias("ly"), F.col("label.cz").alias("lz"), "points", F.round("distance", 6).alias("distance"))


_VOX = f"(SELECT DISTINCT CAST(floor(x / 2.0) AS BIGINT) AS cx, CAST(floor(y / 4.0) AS BIGINT) AS cy, CAST(floor(z) AS BIGINT) AS layer FROM {PTS})"
_NEAR = f"(SELECT a.cx, a.cy, a.layer, count(*) AS near FROM {_VOX} a JOIN {_VOX} b ON a.layer = b.layer AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY 1, 2, 3)"


def _in_cells(d):
    at = lambda a, s, n: F.floor(F.col(a).cast("double") / s).cast("long").alias(n)
    return d.select(at("x", 2.0, "cx"), at("y", 4.0, "cy"), at("z", 1.0, "layer"), F.col("z").cast("double").alias("z"))


def _voxels(spark, sf_dir):
    return _in_cells(points(spark, sf_dir))


@query(f"SELECT cx, cy, max(layer) AS layer FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY layer DESC) - 1 AS over_n FROM {_NEAR}) WHERE near >= 7 AND over_n <= 3 GROUP BY cx, cy")
def column_top_surface(spark, sf_dir):
    return L.top_surfaces(_voxels(spark, sf_dir))


@query(f"SELECT cx, cy, max(layer) AS layer FROM {_NEAR} WHERE layer BETWEEN 2 AND 6 AND near >= 5 GROUP BY cx, cy")
def column_floor(spark, sf_dir):
    return L.column_floors(_voxels(spark, sf_dir), 2, 6)


_HEIGHT = f"""(SELECT cx, cy, arg_min(ss / nn, layer) AS height FROM (
  SELECT cx, cy, layer, n + CASE WHEN lead(layer) OVER w = layer + 1 THEN lead(n) OVER w ELSE 0 END AS nn, s + CASE WHEN lead(layer) OVER w = layer + 1 THEN lead(s) OVER w ELSE 0 END AS ss
  FROM (SELECT CAST(floor(x / 2.0) AS BIGINT) AS cx, CAST(floor(y / 4.0) AS BIGINT) AS cy, CAST(floor(z) AS BIGINT) AS layer, count(*) AS n, sum(z::DOUBLE) AS s FROM {PTS} GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY cx, cy ORDER BY layer))
  WHERE nn >= 3 GROUP BY cx, cy)"""


def _heights(spark, sf_dir):
    return L.column_heights(_voxels(spark, sf_dir))


@query(f"SELECT cx, cy, round(height, 6) AS height FROM {_HEIGHT}")
def column_height(spark, sf_dir):
    return _heights(spark, sf_dir).withColumn("height", F.round("height", 6))


@query(f"""WITH RECURSIVE c AS (SELECT cx, cy, round(height, 4) AS height FROM {_HEIGHT}), r AS (SELECT cx, cy, height FROM c WHERE abs(height - 1.0) <= 0.3
 UNION SELECT c.cx, c.cy, c.height FROM r JOIN c ON abs(r.cx - c.cx) + abs(r.cy - c.cy) = 1 AND abs(r.height - c.height) <= 0.8) SELECT cx, cy, height FROM r""")
def floor_flood(spark, sf_dir):
    return L.flooded(_heights(spark, sf_dir).withColumn("height", F.round("height", 4)), 1.0, 0.3, 0.8)


@query()
def hole_fill(spark, sf_dir):
    """Heights of all points, and of cells near them that have none."""
    return L.filled(L.column_heights(_in_cells(points(spark, sf_dir))), 26, 30, 3)


