"""Wall and box queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mapweave.operators import boxes as B
from mapweave.operators import walls as W

from .registry import EMB, PTS, points, query, vectors


def _fit_sql(rows: str) -> str:
    return f"""(SELECT label, n, ox, oy, cos(0.5 * atan2(2 * sxy, sxx - syy)) AS dx, sin(0.5 * atan2(2 * sxy, sxx - syy)) AS dy,
 ((sxx + syy) / 2 + sqrt(power((sxx - syy) / 2, 2) + sxy * sxy)) / greatest((sxx + syy) / 2 - sqrt(power((sxx - syy) / 2, 2) + sxy * sxy), 1e-9 / n) AS ratio
 FROM (SELECT label, count(*) AS n, avg(x) AS ox, avg(y) AS oy, var_pop(x) AS sxx, covar_pop(x, y) AS sxy, var_pop(y) AS syy FROM {rows} GROUP BY label))"""


def _closest_sql(axis: str) -> str:
    return f"""(SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.label ORDER BY round(abs((y - oy) * dx - (x - ox) * dy), 9), id) AS nth, count(*) OVER (PARTITION BY e.label) AS al
 FROM e JOIN {axis} a ON a.label = e.label) WHERE nth <= greatest(al * 6 // 10, 4))"""


@query(f"""WITH e AS (SELECT * FROM {EMB}), f0 AS {_fit_sql("e")}, c1 AS {_closest_sql("f0")}, f1 AS {_fit_sql("c1")}, c2 AS {_closest_sql("f1")}, f2 AS {_fit_sql("c2")}
SELECT label, n, round(ox, 6) AS ox, round(oy, 6) AS oy, round(dx, 5) AS dx, round(dy, 5) AS dy, round(ratio, 4) AS ratio FROM f2""")
def wall_axis(spark, sf_dir):
    """A line per label through its points, fitted again twice on the closest 60 %."""
    d = W.trimmed_axis(vectors(spark, sf_dir), ["label"])
    return d.select("label", "n", *[F.round(c, 6).alias(c) for c in ("ox", "oy")], *[F.round(c, 5).alias(c) for c in ("dx", "dy")], F.round("ratio", 4).alias("ratio"))


@query(f"""WITH h AS (SELECT p, floor(y::DOUBLE / 5) AS stretch, floor(x::DOUBLE / 2) AS bin, count(*) AS n FROM {PTS} GROUP BY 1, 2, 3),
k AS (SELECT p, stretch, bin AS peak, n AS most FROM (SELECT *, row_number() OVER (PARTITION BY p, stretch ORDER BY n DESC, abs(bin), bin) AS r FROM h) WHERE r = 1 AND n >= 2),
f AS (SELECT h.p, h.stretch, bin, peak, bin - row_number() OVER (PARTITION BY h.p, h.stretch ORDER BY bin) AS run FROM h JOIN k ON k.p = h.p AND k.stretch = h.stretch WHERE 2 * n >= most),
g AS (SELECT p, stretch, min(bin) AS low, max(bin) AS high FROM f GROUP BY p, stretch, run HAVING bool_or(bin = peak))
SELECT p, CAST(list_sort(list(high - low + 1))[count(*) // 2 + 1] AS BIGINT) AS thick, list_sort(list((low + high + 1) / 2 * 2.0))[count(*) // 2 + 1] AS middle FROM g GROUP BY p""")
def wall_core(spark, sf_dir):
    """Per part, over stretches of price: the run of quantities around the commonest ones."""
    d = points(spark, sf_dir).select("p", F.col("y").cast("double").alias("t"), F.col("x").cast("double").alias("d"))
    return W.cores(d, ["p"], 2.0, 5.0, 2).select("p", F.col("thick").cast("long").alias("thick"), "middle")


#: Every part is a wall, its bins are prices, its layers discounts; one bin in eleven has no floor.
_BINS = f"""v AS (SELECT p AS wall, CAST(floor(y::DOUBLE / 2) AS INTEGER) AS bin, CAST(floor(z) AS BIGINT) AS k FROM {PTS}),
l AS (SELECT wall, bin, min(k) AS low, max(k) AS high FROM v GROUP BY wall, bin), b AS (SELECT wall, CAST(unnest(range(0, most + 1)) AS INTEGER) AS bin FROM (SELECT wall, max(bin) AS most FROM v GROUP BY wall)),
s AS (SELECT b.wall, b.bin, CASE WHEN (b.wall + b.bin) % 11 <> 0 THEN 0 END AS bottom, low, high FROM b LEFT JOIN l ON l.wall = b.wall AND l.bin = b.bin)"""
_DOORS = f"""{_BINS},
u AS (SELECT wall, low AS usual FROM (SELECT wall, low, row_number() OVER (PARTITION BY wall ORDER BY low, bin) - 1 AS nth, count(*) OVER (PARTITION BY wall) AS n FROM s WHERE low IS NOT NULL AND bottom IS NOT NULL) WHERE nth = n // 4),
o AS (SELECT s.wall, bin, max(bin) OVER (PARTITION BY s.wall) AS most, bottom IS NULL OR low IS NULL OR low - greatest(coalesce(usual, bottom), bottom) > 5 AS open FROM s LEFT JOIN u ON u.wall = s.wall),
r AS (SELECT wall, min(bin) AS first, max(bin) AS last, any_value(most) AS most FROM (SELECT *, bin - row_number() OVER (PARTITION BY wall ORDER BY bin) AS run FROM o WHERE open) GROUP BY wall, run),
d AS (SELECT wall, first, last FROM r WHERE first > 0 AND last < most AND last - first + 1 >= 6)"""


def _layers(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("p").alias("wall"), F.floor(F.col("y").cast("double") / 2).cast("int").alias("bin"), F.floor("z").cast("long").alias("k"))


def _stretches(spark, sf_dir):
    held = _layers(spark, sf_dir).where("bin >= 0").groupBy("wall", "bin").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    # a bin that holds something brings the empty ones before it
    after = F.coalesce(F.lag("bin").over(Window.partitionBy("wall").orderBy("bin")) + 1, F.lit(0))
    bins = held.withColumns({"last": F.col("bin"), "after": after}).withColumn("bin", F.explode(F.sequence("after", "bin")))
    own = lambda c: F.when(F.col("bin") == F.col("last"), F.col(c)).alias(c)
    return bins.select("wall", "bin", own("low"), own("high"), F.when((F.col("wall") + F.col("bin")) % 11 != 0, F.lit(0)).alias("bottom"))


@query(f"WITH {_DOORS} SELECT * FROM d")
def doorway_runs(spark, sf_dir):
    return W.doorways(_stretches(spark, sf_dir), 0.1)


_EXTENTS = f"""{_DOORS},
h AS (SELECT s.wall, bin, bottom, CASE WHEN bottom IS NOT NULL THEN low END AS low, list_sort(list_filter(list(CASE WHEN bottom IS NOT NULL THEN high END) OVER w, lambda x: x IS NOT NULL)) AS tops, list_sort(list_filter(list(bottom) OVER w, lambda x: x IS NOT NULL)) AS bottoms
  FROM s WINDOW w AS (PARTITION BY wall ORDER BY bin RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
hd AS (SELECT h.*, d.first AS door FROM h LEFT JOIN d ON d.wall = h.wall AND h.bin BETWEEN d.first AND d.last),
hh AS (SELECT wall, door, list_sort(list(low))[count(*) // 2 + 1] AS header FROM hd WHERE door IS NOT NULL AND low IS NOT NULL GROUP BY wall, door),
e AS (SELECT hd.wall, bin, CASE WHEN hd.door IS NOT NULL THEN header ELSE coalesce(bottom, bottoms[len(bottoms) // 2 + 1]) END AS bottom, tops[len(tops) // 2 + 1] AS top FROM hd LEFT JOIN hh ON hh.wall = hd.wall AND hh.door = hd.door),
n AS (SELECT *, last_value(CASE WHEN bottom IS NOT NULL AND top IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY wall ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b0,
  first_value(CASE WHEN bottom IS NOT NULL AND top IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY wall ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b1 FROM e),
x AS (SELECT n.wall, n.bin, CAST(e.bottom AS BIGINT) AS bottom, CAST(e.top AS BIGINT) AS top FROM n JOIN e ON e.wall = n.wall AND e.bin = CASE WHEN b1 IS NULL OR n.bin - b0 <= b1 - n.bin THEN b0 ELSE b1 END)"""


def _extents(spark, sf_dir):
    d = W.extents(_stretches(spark, sf_dir), 0.1)
    return d.select("wall", "bin", *[F.col(c).cast("long").alias(c) for c in ("bottom", "top")])


@query(f"WITH {_EXTENTS} SELECT * FROM x")
def wall_heights(spark, sf_dir):
    return _extents(spark, sf_dir)


@query(f"WITH {_EXTENTS}, a AS (SELECT wall, bin, unnest(range(bottom, top + 1)) AS k FROM x WHERE bottom <= top) SELECT wall, count(*) AS n, CAST(sum(bin * 100 + k) AS BIGINT) AS places FROM (SELECT * FROM a EXCEPT SELECT wall, bin, k FROM v) GROUP BY wall")
def slab_additions(spark, sf_dir):
    """Voxels of each wall's slab that no point occupies."""
    d = W.additions(_extents(spark, sf_dir), _layers(spark, sf_dir))
    return d.groupBy("wall").agg(F.count("*").alias("n"), F.sum(F.col("bin") * 100 + F.col("k")).alias("places"))


_R = "(0.004 + (id % 5) * 0.003)"
_BOX = f"(SELECT id, label, {', '.join(f'{a} - {_R} AS {a}0, {a} + {_R} AS {a}1' for a in 'xyz')} FROM {EMB})"


def _boxes(spark, sf_dir):
    r = 0.004 + F.col("id") % 5 * 0.003
    return vectors(spark, sf_dir).select("id", "label", *[(F.col(a) + s * r).alias(f"{a}{k}") for a in "xyz" for k, s in ((0, -1), (1, 1))])


_MEET = " AND ".join(f"a.{x}0 <= b.{x}1 - 0.001 AND b.{x}0 <= a.{x}1 - 0.001" for x in "xyz")


@query(f"""WITH RECURSIVE q AS (SELECT * FROM {_BOX}), m AS (SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON {_MEET} WHERE a.id <> b.id),
t AS (SELECT id AS node, id AS label FROM q UNION SELECT m.b, t.label FROM t JOIN m ON m.a = t.node), l AS (SELECT node, min(label) AS label FROM t GROUP BY node)
SELECT l.label, count(*) AS parts, {', '.join(f'round(min({x}0), 6) AS {x}0, round(max({x}1), 6) AS {x}1' for x in 'xyz')} FROM q JOIN l ON l.node = q.id GROUP BY l.label""")
def box_groups(spark, sf_dir):
    d = B.groups(_boxes(spark, sf_dir), 0.03, 0.001)
    return d.select("label", "parts", *[F.round(c, 6).alias(c) for c in B.SIDES])


_BOTH = " * ".join(f"greatest(least(t.{x}1, f.{x}1) - greatest(t.{x}0, f.{x}0), 0)" for x in "xyz")
_VOLUME = lambda p: " * ".join(f"({p}.{x}1 - {p}.{x}0)" for x in "xyz")


@query(f"""WITH q AS (SELECT * FROM {_BOX}), p AS (SELECT t.id, f.id AS other, round({_BOTH} / ({_VOLUME("t")} + {_VOLUME("f")} - {_BOTH}), 12) AS iou
 FROM q t JOIN q f ON f.label <> t.label AND {' AND '.join(f't.{x}0 <= f.{x}1 AND f.{x}0 <= t.{x}1' for x in 'xyz')} WHERE t.label < 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, other) AS r FROM p WHERE iou > 0) WHERE r = 1)
SELECT q.id, b.other, round(coalesce(b.iou, 0), 6) AS iou FROM q LEFT JOIN b ON b.id = q.id WHERE q.label < 3""")
def box_best_match(spark, sf_dir):
    """The boxes of the first three labels, each with the best of all other labels: a search of one label against the rest, label by label."""
    q = _boxes(spark, sf_dir)
    out = None
    for label in range(3):
        part = B.best_match(q.where(F.col("label") == label), q.where(F.col("label") != label), 0.03)
        out = part if out is None else out.unionByName(part)
    return out.select("id", "other", F.round("iou", 6).alias("iou"))


@query()
def straighten_walls(spark, sf_dir):
    """A stroke per return flag over all points: what goes and what comes."""
    p = points(spark, sf_dir)
    rows = p.select(F.xxhash64("o", "l", "p", "s").alias("id"), "flag", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), (F.col("z") / 4).alias("z"))
    ends = rows.groupBy("flag").agg(F.avg("x").alias("x"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    none = F.lit(None).cast("double")
    strokes = ends.select(F.col("flag").alias("wall"), F.col("x").alias("from_x"), F.col("y0").cast("double").alias("from_y"), F.col("x").alias("to_x"), F.col("y1").cast("double").alias("to_y"), F.lit(0.6).alias("width"), none.alias("thickness"), none.alias("bottom"), none.alias("top"), none.alias("above_floor"))
    gone, new = W.straighten(rows.select("id", "x", "y", "z"), strokes, 0.1, -0.05)
    return gone.select("wall", F.lit("remove").alias("what"), "id", F.lit(None).cast("float").alias("x"), F.lit(None).cast("float").alias("y"), F.lit(None).cast("float").alias("z")).unionByName(new.select("wall", F.lit("add").alias("what"), F.lit(None).cast("long").alias("id"), "x", "y", "z"))
