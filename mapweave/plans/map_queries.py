"""Frame lookups and the choices of a map build, on events as recordings: a user is a recording, a kind of event a stream, values are positions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from mapweave.operators import correction as K
from mapweave.operators import frames as R
from mapweave.operators import mapping as M
from mapweave.operators import temporal as T

from .registry import EV, events, query

HOUR, DAY = 3_600_000_000, 86_400_000_000
TOLERANCE = HOUR


def _side(kind: str, name: str) -> str:
    """SQL: samples of one kind, a row per time, and the value of that series at the probes p (id, t): linear between neighbours, held for TOLERANCE outside."""
    return f"""{name}s AS (SELECT t, v FROM (SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY id) AS r FROM {EV} WHERE kind = '{kind}') WHERE r = 1),
{name}a AS (SELECT p.id, p.t, s.t AS t0, s.v AS v0 FROM p ASOF LEFT JOIN {name}s s ON p.t >= s.t), {name}b AS (SELECT p.id, p.t, s.t AS t1, s.v AS v1 FROM p ASOF LEFT JOIN {name}s s ON p.t <= s.t),
{name} AS (SELECT a.id, a.t, CASE WHEN t0 = t1 THEN v0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * (CAST(a.t - t0 AS DOUBLE) / (t1 - t0))
  WHEN t0 IS NULL AND t1 - a.t <= {TOLERANCE} THEN v1 WHEN t1 IS NULL AND a.t - t0 <= {TOLERANCE} THEN v0 END AS v FROM {name}a a JOIN {name}b b ON b.id = a.id AND b.t = a.t)"""


def _pose(x, y, z, turn: float = 0.0):
    q = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(math.sin(turn / 2)).alias("z"), F.lit(math.cos(turn / 2)).alias("w"))
    return F.struct(F.struct(x.alias("x"), y.alias("y"), z.alias("z")).alias("t"), q.alias("q")).cast(R.POSE).alias("pose")


def _edge(e, kind: str, parent: str, child: str, pose):
    return e.where(F.col("kind") == kind).select(F.lit(parent).alias("parent"), F.lit(child).alias("child"), "t", F.col("id").alias("seq"), pose)


def _tree(e):
    """world -> odom moves along x, odom -> base is a fixed quarter turn, camera -> base moves along y."""
    zero, v = F.lit(0.0), F.col("v")
    return _edge(e, "view", "world", "odom", _pose(v, zero, zero)).unionByName(_edge(e, "purchase", "odom", "base", _pose(F.lit(1.0), F.lit(2.0), F.lit(0.5), math.pi / 2))).unionByName(_edge(e, "signup", "camera", "base", _pose(zero, v, zero)))


@query(f"WITH p AS (SELECT id, t FROM {EV} WHERE kind = 'click'), {_side('view', 'm')}, {_side('signup', 'w')} SELECT m.id, round(m.v + 1 + w.v, 5) AS x, CASE WHEN m.v + w.v IS NOT NULL THEN 2.0 END AS y, CASE WHEN m.v + w.v IS NOT NULL THEN 0.5 END AS z FROM m JOIN w ON w.id = m.id")
def frame_lookup(spark, sf_dir):
    """Up two edges and down one against its direction; null where an edge does not answer."""
    e = events(spark, sf_dir)
    d = R.lookup(e.where("kind = 'click'").select("id", "t"), _tree(e), "world", "camera", TOLERANCE)
    return d.select("id", *[F.round(F.col(f"pose.t.{a}"), 5).alias(a) for a in "xyz"])


@query(f"""WITH p AS (SELECT id, t FROM {EV} WHERE kind = 'click' UNION ALL SELECT id, t + {6 * HOUR} FROM {EV} WHERE kind = 'click'), {_side('view', 'm')}
SELECT e.id, round(CAST(e.v + a.v - b.v AS FLOAT)::DOUBLE, 2) AS x FROM {EV} e JOIN m a ON a.id = e.id AND a.t = e.t JOIN m b ON b.id = e.id AND b.t = e.t + {6 * HOUR} WHERE e.kind = 'click' AND a.v IS NOT NULL AND b.v IS NOT NULL""")
def deskew(spark, sf_dir):
    """Points moved to the end of their scan, six hours later, along the motion."""
    e = events(spark, sf_dir)
    p = e.where("kind = 'click'").select("id", "t", (F.col("t") + 6 * HOUR).alias("end"), F.col("v").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    motion = _edge(e, "view", "w", "s", _pose(F.col("v"), F.lit(0.0), F.lit(0.0))).select("t", "seq", "pose")
    return R.deskewed(p, motion, TOLERANCE).select("id", F.round(F.col("x").cast("double"), 2).alias("x"))


_SCANS = f"(SELECT id, t AS log, CASE WHEN id % 5 = 0 THEN 0 ELSE t - {3 * DAY} + (id % 7) * {HOUR} END AS stamp, v FROM {EV} WHERE kind = 'click')"


def _scans(e):
    stamp = F.when(F.col("id") % 5 == 0, F.lit(0)).otherwise(F.col("t") - 3 * DAY + F.col("id") % 7 * HOUR).cast("long")
    return e.where("kind = 'click'").select("id", F.lit("s").alias("stream"), F.col("id").alias("seq"), F.col("t").alias("log"), stamp.alias("stamp"), F.lit("lidar").alias("frame"), F.when(F.col("id") % 2 == 0, _pose(-F.col("v"), F.lit(0.0), F.lit(0.0))).alias("stored"))


def _lidar(e):
    return _edge(e, "view", "odom", "lidar", _pose(F.col("v"), F.lit(0.0), F.lit(0.0)))


_OFFSET = f"o AS (SELECT CASE WHEN abs(m) <= 500000 THEN 0 ELSE m END AS shift FROM (SELECT min(log - stamp) AS m FROM {_SCANS} WHERE stamp > 0)), ends AS (SELECT min(t) AS first, max(t) AS last FROM {EV} WHERE kind = 'view')"
_PLACED = lambda by: f"(SELECT count(*) FROM {_SCANS} WHERE stamp > 0 AND stamp + {by} BETWEEN first - {TOLERANCE} AND last + {TOLERANCE})"


@query(f"WITH {_OFFSET}, c AS (SELECT shift, {_PLACED('0')} AS as_is, {_PLACED('shift')} AS moved FROM o, ends) SELECT CAST(shift AS BIGINT) AS shift, as_is, moved, CAST(CASE WHEN moved > as_is THEN shift ELSE 0 END AS BIGINT) AS chosen FROM c")
def scan_clock(spark, sf_dir):
    """The stamps' offset to the log clock, how many scans tf places without and with it, and what is chosen."""
    e = events(spark, sf_dir)
    s, tf = _scans(e), _lidar(e)
    return spark.createDataFrame([M.clock_choice(s, tf, "odom", "lidar", TOLERANCE)], "shift long, as_is long, moved long, chosen long")


@query(f"""WITH {_OFFSET}, p AS (SELECT id, stamp + shift AS t FROM {_SCANS}, o WHERE stamp > 0 UNION ALL SELECT -id, log FROM {_SCANS}), {_side('view', 'm')}
SELECT s.id, round(coalesce(a.v, b.v, CASE WHEN s.id % 2 = 0 THEN -s.v END), 5) AS x FROM {_SCANS} s LEFT JOIN m a ON a.id = s.id AND s.stamp > 0 AND a.id > 0 LEFT JOIN m b ON b.id = -s.id AND b.t = s.log""")
def scan_poses(spark, sf_dir):
    """Each scan's pose: by its stamp on the log clock, else by its log time, else as stored with it, else none."""
    e = events(spark, sf_dir)
    s, tf = _scans(e), _lidar(e)
    shift = T.clock_offset(s, "stamp", "log").first()["offset"]
    d = M.sensor_poses(s, M.Placement("tf", "odom", "lidar", shift), tf, s.limit(0), TOLERANCE)
    return d.select("id", F.round("sensor.t.x", 5).alias("x"))


#: Streams of a recording: names and kinds by kind of event; the clicks correct the views where their number is even; errors are odometry, in half of all recordings none.
_STREAMS = f"""(SELECT u, CASE k WHEN 'view' THEN '/a/view' WHEN 'click' THEN '/b/click' WHEN 'purchase' THEN '/a/local_map' WHEN 'signup' THEN CASE WHEN u % 3 = 0 THEN '/c/imu' ELSE '/b/imu' END ELSE '/odom' END AS stream,
 CASE k WHEN 'signup' THEN 'imu' WHEN 'error' THEN 'odometry' ELSE 'cloud' END AS kind, CASE WHEN k = 'error' AND u % 2 = 0 THEN 0 ELSE n END AS count, CASE WHEN k = 'click' AND n % 2 = 0 THEN '/a/view' END AS derived_from
 FROM (SELECT u, kind AS k, count(*) AS n FROM {EV} GROUP BY u, kind))"""


def _streams(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("u", "kind").agg(F.count("*").alias("n"))
    k, u = F.col("kind"), F.col("u")
    name = F.when(k == "view", "/a/view").when(k == "click", "/b/click").when(k == "purchase", "/a/local_map").when(k == "signup", F.when(u % 3 == 0, "/c/imu").otherwise("/b/imu")).otherwise("/odom")
    kind = F.when(k == "signup", "imu").when(k == "error", "odometry").otherwise("cloud")
    return n.select("u", name.alias("stream"), kind.alias("kind"), F.when((k == "error") & (u % 2 == 0), F.lit(0)).otherwise(F.col("n")).cast("long").alias("count"), F.when((k == "click") & (F.col("n") % 2 == 0), "/a/view").alias("derived_from"))


@query(f"""WITH s AS (SELECT * FROM {_STREAMS} WHERE kind = 'cloud'), c AS (SELECT DISTINCT u, derived_from AS stream FROM s WHERE derived_from IS NOT NULL)
SELECT s.u, s.stream, row_number() OVER (PARTITION BY s.u ORDER BY contains(s.stream, 'map'), c.stream IS NOT NULL, count DESC, s.stream) AS rank FROM s LEFT JOIN c ON c.u = s.u AND c.stream = s.stream""")
def cloud_streams(spark, sf_dir):
    """Per recording its cloud streams, the one to build from first."""
    return M.ranked_clouds(_streams(spark, sf_dir), ["u"]).select("u", "stream", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH s AS (SELECT *, regexp_replace(stream, '/[^/]*$', '') AS prefix FROM {_STREAMS} WHERE count > 0), i AS (SELECT u, stream AS imu, prefix, count(*) OVER (PARTITION BY u) AS imus FROM s WHERE kind = 'imu'),
l AS (SELECT * FROM s WHERE kind = 'cloud' AND derived_from IS NULL AND NOT regexp_matches(lower(stream), 'map|accumulated|aggregated|voxel') AND u NOT IN (SELECT u FROM s WHERE kind = 'odometry'))
SELECT u, lidar, imu FROM (SELECT l.u, l.stream AS lidar, imu, row_number() OVER (PARTITION BY l.u ORDER BY l.prefix <> i.prefix, l.count DESC, l.stream, imu) AS r FROM l JOIN i ON i.u = l.u WHERE l.prefix = i.prefix OR imus = 1) WHERE r = 1""")
def lidar_and_imu(spark, sf_dir):
    return M.lidar_and_imu(_streams(spark, sf_dir), ["u"])


@query("SELECT child, parent FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY samples DESC, parent) AS r FROM (SELECT l_partkey AS child, l_suppkey AS parent, count(*) AS samples FROM lineitem GROUP BY 1, 2)) WHERE r = 1")
def frame_parents(spark, sf_dir):
    """Of several edges into a frame, the one with the most samples."""
    from .registry import points

    g = points(spark, sf_dir).groupBy(F.col("p").alias("child"), F.col("s").alias("parent")).agg(F.count("*").alias("samples"), F.lit(False).alias("fixed"))
    return M.parent_of(g).select("child", "parent")


@query(f"""WITH k AS (SELECT u, t, v FROM (SELECT *, row_number() OVER (PARTITION BY u, t ORDER BY id) AS r FROM {EV} WHERE kind = 'view') WHERE r = 1),
n AS (SELECT u, min(t) AS a, max(t) AS b FROM {EV} WHERE kind = 'click' GROUP BY u),
p AS (SELECT u, unnest(range(a, b + 1, {DAY})) AS t FROM n UNION SELECT k.u, k.t FROM k JOIN n ON n.u = k.u AND k.t BETWEEN a AND b UNION SELECT u, b FROM n),
x AS (SELECT p.u, p.t, k.t AS t0, k.v AS v0 FROM p ASOF LEFT JOIN k ON p.u = k.u AND p.t >= k.t), y AS (SELECT p.u, p.t, k.t AS t1, k.v AS v1 FROM p ASOF LEFT JOIN k ON p.u = k.u AND p.t <= k.t)
SELECT x.u, x.t, round(CASE WHEN t0 = t1 THEN v0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * (CAST(x.t - t0 AS DOUBLE) / (t1 - t0)) ELSE coalesce(v0, v1) END, 5) AS x FROM x JOIN y ON y.u = x.u AND y.t = x.t""")
def edge_samples(spark, sf_dir):
    """Per user the correction every day between its first and last click, at every keyframe (view) between them, and at the end."""
    e = events(spark, sf_dir)
    keys = e.where("kind = 'view'").select("u", "t", F.col("id").alias("seq"), _pose(F.col("v"), F.lit(0.0), F.lit(0.0)))
    spans = e.where("kind = 'click'").groupBy("u").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    d = K.correction_at(K.sample_times(spans, keys, DAY, "u"), keys, "u")
    return d.select("u", "t", F.round("correction.t.x", 5).alias("x"))


@query(f"""WITH s AS (SELECT *, sum(new) OVER (PARTITION BY u, kind ORDER BY t, v, id % 7) AS visit FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u, kind ORDER BY t, v, id % 7) > {2 * DAY} THEN 1 ELSE 0 END AS new FROM {EV})),
c AS (SELECT u, kind, visit, avg(v) AS x, avg(id % 7) AS y FROM s GROUP BY u, kind, visit), m AS (SELECT u, kind, sqrt(var_pop(x) + var_pop(y)) AS spread FROM c GROUP BY u, kind HAVING count(*) >= 2)
SELECT u, count(*) AS markers, round(avg(spread), 6) AS spread FROM m GROUP BY u""")
def tag_spread(spark, sf_dir):
    """Per recording, how far the visits of a marker (a kind of event, seen again after two days) lie apart."""
    e = events(spark, sf_dir)
    d = e.select("u", F.col("kind").alias("marker"), "t", F.col("v").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return K.tag_spread(d, ["u"], gap=2 * DAY).select("u", "markers", F.round("spread", 6).alias("spread"))
