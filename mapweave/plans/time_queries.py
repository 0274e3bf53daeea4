"""Time series and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions.picks import ranked
from mapweave.operators import catalog as C
from mapweave.operators import temporal as T

from .registry import EV, PTS, events, points, query, table

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _bracket_sql(tolerance: int) -> str:
    return f"""
WITH e AS (SELECT * FROM {EV}), p AS (SELECT * FROM e WHERE kind = 'click'),
s AS (SELECT u, t, v FROM (SELECT *, row_number() OVER (PARTITION BY u, t ORDER BY id) AS r FROM e WHERE kind = 'view') WHERE r = 1),
own AS (SELECT u, min(v) AS lo, max(v) AS hi FROM e WHERE kind = 'view' GROUP BY u),
a AS (SELECT p.id, s.t AS t0, s.v AS v0 FROM p ASOF LEFT JOIN s ON p.u = s.u AND p.t >= s.t),
b AS (SELECT p.id, s.t AS t1, s.v AS v1 FROM p ASOF LEFT JOIN s ON p.u = s.u AND p.t <= s.t)
SELECT p.id, t0, t1, round(CASE WHEN hi - lo <= 1e-6 THEN coalesce(v0, v1)
  WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (CAST(p.t - t0 AS DOUBLE) / (t1 - t0)) END
  WHEN t0 IS NULL THEN CASE WHEN t1 - p.t <= {tolerance} THEN v1 END ELSE CASE WHEN p.t - t0 <= {tolerance} THEN v0 END END, 6) AS at
FROM p JOIN a ON a.id = p.id JOIN b ON b.id = p.id LEFT JOIN own ON own.u = p.u"""


def _at(spark, sf_dir, tolerance):
    e = events(spark, sf_dir)
    d = T.interpolated(e.where("kind = 'click'"), e.where("kind = 'view'"), ["u"], "t", "v", "id", tolerance)
    return d.select("id", "t0", "t1", F.round("at", 6).alias("at"))


@query(_bracket_sql(365 * DAY))
def asof_interpolate(spark, sf_dir):
    return _at(spark, sf_dir, 365 * DAY)


@query(_bracket_sql(2 * HOUR))
def asof_tolerance(spark, sf_dir):
    return _at(spark, sf_dir, 2 * HOUR)


_SIDES = f"""WITH e AS (SELECT * FROM {EV}), p AS (SELECT * FROM e WHERE kind = 'purchase'),
s AS (SELECT u, t, v FROM (SELECT *, row_number() OVER (PARTITION BY u, t ORDER BY id) AS r FROM e WHERE kind = 'view') WHERE r = 1),
a AS (SELECT p.id, p.t, s.t AS t0, s.v AS v0 FROM p ASOF LEFT JOIN s ON p.u = s.u AND p.t >= s.t),
b AS (SELECT p.id, s.t AS t1, s.v AS v1 FROM p ASOF LEFT JOIN s ON p.u = s.u AND p.t <= s.t)"""


def _sides(spark, sf_dir):
    e = events(spark, sf_dir)
    return T.bracket(e.where("kind = 'purchase'"), e.where("kind = 'view'"), ["u"], "t", "v", "id")


@query(f"{_SIDES} SELECT a.id, b.t1 AS at, b.v1 AS v FROM a JOIN b ON a.id = b.id WHERE b.t1 - a.t <= {6 * HOUR}")
def asof_forward(spark, sf_dir):
    return _sides(spark, sf_dir).where(F.col("t1") - F.col("t") <= 6 * HOUR).select("id", F.col("t1").alias("at"), F.col("v1").alias("v"))


@query(f"{_SIDES} SELECT a.id, CASE WHEN t1 IS NULL OR a.t - t0 <= t1 - a.t THEN t0 ELSE t1 END AS at, CASE WHEN t1 IS NULL OR a.t - t0 <= t1 - a.t THEN v0 ELSE v1 END AS v FROM a JOIN b ON a.id = b.id WHERE t0 IS NOT NULL OR t1 IS NOT NULL")
def nearest_in_time(spark, sf_dir):
    d = _sides(spark, sf_dir).where("t0 is not null or t1 is not null")
    back = F.col("t1").isNull() | (F.col("t") - F.col("t0") <= F.col("t1") - F.col("t"))
    return d.select("id", F.when(back, F.col("t0")).otherwise(F.col("t1")).alias("at"), F.when(back, F.col("v0")).otherwise(F.col("v1")).alias("v"))


_SESSIONS = f"""(SELECT id, u, t, v, CAST(sum(new) OVER (PARTITION BY u ORDER BY t, id) AS BIGINT) AS session
  FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t, id) > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM {EV}))"""


def _sessions(spark, sf_dir):
    return T.gap_sessions(events(spark, sf_dir), ["u"], "t", 6 * HOUR, ["id"])


@query(f"SELECT id, u, session FROM {_SESSIONS}")
def gap_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("id", "u", "session")


@query(f"""WITH c AS (SELECT u, session, avg(v) AS c, count(*) AS n FROM {_SESSIONS} GROUP BY u, session), m AS (SELECT u, avg(c) AS m, count(*) AS visits, sum(n) AS n FROM c GROUP BY u)
SELECT m.u, m.visits, CAST(m.n AS BIGINT) AS n, round(sqrt(avg((c.c - m.m) * (c.c - m.m))), 6) AS spread FROM c JOIN m ON c.u = m.u WHERE m.visits >= 2 GROUP BY m.u, m.visits, m.n""")
def session_summary(spark, sf_dir):
    """Per marker: visits and the spread of their centroids about their mean."""
    c = _sessions(spark, sf_dir).groupBy("u", "session").agg(F.avg("v").alias("c"), F.count("*").alias("n"))
    return c.groupBy("u").agg(F.count("*").alias("visits"), F.sum("n").alias("n"), F.round(F.stddev_pop("c"), 6).alias("spread")).where("visits >= 2")


@query(f"""SELECT id, round(coalesce(CASE WHEN bt BETWEEN 1 AND {12 * HOUR} THEN bv / bt * 1e6 END, CASE WHEN lt BETWEEN 1 AND {12 * HOUR} THEN lv / lt * 1e6 END), 9) AS speed FROM (
  SELECT id, abs(t - lag(t) OVER w) AS bt, abs(v - lag(v) OVER w) AS bv, abs(t - lead(t) OVER w) AS lt, abs(v - lead(v) OVER w) AS lv FROM {EV} WINDOW w AS (PARTITION BY u ORDER BY t, id))""")
def neighbour_speed(spark, sf_dir):
    d = T.neighbour_speed(events(spark, sf_dir), ["u"], "t", "v", ["id"], 1, 12 * HOUR)
    return d.select("id", F.round("speed", 9).alias("speed"))


@query(f"""SELECT u, round(sum(step), 4) AS length, round(max(step), 4) AS longest, round(abs(arg_max(v, n) - arg_min(v, n)), 4) AS start_to_end FROM (
  SELECT u, v, row_number() OVER w AS n, abs(v - lag(v) OVER w) AS step FROM {EV} WINDOW w AS (PARTITION BY u ORDER BY t, id)) GROUP BY u HAVING count(*) > 1""")
def path_length(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("u").orderBy("t", "id")
    d = events(spark, sf_dir).withColumns({"step": F.abs(F.col("v") - F.lag("v").over(w)), "n": F.row_number().over(w)})
    ends = F.abs(F.max_by("v", "n") - F.min_by("v", "n"))
    return d.groupBy("u").agg(F.round(F.sum("step"), 4).alias("length"), F.round(F.max("step"), 4).alias("longest"), F.round(ends, 4).alias("start_to_end"), F.count("*").alias("c")).where("c > 1").drop("c")


def _kept_sql(test: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, id) AS n FROM {EV}),
r AS (SELECT id, u, n, v AS kv, t AS kt, true AS keep FROM o WHERE n = 1
  UNION ALL SELECT o.id, o.u, o.n, CASE WHEN {test} THEN o.v ELSE r.kv END, CASE WHEN {test} THEN o.t ELSE r.kt END, {test} FROM r JOIN o ON o.u = r.u AND o.n = r.n + 1)
SELECT id, u FROM r WHERE keep"""


@query(_kept_sql("(abs(o.v - r.kv) > 20)"))
def keyframe_thin(spark, sf_dir):
    return T.last_kept(events(spark, sf_dir), ["u"], ["t", "id"], lambda a, b: abs(b.v - a.v) > 20).select("id", "u")


@query(_kept_sql(f"(o.t - r.kt >= {DAY})"))
def rate_limit(spark, sf_dir):
    return T.last_kept(events(spark, sf_dir), ["u"], ["t", "id"], lambda a, b: b.t - a.t >= DAY).select("id", "u")


@query(f"""WITH s AS (SELECT u, t, v FROM (SELECT *, row_number() OVER (PARTITION BY u, t ORDER BY id) AS r FROM {EV}) WHERE r = 1),
p AS (SELECT u, unnest(range(a, b + 1, {DAY})) AS t FROM (SELECT u, min(t) AS a, max(t) AS b FROM s GROUP BY u)),
a AS (SELECT p.u, p.t, s.t AS t0, s.v AS v0 FROM p ASOF JOIN s ON p.u = s.u AND p.t >= s.t), b AS (SELECT p.u, p.t, s.t AS t1, s.v AS v1 FROM p ASOF JOIN s ON p.u = s.u AND p.t <= s.t)
SELECT a.u, a.t, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (CAST(a.t - t0 AS DOUBLE) / (t1 - t0)) END, 6) AS at FROM a JOIN b ON a.u = b.u AND a.t = b.t""")
def resample_grid(spark, sf_dir):
    e = events(spark, sf_dir)
    d = T.interpolated(T.grid(e, ["u"], "t", DAY), e, ["u"], "t", "v", "id", 365 * DAY)
    return d.select("u", "t", F.round("at", 6).alias("at"))


@query(f'SELECT CAST(CASE WHEN abs(o) <= 500000 THEN 0 ELSE o END AS BIGINT) AS "offset" FROM (SELECT min(143000000 + (id % 31) * 10000) AS o FROM {EV})')
def clock_offset(spark, sf_dir):
    d = events(spark, sf_dir).select("t", (F.col("t") - 143_000_000 - F.col("id") % 31 * 10_000).alias("stamp"))
    return T.clock_offset(d, "stamp", "t")


@query(f"SELECT kind, id, t, v FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY t DESC, id DESC) AS r FROM {EV}) WHERE r = 1")
def newest_per_topic(spark, sf_dir):
    return C.newest(events(spark, sf_dir), ["kind"], ["t", "id"], ["id", "t", "v"])


_GEN = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders)"


def _generations(spark, sf_dir):
    return C.generations(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM " + _GEN + " WHERE age = 1")
def newest_generation(spark, sf_dir):
    return C.newest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query(f"SELECT o_custkey, o_orderkey, age FROM {_GEN} WHERE age > 1")
def superseded(spark, sf_dir):
    return _generations(spark, sf_dir).where("age > 1").select("o_custkey", "o_orderkey", "age")


@query(f"SELECT o_orderpriority AS topic, count(*) AS n, min(o_orderkey) AS first_key FROM {_GEN} WHERE age <= 3 GROUP BY o_orderpriority")
def channel_counts(spark, sf_dir):
    return _generations(spark, sf_dir).where("age <= 3").groupBy(F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""SELECT c.c_custkey, c.c_nationkey, c.c_custkey % 3 AS channel FROM customer c LEFT JOIN (SELECT n_nationkey, n_nationkey % 3 AS want FROM nation WHERE n_regionkey < 3) o ON c.c_nationkey = o.n_nationkey
WHERE want IS NULL OR want = c.c_custkey % 3""")
def edge_override(spark, sf_dir):
    edges = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 3).alias("channel"))
    over = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 3).cast("long").alias("channel"))
    return C.overridden(edges, over, ["c_nationkey"], "channel")


@query(f"SELECT id, u, v FROM {EV} WHERE kind = 'view' AND u NOT IN (SELECT u FROM {EV} WHERE kind = 'purchase' AND v > 60) UNION ALL SELECT id, u, v FROM {EV} WHERE kind = 'purchase' AND v > 60")
def replace_edge(spark, sf_dir):
    e = events(spark, sf_dir).select("id", "u", "v", "kind")
    return C.replaced(e.where("kind = 'view'"), e.where("kind = 'purchase' and v > 60"), ["u"]).select("id", "u", "v")


@query("SELECT 'v' || min(n) AS name FROM (SELECT unnest(range(1, 30)) AS n) WHERE n NOT IN (SELECT n_nationkey + 1 FROM nation WHERE n_nationkey <> 7)")
def first_free_name(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey <> 7").select(F.concat(F.lit("v"), (F.col("n_nationkey") + 1).cast("string")).alias("name"))
    return C.first_free(names, "name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def stale_streams(spark, sf_dir):
    written = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(written, "c_custkey", "left_anti")


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, id) AS n FROM {EV} WHERE kind = 'click'), b AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, id) AS n FROM {EV} WHERE kind = 'view')
SELECT a.u, a.id, b.id AS id_tag, b.props AS props_tag FROM a LEFT JOIN b ON a.u = b.u AND a.n = b.n""")
def positional_zip_tags(spark, sf_dir):
    e = events(spark, sf_dir)
    d = C.zipped(e.where("kind = 'click'").select("u", "t", "id"), e.where("kind = 'view'").select("u", "t", "id", "props"), ["u"], ["t", "id"])
    return d.select("u", "id", "id_tag", "props_tag")


@query("SELECT event_id AS id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.speed') AS DOUBLE), -1) AS speed FROM events")
def tag_json_fields(spark, sf_dir):
    """Tag fields with their defaults."""
    d = events(spark, sf_dir)
    return d.select("id", C.json_number(F.col("props"), "$.k").alias("k"), F.coalesce(C.json_number(F.col("props"), "$.speed"), F.lit(-1.0)).alias("speed"))


_GATES = "CASE WHEN x < 5 THEN 'blur' WHEN y > 80 THEN 'reproj' WHEN z < 1 THEN 'small' WHEN x > 40 THEN 'far' WHEN nz > 0.5 THEN 'oblique' WHEN nx >= 0.6 THEN 'motion' END"


def _reasons(spark, sf_dir):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    gates = [("blur", x < 5), ("reproj", y > 80), ("small", z < 1), ("far", x > 40), ("oblique", F.col("nz") > 0.5), ("motion", F.col("nx") >= 0.6)]
    return points(spark, sf_dir).withColumn("reason", C.first_failing(gates))


@query(f"SELECT o, l, p, s, {_GATES} AS reason FROM {PTS}")
def gate_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).select("o", "l", "p", "s", "reason")


@query(f"SELECT flag, count(*) AS raw, count(*) FILTER (WHERE reason IS NULL) AS passed, count(*) FILTER (WHERE reason = 'blur') AS blur, count(*) FILTER (WHERE reason = 'far') AS far FROM (SELECT flag, {_GATES} AS reason FROM {PTS}) GROUP BY flag")
def gate_report(spark, sf_dir):
    d = _reasons(spark, sf_dir)
    n = lambda c, name: F.count_if(c).alias(name)
    return d.groupBy("flag").agg(F.count("*").alias("raw"), n(F.col("reason").isNull(), "passed"), n(F.col("reason") == "blur", "blur"), n(F.col("reason") == "far", "far"))


@query(f"SELECT s, flag, o, l, p, y FROM (SELECT *, row_number() OVER (PARTITION BY s, flag ORDER BY y, o, l, p) AS r FROM {PTS}) WHERE r = 1")
def best_per_key(spark, sf_dir):
    d = points(spark, sf_dir).groupBy("s", "flag").agg(F.min(F.struct("y", "o", "l", "p")).alias("best"))
    return d.select("s", "flag", "best.o", "best.l", "best.p", "best.y")


@query(f"SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY t, id) - 1 AS n FROM {EV}) WHERE n % 5 = 0")
def every_nth(spark, sf_dir):
    return C.every_nth(events(spark, sf_dir), ["kind"], ["t", "id"], 5).select("id", "kind")


@query(f"SELECT id, t FROM (SELECT *, row_number() OVER (ORDER BY t, id) - 1 AS n, count(*) OVER () AS c FROM {EV}) WHERE n % greatest(c // 40, 1) = 0 AND n // greatest(c // 40, 1) < 40")
def even_sample(spark, sf_dir):
    """At most 40 rows, evenly over the whole order: the sample of a region summary."""
    d = events(spark, sf_dir).select("id", "t")
    step = max(d.count() // 40, 1)
    return ranked(d, "t", "id").where((F.col("rank") % step == 0) & (F.col("rank") < 40 * step)).select("id", "t")


@query(f"SELECT u, kind = 'view' AS visible FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t DESC, id DESC) AS r FROM {EV} WHERE kind IN ('click', 'view')) WHERE r = 1")
def undo_replay(spark, sf_dir):
    return C.replayed(events(spark, sf_dir), "u", ["t", "id"], F.col("kind") == "click", F.col("kind") == "view")


_EDGES = "(SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"


def _edges(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey")]
    out = None
    for t, a, child, b, parent in parts:
        d = table(spark, sf_dir, t).select(key(a, child).alias("child"), key(b, parent).alias("parent"))
        out = d if out is None else out.unionByName(d)
    return out


_TREE = f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), t AS (SELECT DISTINCT parent AS node, parent AS root, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, t.root, t.depth + 1 FROM t JOIN e ON e.parent = t.node)"


@query(f"{_TREE} SELECT root, count(*) AS frames, CAST(max(depth) AS BIGINT) AS deepest FROM t GROUP BY root")
def frame_tree(spark, sf_dir):
    return C.ancestors(_edges(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("frames"), F.max("depth").alias("deepest"))


@query(f"{_TREE} SELECT node, CAST(depth AS BIGINT) AS depth FROM t")
def frame_depth(spark, sf_dir):
    return C.ancestors(_edges(spark, sf_dir)).select("node", "depth")


@query("SELECT o_orderkey, 'r' || n_regionkey || '>n' || n_nationkey || '>c' || c_custkey || '>o' || o_orderkey AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def path_to_root(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    d = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    hop = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return d.select("o_orderkey", F.concat_ws(">", hop("r", "n_regionkey"), hop("n", "n_nationkey"), hop("c", "c_custkey"), hop("o", "o_orderkey")).alias("path"))


_CODES = [(i * 40503 + 12345) % 65536 for i in range(16)]  # 16-bit codes by a rule
_BITS = ", ".join(f"({i}, {c})" for i, c in enumerate(_CODES))


@query(f"""SELECT p_partkey, CAST(d AS BIGINT) AS marker, CAST(dist AS BIGINT) AS distance FROM (SELECT p_partkey, d, bit_count(xor(CAST((p_partkey * 25173 + 13849) % 65536 AS INTEGER), c)) AS dist,
 row_number() OVER (PARTITION BY p_partkey ORDER BY bit_count(xor(CAST((p_partkey * 25173 + 13849) % 65536 AS INTEGER), c)), d) AS r FROM part, (VALUES {_BITS}) k(d, c)) WHERE r = 1 AND dist <= 3""")
def hamming_match(spark, sf_dir):
    code = ((F.col("p_partkey") * 25173 + 13849) % 65536).cast("int")
    best = F.array_min(F.array(*[F.struct(F.bit_count(code.bitwiseXOR(F.lit(c))).cast("long").alias("distance"), F.lit(i).cast("long").alias("marker")) for i, c in enumerate(_CODES)]))
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("b")).select("p_partkey", "b.marker", "b.distance").where("distance <= 3")


@query("""WITH g AS (SELECT (a.i + 0.5) / 40 * 3.0 AS x, (b.i + 0.5) / 40 * 3.0 AS y, (c.i + 0.5) / 40 * 2.0 AS z FROM range(40) a(i), range(40) b(i), range(40) c(i)),
f AS (SELECT abs(x - 1.0) <= 1.0 AND abs(y - 1.0) <= 1.0 AND abs(z - 0.5) <= 0.5 AS p, abs(x - 1.5) <= 1.0 AND abs(y - 1.5) <= 1.0 AND abs(z - 0.75) <= 0.75 AS q FROM g)
SELECT count(*) FILTER (WHERE p AND q) AS both, count(*) FILTER (WHERE p OR q) AS either, round(count(*) FILTER (WHERE p AND q) / count(*) FILTER (WHERE p OR q), 6) AS iou FROM f""")
def iou_grid(spark, sf_dir):
    """Of two boxes, sampled on a 40 x 40 x 40 grid over their common bounds."""
    from mapweave.functions.geometry import in_box

    n = 40
    at = lambda i, size: (i + 0.5) / n * size
    d = spark.range(n**3).select(at(F.col("id") % n, 3.0).alias("x"), at(F.floor(F.col("id") / n) % n, 3.0).alias("y"), at(F.floor(F.col("id") / n / n), 2.0).alias("z"))
    xyz = [F.col(c) for c in "xyz"]
    p, q = in_box(*xyz, (1.0, 1.0, 0.5), (2.0, 2.0, 1.0)), in_box(*xyz, (1.5, 1.5, 0.75), (2.0, 2.0, 1.5))
    d = d.agg(F.count_if(p & q).alias("both"), F.count_if(p | q).alias("either"))
    return d.withColumn("iou", F.round(F.col("both") / F.col("either"), 6))
