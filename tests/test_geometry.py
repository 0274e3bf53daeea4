import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.functions import geometry as G
from mapweave.functions import picks
from mapweave.operators import catalog, fits, floors, spatial, temporal, voxels
from mapweave.streaming.live import Broadcast, Pending, matched


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_voxel_keys_on_the_grid(spark):
    """Points that lie on a 0.05 grid in 32 bits keep their own cell."""
    v = np.float32(0.05)
    p = (np.arange(-5000, 5000).astype(np.float32) * v).astype(np.float32)
    d = frame(spark, [(float(x),) for x in p], "x double").select(G.voxel_key(F.col("x").cast("float"), 0.05).alias("k"))
    assert [r[0] for r in d.collect()] == np.floor((p / v).astype(np.float32)).astype(int).tolist()


def test_quaternions(spark):
    h = math.sqrt(0.5)
    d = frame(spark, [(0.0, 0.0, h, h, 1.0, 0.0, 0.0)], "x double, y double, z double, w double, a double, b double, c double")
    q, p = F.struct("x", "y", "z", "w"), F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    r = d.select(G.rotate(q, p).alias("r"), G.yaw(q).alias("yaw"), G.multiply(q, G.conjugate(q)).alias("one")).first()
    assert np.allclose(r["r"], [0, 1, 0]) and math.isclose(r["yaw"], math.pi / 2) and np.allclose(r["one"], [0, 0, 0, 1])
    back = G.invert(p, q)
    assert np.allclose(d.select(G.place(back["t"], back["q"], G.place(p, q, p)).alias("v")).first()["v"], [1, 0, 0])
    same = F.struct(*[F.lit(x).alias(n) for n, x in zip("xyzw", (0.0, 0.0, 0.0, 1.0), strict=True)])
    half = d.select(G.slerp(same, q, F.lit(0.5)).alias("s")).first()["s"]
    assert np.allclose(half, [0, 0, math.sin(math.pi / 8), math.cos(math.pi / 8)])
    zero = d.select(G.quaternion(F.struct(*[(F.col(c) * 0).alias(c) for c in "xyzw"])).alias("q")).first()["q"]
    assert tuple(zero) == (0, 0, 0, 1)


def test_boxes_must_have_a_size(spark):
    with pytest.raises(ValueError):
        G.in_box(F.lit(0), F.lit(0), F.lit(0), (0, 0, 0), (1, 0, 1))


def test_picks(spark):
    d = frame(spark, [("a", float(v)) for v in (4, 1, 3, 2)] + [("b", None)], "k string, v double")
    assert [tuple(r) for r in picks.upper_median(d, ["k"], "v").collect()] == [("a", 4, 3.0)]
    r = picks.ranked(frame(spark, [(i * 7 % 101,) for i in range(101)], "v long").repartition(7), "v").collect()
    assert sorted((x["v"], x["rank"]) for x in r) == [(i, i) for i in range(101)]


def test_interpolation_rules(spark):
    s = frame(spark, [("e", 0, 0.0, 1), ("e", 10, 10.0, 2), ("e", 10, 99.0, 3), ("c", 143, 5.0, 1), ("c", 200, 5.0, 2)], "k string, t long, v double, seq long")
    p = frame(spark, [("e", 5), ("e", 10), ("e", 12), ("e", 20), ("c", 900), ("x", 1)], "k string, t long")
    got = {(r["k"], r["t"]): r["at"] for r in temporal.interpolated(p, s, ["k"], "t", "v", "seq", 3).collect()}
    assert got == {("e", 5): 5.0, ("e", 10): 10.0, ("e", 12): 10.0, ("e", 20): None, ("c", 900): 5.0, ("x", 1): None}


def test_clock_offset(spark):
    d = frame(spark, [(1_000_000, 144_010_000), (2_000_000, 145_000_000), (0, 5)], "s long, l long")
    assert temporal.clock_offset(d, "s", "l").first()[0] == 143_000_000
    d = frame(spark, [(1_000_000, 1_010_000)], "s long, l long")
    assert temporal.clock_offset(d, "s", "l").first()[0] == 0


def room():
    """A 3 m floor at 5 cm, a wall along y = 0, and three specks in the air."""
    floor = [(i * 0.05 + 0.02, j * 0.05 + 0.02, 0.05, 0.0, 0.0, 1.0) for i in range(60) for j in range(60)]
    wall = [(i * 0.05 + 0.02, 0.02, 0.07 + k * 0.05, 0.0, 1.0, 0.0) for i in range(60) for k in range(25)]
    specks = [(3.0, 3.0, 1.5, 0.0, 0.0, 0.0), (3.2, 3.1, 1.2, 0.0, 0.0, 0.0), (1.0, 2.0, 2.4, 0.0, 0.0, 0.0)]
    return [(i, *p) for i, p in enumerate(floor + wall + specks)]


@pytest.fixture(scope="module")
def points(spark):
    return frame(spark, room(), "id long, x double, y double, z double, nx double, ny double, nz double").cache()


def test_floating_specks(points):
    assert {r["id"] for r in spatial.floating(points, 0.1, 10).collect()} == {5100, 5101, 5102}


def test_levels_and_walls(points):
    up = voxels.levels(points, 0.05, 0.03, F.abs("nz") > 0.9).collect()
    assert len(up) == 1 and abs(up[0]["height"] - 0.05) < 0.05
    assert voxels.floor_points(points, [0.05], 0.08).count() == 3600
    assert voxels.wall_points(points, [0.05], 0.3).count() > 1000


def test_storeys():
    peaks = [(0.05, 3600), (3.05, 3500), (0.75, 60), (5.0, 900)]
    assert voxels.storeys(peaks, lambda z: 100 if z < 4 else 0) == [0.05, 3.05]


def test_wall_angle(spark):
    rows = [(math.cos(math.radians(17 + 90 * (i % 2))), math.sin(math.radians(17 + 90 * (i % 2))), 0.0) for i in range(200)]
    h = voxels.wall_angles(frame(spark, rows, "nx double, ny double, nz double")).collect()
    assert abs(voxels.dominant_angle([(r["bin"], r["weight"]) for r in h], 200) - 17) < 1
    assert voxels.dominant_angle([], 10) is None


def test_neighbours_match_brute_force(spark):
    p = np.random.Generator(np.random.PCG64(3)).random((120, 3))
    p[5] = p[6]
    d = frame(spark, [(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    far = np.linalg.norm(p[:, None] - p[None], axis=2)
    want = {(i, j) for i in range(120) for j in range(120) if far[i, j] <= 0.2}
    assert {(r["id"], r["other"]) for r in spatial.radius_join(d, d, 0.2).collect()} == want
    got = {(r["id"], r["rank"]): r["other"] for r in spatial.nearest(d, d, 2, 0.05).collect()}
    for i in range(120):
        order = sorted((j for j in range(120) if j != i), key=lambda j: (far[i, j], j))
        assert [got[i, k] for k in (1, 2)] == order[:2]


def test_components_of_a_long_path(spark):
    nodes = frame(spark, [(i,) for i in range(60)] + [(100,)], "node long")
    edges = frame(spark, [(i, i + 1) for i in range(59)], "a long, b long")
    got = {r["node"]: r["label"] for r in spatial.label_components(nodes, edges).collect()}
    assert set(got.values()) == {0, 100} and got[59] == 0


def test_flood_and_fill(spark):
    cells = frame(spark, [(x, y, 0.05 if x < 3 else 0.05 + (x - 2) * 0.2 if x < 5 else 3.0) for x in range(6) for y in range(3)], "cx long, cy long, height double")
    assert {r["cx"] for r in floors.flooded(cells, 0.0).collect()} == {0, 1, 2, 3, 4}
    got = {(r["cx"], r["cy"]): (r["height"], r["measured"]) for r in floors.filled(cells.where("cx <> 1 or cy <> 1").where("cx < 3"), 3, 3, 1).collect()}
    assert abs(got[1, 1][0] - 0.05) < 1e-9 and got[1, 1][1] is False and got[0, 0][1] is True
    assert floors.bands([0.0, 3.0]) == [(-0.6, 2.75), (2.75, 4.5)]
    assert floors.storey_at([0.0, 3.0], 2.6) == 3.0 and floors.storey_at([0.0], -1.0) is None


def test_height_between_cells(spark):
    cells = frame(spark, [(0, 0, 0.0), (1, 0, 1.0), (0, 1, 0.0), (1, 1, 1.0)], "cx long, cy long, height double")
    p = frame(spark, [(1, 0.25, 0.25), (2, 9.0, 9.0)], "id long, x double, y double")
    got = {r["id"]: r["floor_z"] for r in floors.height_at(p, cells, 0.0, 0.0, 0.25).collect()}
    assert math.isclose(got[1], 0.5) and got[2] is None


def test_catalogue_rules(spark):
    assert catalog.first_free(frame(spark, [("v1",), ("v2",), ("v4",), ("vx",)], "n string"), "n").first()[0] == "v3"
    assert catalog.first_free(frame(spark, [], "n string"), "n").first()[0] == "v1"
    log = frame(spark, [(1, 1, "d"), (1, 2, "u"), (2, 1, "d"), (3, 1, "u")], "i long, t long, k string")
    got = {r["i"]: r["visible"] for r in catalog.replayed(log, "i", ["t"], F.col("k") == "d", F.col("k") == "u").collect()}
    assert got == {1: True, 2: False, 3: True}


def test_robust_pose_ignores_an_outlier():
    t = np.r_[np.tile([1.0, 2.0, 3.0], (9, 1)), [[5.0, 5.0, 5.0]]]
    q = np.tile([0, 0, 0, 1.0], (10, 1))
    pos, rot = fits.robust_pose(t, q)
    assert np.linalg.norm(pos - [1, 2, 3]) < 0.05 and np.allclose(rot, [0, 0, 0, 1])


def test_robust_plane():
    r = np.random.Generator(np.random.PCG64(1))
    xy = r.random((200, 2)) * 4
    p = np.c_[xy, 0.1 * xy[:, 0] - 0.05 * xy[:, 1] + 1]
    p[:40, 2] += 1 + r.random(40)
    (a, b, c), n = fits.robust_plane(p, 0.03)
    assert np.allclose([a, b, c], [0.1, -0.05, 1]) and n == 160
    assert fits.robust_plane(p[:20], 0.03) is None
    assert fits.robust_plane(p[::-1], 0.03)[0] == (a, b, c)


def test_icp_room():
    g = np.arange(0, 3, 0.1)
    room_ = np.r_[[(x, y, 0) for x in g for y in g], [(x, 0, z) for x in g for z in g], [(0, y, z) for y in g for z in g]].astype(float)
    turn, move = fits.rotation(np.array([0, 0, 0.05])), np.array([0.15, -0.1, 0.05])
    r, t, err, fit = fits.icp((room_ - move) @ turn, room_, fits.local_normals(room_, 0.3))
    assert np.linalg.norm(t - move) < 0.01 and np.linalg.norm(fits.log_rotation(r @ turn.T)) < 0.005 and err < 1e-3 and fit > 0.9


def test_pose_graph_closes_a_loop():
    eye, info = np.eye(3), np.eye(6)
    square = [np.array(p, float) for p in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))]
    drift = [p + [0.05 * i, 0, 0] for i, p in enumerate(square)]
    factors = [(i, i + 1, (eye, drift[i + 1] - drift[i]), info) for i in range(3)] + [(0, 3, (eye, square[3]), info * 1e4)]
    out = fits.pose_graph([(eye, p) for p in drift], factors)
    assert np.linalg.norm(out[3][1] - square[3]) < 1e-3


def test_blocks_solve_as_the_dense_system_does():
    r = np.random.Generator(np.random.PCG64(4))
    for extra in ([], [(0, 19)], [(2, 11), (5, 17), (0, 19)]):
        full, blocks = np.zeros((120, 120)), [{} for _ in range(20)]
        for i, j in [(i, i + 1) for i in range(19)] + extra:
            jac = r.normal(size=(6, 12))
            at = np.r_[6 * i : 6 * i + 6, 6 * j : 6 * j + 6]
            full[np.ix_(at, at)] += jac.T @ jac
        full += np.eye(120)
        for i in range(20):
            for j in range(20):
                b = full[6 * i : 6 * i + 6, 6 * j : 6 * j + 6]
                if b.any():
                    blocks[i][j] = b.copy()
        g = r.normal(size=(20, 6))
        assert np.allclose(fits.solve_blocks(blocks, g).ravel(), np.linalg.solve(full, g.ravel()))


def test_pending_scans_drop_late():
    p = Pending()
    p.scan(0.0, 0.1, 1)
    p.scan(1.0, 1.1, 2)
    assert p.pose(1.1) == 2 and p.dropped == 1
    p.scan(2.0, 2.1, 3)
    p.scan(8.0, 8.1, 4)
    assert p.dropped == 2 and p.pose(2.1) == 4


def test_pending_stream(spark, tmp_path):
    rows = [("a", "scan", 0.0, 0.1, 1), ("a", "scan", 0.2, 0.3, 2), ("a", "pose", 0.0, 0.31, 3), ("b", "pose", 0.0, 1.0, 4)]
    schema = "k string, kind string, begin double, end double, id long"
    frame(spark, rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    d = matched(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k")
    q = d.writeStream.format("memory").queryName("pending").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("SELECT * FROM pending").collect()] == [("a", 2, 0.31, 1)]


def test_broadcast_tells_what_was_lost():
    b = Broadcast(3)
    take = b.reader()
    for i in range(5):
        b.emit(i)
    assert take() == ([2, 3, 4], 2) and take() == ([], 0)


def test_ranks_of_wide_rows_have_no_gaps(spark):
    """Small partitions to coalesce, and columns besides the sort keys."""
    from pyspark.sql import functions as F

    n, old = 100_000, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
        d = spark.range(n, numPartitions=9).select(((F.col("id") * 7919) % n).alias("v"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("wide"))
        r = picks.ranked(d, "v")
        assert r.where("rank <> v").count() == 0 and r.count() == n
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_forests_of_any_depth(spark):
    from mapweave.operators import catalog

    chain = [(i + 1, i) for i in range(300)] + [(1000 + i, 5) for i in range(20)] + [(2001, 2000)]
    got = {r["node"]: (r["root"], r["depth"]) for r in catalog.ancestors(frame(spark, chain, "child long, parent long")).collect()}
    want = {i: (0, i) for i in range(301)} | {1000 + i: (0, 6) for i in range(20)} | {2000: (2000, 0), 2001: (2000, 1)}
    assert got == want
    with pytest.raises(ValueError, match="cycle"):
        catalog.ancestors(frame(spark, [(1, 2), (2, 3), (3, 1), (9, 8)], "child long, parent long"))


def test_only_flat_normals_vote_for_wall_directions(spark):
    from mapweave.operators import voxels

    d = frame(spark, [(0.6, 0.0, 0.1), (0.3, 0.3, 0.0), (0.0, 0.9, 0.2), (0.9, 0.0, 0.4)], "nx double, ny double, nz double")
    assert [(r["bin"], r["n"]) for r in voxels.wall_angles(d).collect()] == [(0, 2)]


def test_picks_over_ranges_equal_sorted_lists(spark):
    """Null groups, ties, nulls, a hot group and empty tables; no window of the plan holds a whole group."""
    rows = [(k, None if i % 11 == 0 else (i * 37 % 101) / 4) for k, n in (("a", 900), (None, 7), ("b", 1), ("c", 30)) for i in range(1, n + 1)]
    d = frame(spark, rows, "k string, v double").repartition(5)
    got = {r["k"]: tuple(r)[1:] for r in picks.percentiles(d, ["k"], "v", {"low": 0.02, "mid": 0.5, "top": 1.0}).collect()}
    for k in ("a", None, "b", "c"):
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert got[k] == (len(v), *(v[math.floor((len(v) - 1) * q + 0.5)] for q in (0.02, 0.5, 1.0)))
    assert picks.upper_median(d.limit(0), ["k"], "v").count() == 0
    plan = picks.upper_median(d, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in line or "__c" in line for line in plan.splitlines() if "Window" in line)
