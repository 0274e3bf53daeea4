import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.operators import correction as C
from mapweave.operators.frames import POSE

S = 1_000_000
I4 = (0.0, 0.0, 0.0, 1.0)


def z(angle):
    return (0.0, 0.0, math.sin(angle / 2), math.cos(angle / 2))


def pose(x, y=0.0, angle=0.0):
    return ((float(x), float(y), 0.0), z(angle))


GRAPH = [("odom", "base", 100, False), ("base", "lidar", 1, True), ("base", "camera", 1, True)]


def test_plan_follows_what_moves():
    p = C.plan(GRAPH, "/lidar")
    assert (p.sensor, p.parent, p.child, p.above, p.replaces) == ("lidar", "odom", "base", "world", False)
    p = C.plan([*GRAPH, ("map", "odom", 7, False)], "lidar")
    assert (p.parent, p.above, p.replaces) == ("odom", "map", True)
    p = C.plan(GRAPH, "odom", "lidar")
    assert p.sensor == "lidar" and "moved back" in p.notes[0]
    assert C.plan([*GRAPH, ("other", "base", 3, True)], "lidar").parent == "odom"
    for graph, args, what in ((GRAPH, ("nowhere",), "not in"), (GRAPH, ("odom",), "root"), (GRAPH, ("odom", "x"), "not under"), (GRAPH[1:], ("lidar",), "nothing moves"), (GRAPH, ("lidar", "", "camera"), "already")):
        with pytest.raises(ValueError, match=what):
            C.plan(graph, *args)


def test_information_is_the_inverse_of_the_stated_covariance():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    for far, px, scale in ((0.4, 1.0, 1.0), (0.1, 0.1, 0.25), (0.8, 2.0, 16.0)):
        cov = np.zeros((6, 6))
        cov[:3, :3], cov[3:, 3:] = q @ np.diag([0.04, 0.04, 0.0025]) @ q.T * scale, q @ np.diag([0.0025, 0.0025, 0.25]) @ q.T * scale
        assert np.allclose(C.information(q, far, px), np.linalg.inv(cov))


def test_scale_expression(spark):
    d = spark.createDataFrame([(0.4, 1.0), (0.1, 0.1), (0.8, 2.0)], "d double, p double")
    assert [round(r[0], 9) for r in d.select(C.variance_scale(F.col("d"), F.col("p"))).collect()] == [1.0, 0.25, 16.0]


def test_trajectory_is_not_read_across_gaps(spark):
    way = spark.createDataFrame([("r", t * S, 0, pose(t)) for t in (0, 1, 2, 9, 10)], f"recording string, t long, seq int, pose {POSE}")
    probes = spark.createDataFrame([("r", int(t * S)) for t in (-0.1, -0.3, 0.5, 1.0, 5.0, 9.25, 10.1, 10.3)], "recording string, t long")
    got = {r.t / S: None if r.raw is None else round(r.raw.t.x, 6) for r in C.pose_at(probes, way, ["recording"]).collect()}
    assert got == {-0.1: 0.0, -0.3: None, 0.5: 0.5, 1.0: 1.0, 5.0: None, 9.25: 9.25, 10.1: 10.0, 10.3: None}


def test_sightings_use_the_mount_at_the_time_else_at_any(spark):
    tf = spark.createDataFrame([("base", "camera", 100 * S, 0, pose(1)), ("base", "camera", 101 * S, 1, pose(2)), ("base", "lidar", 0, 0, pose(0.5))], f"parent string, child string, t long, seq long, pose {POSE}")
    way = spark.createDataFrame([(t * S, 0, pose(t)) for t in range(98, 112)], f"t long, seq int, pose {POSE}")
    seen = spark.createDataFrame([(7, 100 * S + S // 2, pose(3)), (7, 110 * S, pose(3)), (7, 200 * S, pose(3))], f"marker int, t long, pose {POSE}")
    got = {r.t // S: r for r in C.sightings(seen, tf, way, "lidar", "camera").collect()}
    assert got[100].sensor_tag.t.x == pytest.approx(1.5 + 3 - 0.5) and got[100].raw.t.x == pytest.approx(100.5)
    assert got[110].sensor_tag.t.x == pytest.approx(2 + 3 - 0.5) and got[200].raw is None
    nowhere = C.sightings(seen, tf, way, "lidar", "other")
    assert nowhere.where("sensor_tag is null").count() == 3


def test_spread_of_visits(spark):
    rows = [("r", 1, t * S, x, 0.0, 0.0) for t, x in ((0, 0.0), (10, 2.0), (40, 3.0), (45, 5.0))] + [("r", 2, 0, 9.0, 0.0, 0.0), ("r", 2, 5 * S, 1.0, 0.0, 0.0)]
    got = C.tag_spread(spark.createDataFrame(rows, "recording string, marker int, t long, x double, y double, z double"), ["recording"]).collect()
    assert [(r.markers, r.spread) for r in got] == [(1, pytest.approx(1.5))]  # visits at 1 and 4; the other has one visit


@pytest.fixture(scope="module")
def drifting(spark):
    """Around a square and past the start again; odometry turns a little too far at each step. A tag by the start is seen on both visits."""
    true, raw, p, r = [], [], (np.eye(3), np.zeros(3)), (np.eye(3), np.zeros(3))
    turn = lambda a: np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1.0]])
    for k in range(45):
        true.append(p)
        raw.append(r)
        a = math.pi / 2 if k % 10 == 9 else 0.0
        p = C._after(p, (turn(a), np.array([1.0, 0, 0])))
        r = C._after(r, (turn(a + 0.01), np.array([1.0, 0, 0])))
    row = lambda m: (tuple(map(float, m[1])), z(math.atan2(m[0][1, 0], m[0][0, 0])))
    tag = (np.eye(3), np.array([2.0, 1.0, 0]))
    keys = spark.createDataFrame([("r", k * S, row(m)) for k, m in enumerate(raw)], f"recording string, t long, pose {POSE}")
    see = [(k, C._between(true[k], tag)) for k in (0, 1, 2, 40, 41, 42)]
    seen = spark.createDataFrame([("r", k * S, 5, row(m), row(raw[k]), 1.0, 1.0) for k, m in see], f"recording string, t long, marker int, sensor_tag {POSE}, raw {POSE}, distance double, pixels double")
    return keys, seen, true, row


def test_a_tag_seen_twice_pulls_the_path_together(spark, drifting):
    keys, seen, true, _ = drifting
    none = spark.createDataFrame([], f"recording string, t long, to long, pose {POSE}")
    solved = C.solve(keys, none, seen).cache()
    off = {r.t // S: (math.dist(tuple(r.pose.t)[:2], true[r.t // S][1][:2]), math.dist(tuple(r.corrected.t)[:2], true[r.t // S][1][:2])) for r in solved.collect()}
    assert len(off) == 45 and off[42][1] < off[42][0] / 3 and off[0][1] < 1e-9
    rep = C.report(solved, seen).first()
    assert rep.keyframes == 45 and rep.markers == 1 and rep.spread_corrected < rep.spread_raw / 3 and rep.max_shift > 0.5


def test_loops_close_the_path(spark, drifting):
    keys, seen, true, row = drifting
    loops = spark.createDataFrame([("r", k * S, (k - 40) * S, row(C._between(true[k], true[k - 40]))) for k in (40, 42, 44)] + [("r", 1, 2, row(true[0]))], f"recording string, t long, to long, pose {POSE}")
    solved = C.solve(keys, loops, seen.limit(0))
    r = solved.where(F.col("t") == 42 * S).first()
    assert math.dist(tuple(r.corrected.t)[:2], true[42][1][:2]) < math.dist(tuple(r.pose.t)[:2], true[42][1][:2]) / 3
    assert C.solve(keys.limit(0), loops, seen).count() == 0
    alone = C.solve(keys.where("t = 0"), loops.limit(0), seen.limit(0)).first()
    assert alone.corrected.t.x == alone.pose.t.x == 0.0


def test_edge_samples(spark):
    way = spark.createDataFrame([("r", t, 0, pose(x)) for t, x in ((2 * S, 1.0), (3 * S + 5, 3.0), (20 * S, 9.0))], f"recording string, t long, seq int, pose {POSE}")
    spans = spark.createDataFrame([("r", S, 4 * S + 7), ("empty", 5, 1)], "recording string, start long, end long")
    got = C.edge_samples(spans, way, 1.0).orderBy("t").collect()
    assert [r.t for r in got] == [S, 2 * S, 3 * S, 3 * S + 5, 4 * S, 4 * S + 7]
    assert [round(r.pose.t.x, 4) for r in got] == [1.0, 1.0, 3.0, 3.0, 3.3529, 3.3529]


def test_keyframes(spark):
    poses = spark.createDataFrame([("r", k, 0, pose(k * 0.1)) for k in range(31)] + [("r", 100 + k, 0, pose(3.0, 0.0, k * 0.1)) for k in range(11)], f"recording string, t long, seq int, pose {POSE}")
    got = sorted(r.t for r in C.keyframes_of(poses, "recording", 0.995, 0.495).collect())
    assert got == [0, 10, 20, 30, 105, 110]
