import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.operators import frames, mapping
from mapweave.sources import mcap, recordings
from mapweave.sources import messages as M

I4, S = [0.0, 0.0, 0.0, 1.0], 1_000_000
CLOUD, TF, ODOM = "sensor_msgs.PointCloud2", "tf2_msgs.TFMessage", "nav_msgs.Odometry"


def header(t, frame):
    return {"seq": 0, "sec": int(t // 1), "nsec": round(t % 1 * 1e9), "frame": frame}


def cloud(t, frame, points, extra=()):
    """extra: (name, datatype, values) of more fields."""
    kinds = [(c, "<f4") for c in "xyz"] + [(n, "<" + M.DATATYPES[d]) for n, d, _ in extra]
    a = np.zeros(len(points), np.dtype(kinds))
    for i, c in enumerate("xyz"):
        a[c] = [p[i] for p in points]
    for n, _, v in extra:
        a[n] = v
    names = [*"xyz", *(n for n, _, _ in extra)]
    fields = [{"name": n, "offset": a.dtype.fields[n][1], "datatype": 7 if n in "xyz" else next(d for m, d, _ in extra if m == n), "count": 1} for n in names]
    return {"header": header(t, frame), "height": 1, "width": len(points), "fields": fields, "is_bigendian": False, "point_step": a.itemsize, "row_step": a.nbytes, "data": a.tobytes(), "is_dense": True}


def edge(t, parent, child, x, z=0.0):
    return {"header": header(t, parent), "child": child, "translation": [x, 0.0, z], "rotation": I4}


def recorded(path, rows):
    """rows: (topic, type, log seconds, message)."""
    with open(path, "wb") as f:
        w = mcap.Writer(f)
        ids = {}
        for topic, kind, log, m in rows:
            if topic not in ids:
                ids[topic] = w.channel(topic, "lcm", kind)
            w.write(ids[topic], 0, round(log * 1e9), M.encode_lcm(kind, m))
        w.close()
    return str(path)


def listing(spark, rows):
    return spark.createDataFrame([(r + (None,) * 4)[:4] for r in rows], "stream string, kind string, count long, derived_from string")


def built(spark, path, streams, **options):
    m = recordings.messages(spark, path)
    return mapping.build(listing(spark, streams), recordings.scans(m), recordings.edges(m), recordings.trajectories(m), 0.1, **options)


WALLS = [(i * 0.1 + 0.05, side, k * 0.1 - 0.45) for i in range(-20, 20) for side in (1.45, -1.45) for k in range(5)]


@pytest.fixture(scope="module")
def corridor(tmp_path_factory):
    """A robot that drives 10 cm a scan; its lidar is half a metre over it."""
    rows = []
    for k in range(20):
        t = 100 + k * 0.1
        rows += [("/lidar", CLOUD, t, cloud(t, "lidar", WALLS)), ("/tf", TF, t, {"edges": [edge(t, "odom", "base", k * 0.1), edge(t, "base", "lidar", 0.0, 0.5)]})]
    return recorded(tmp_path_factory.mktemp("map") / "corridor.mcap", rows)


def test_scans_are_placed_by_tf(spark, corridor):
    m = built(spark, corridor, [("/lidar", "cloud", 20)])
    assert (m.stream, m.how.kind, m.how.world, m.how.offset) == ("/lidar", "tf", "odom", 0)
    used = {r.log: r.sensor.t.x for r in m.scans.collect()}
    assert m.scans.where("sensor is null").count() == 0 and m.scans.count() == 20 and max(used.values()) == pytest.approx(1.9)
    got = {(r.kx, r.ky, r.kz): r.n for r in m.voxels.collect()}
    want = {}
    for k in range(20):
        for x, y, z in WALLS:
            cell = tuple(np.floor(np.float32([x + k * 0.1, y, z + 0.5]) / np.float32(0.1) + 1e-4).astype(int).tolist())
            want[cell] = want.get(cell, 0) + 1
    assert set(got) == set(want) and sum(got.values()) == sum(want.values())
    assert {round(r.y, 2) for r in m.voxels.collect()} == {1.45, -1.45}


def test_every_and_range(spark, corridor):
    assert built(spark, corridor, [("/lidar", "cloud", 20)], every=4).scans.count() == 5
    near = built(spark, corridor, [("/lidar", "cloud", 20)], most=1.6).voxels
    assert 0 < near.agg(F.max("x")).first()[0] < 1.9 + 0.8


@pytest.mark.parametrize("tf_on_log", [False, True])
def test_scans_on_another_clock(spark, tmp_path, tf_on_log):
    rows = []
    for k in range(12):
        log = 1000 + k * 0.1
        own = log - 143.3 - 0.02
        rows += [("/scan", CLOUD, log, cloud(own, "lidar", WALLS[:4])), ("/tf", TF, log, {"edges": [edge(log if tf_on_log else own, "odom", "lidar", k * 0.1)]})]
    m = built(spark, recorded(tmp_path / "rig.mcap", rows), [("/scan", "cloud", 12)])
    assert m.scans.where("sensor is not null").count() == 12
    assert bool(m.how.offset) == tf_on_log == any("moved onto" in n for n in m.how.notes)


def test_unstamped_edges_count_at_their_log_time(spark, tmp_path):
    rows = [("/tf", TF, 5.0 + k, {"edges": [edge(0.0, "/odom", "/lidar", float(k))]}) for k in range(3)]
    e = recordings.edges(recordings.messages(spark, recorded(tmp_path / "a.mcap", rows))).orderBy("t").collect()
    assert [(r.parent, r.child, r.t, r.pose.t.x) for r in e] == [("odom", "lidar", (5 + k) * S, float(k)) for k in range(3)]


def test_clouds_in_the_world_are_seen_from_the_odometry(spark, tmp_path):
    pose = lambda x: {"position": [x, 0.0, 0.0], "orientation": I4}
    rows = []
    for k in range(5):
        t = 10 + k
        rows += [("/reg", CLOUD, t, cloud(t, "map", [(float(k), 0.0, 0.0), (40.0, 0.0, 0.0)])), ("/odom", ODOM, t, {"header": header(t, "map"), "child": "base", "pose": pose(float(k))})]
    path = recorded(tmp_path / "w.mcap", rows)
    m = built(spark, path, [("/reg", "cloud", 5)])
    assert m.how.kind == "world" and sorted(r.sensor.t.x for r in m.scans.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert m.voxels.count() == 5  # what is 40 m away is out of range
    with pytest.raises(ValueError, match="no cloud stream"):
        built(spark, path, [("/reg", "cloud", 5)], stream="/other")
    with pytest.raises(ValueError, match="no point clouds"):
        built(spark, path, [("/odom", "odometry", 5)])


def test_a_named_sensor_under_registered_clouds(spark, tmp_path):
    rows = []
    for k in range(4):
        t = 10 + k
        rows += [("/reg", CLOUD, t, cloud(t, "odom", [(k + 1.0, 2.0, 0.0)])), ("/tf", TF, t, {"edges": [edge(t, "odom", "lidar", float(k))]})]
    path = recorded(tmp_path / "m.mcap", rows)
    m = built(spark, path, [("/reg", "cloud", 4)], sensor="lidar", most=2.5)
    assert m.how.kind == "mounted" and sorted(r.sensor.t.x for r in m.scans.collect()) == [0.0, 1.0, 2.0, 3.0] and m.voxels.count() == 4
    with pytest.raises(ValueError, match="does not connect"):
        built(spark, path, [("/reg", "cloud", 4)], sensor="camera")


def test_stored_poses_and_scans_that_cannot_be_placed(spark):
    stored = (("x", 1.0), ("y", 0.0), ("z", 0.0))
    schema = f"stream string, seq long, log long, stamp long, frame string, stored {frames.POSE}, offset long, x float, y float, z float"
    pose = (tuple(v for _, v in stored), (0.0, 0.0, 0.0, 1.0))
    rows = [("/s", 1, 5, 0, "laser", pose, None, 1.0, 0.0, 0.0), ("/s", 2, 6, 0, "laser", None, None, 1.0, 0.0, 0.0)]
    scans = spark.createDataFrame(rows, schema)
    none = f"stream string, seq long, t long, frame string, pose {frames.POSE}"
    no_tf = spark.createDataFrame([], f"parent string, child string, t long, seq long, pose {frames.POSE}")
    m = mapping.build(listing(spark, [("/s", "cloud", 2)]), scans, no_tf, spark.createDataFrame([], none), 0.1)
    assert m.how.kind == "stored" and [(r.seq, r.sensor is None) for r in m.scans.orderBy("seq").collect()] == [(1, False), (2, True)]
    assert [(r.kx, r.n) for r in m.voxels.collect()] == [(20, 1)]
    with pytest.raises(ValueError, match="cannot be placed"):
        mapping.build(listing(spark, [("/s", "cloud", 2)]), scans.where("seq = 2"), no_tf, spark.createDataFrame([], none), 0.1)


def test_which_cloud(spark):
    rows = [("/global_map", "cloud", 900), ("/raw", "cloud", 50), ("/undistorted", "cloud", 20, "/raw"), ("/small", "cloud", 30), ("/imu", "imu", 999)]
    got = mapping.ranked_clouds(listing(spark, rows)).orderBy("rank")
    assert [r.stream for r in got.collect()] == ["/small", "/undistorted", "/raw", "/global_map"]


@pytest.mark.parametrize("rows, want", [
    ([("/a/points", "cloud", 10), ("/b/points", "cloud", 90), ("/a/imu", "imu", 5), ("/c/imu", "imu", 5)], ("/a/points", "/a/imu")),
    ([("/a/points", "cloud", 10), ("/b/points", "cloud", 90), ("/c/imu", "imu", 5)], ("/b/points", "/c/imu")),
    ([("points", "cloud", 10), ("imu", "imu", 5), ("/x/imu", "imu", 5)], ("points", "imu")),
    ([("/b/points", "cloud", 90), ("/c/imu", "imu", 5), ("/d/imu", "imu", 5)], None),
    ([("/a/points", "cloud", 10), ("/a/imu", "imu", 5), ("/odom", "odometry", 3)], None),
    ([("/a/points", "cloud", 10), ("/a/imu", "imu", 5), ("/odom", "odometry", 0)], ("/a/points", "/a/imu")),
    ([("/a/voxels", "cloud", 10), ("/a/copy", "cloud", 10, "/a/points"), ("/a/imu", "imu", 5)], None),
])
def test_lidar_and_imu(spark, rows, want):
    got = mapping.lidar_and_imu(listing(spark, rows)).collect()
    assert [tuple(r) for r in got] == ([want] if want else [])


def test_moved_by_tf_follows_the_parent_with_most_samples(spark):
    g = spark.createDataFrame([("base", "lidar", 5, True), ("odom", "base", 50, False), ("other", "base", 2, True)], "parent string, child string, samples long, fixed boolean")
    assert mapping.moved_by_tf(g, "/lidar") and not mapping.moved_by_tf(g.where("parent <> 'odom'"), "lidar") and not mapping.moved_by_tf(g, "nowhere")
    assert {(r.child, r.parent) for r in mapping.parent_of(g).collect()} == {("lidar", "base"), ("base", "odom")}


@pytest.mark.parametrize("extra, want", [
    ([("offset_time", 6, [0, 1000, 5])], [0, 1000, 5]),
    ([("timestamp", 8, [50.5, 50.500001, 50.4])], [0, 1000, 0]),
    ([("timestamp", 8, [50.5e9, 50.5e9 + 2048, 50.5e9])], [0, 2048, 0]),
    ([("time", 7, [0.0, 0.25, -1.0])], [0, 250_000_000, 0]),
    ([("t", 6, [7, 8, 9])], [7, 8, 9]),
    ([("t", 6, [7, 8, 9]), ("offset_time", 6, [1, 2, 3])], [1, 2, 3]),
    ([("time", 8, [0.1, 10.0, 0.0])], [100_000_000, 0xFFFFFFFF, 0]),
    ([], None),
])
def test_point_times(extra, want):
    got = M.point_times(cloud(50.5, "lidar", [(0.0, 0.0, 0.0)] * 3, extra))
    assert (got is None) == (want is None) and (want is None or np.abs(got.astype(np.int64) - want).max() <= 1000 * (extra[0][0] == "timestamp"))


def test_scans_carry_their_points_times(spark, tmp_path):
    rows = [("/l", CLOUD, 60.0, cloud(50.5, "/lidar", [(0.0, 0.0, 0.0), (float("nan"), 0.0, 0.0), (1.0, 0.0, 0.0)], [("t", 6, [7, 8, 9])]))]
    got = recordings.scans(recordings.messages(spark, recorded(tmp_path / "t.mcap", rows))).orderBy("x").collect()
    assert [(r.stamp, r.log, r.frame, r.offset, r.x, r.stored) for r in got] == [(50_500_000, 60_000_000, "lidar", 7, 0.0, None), (50_500_000, 60_000_000, "lidar", 9, 1.0, None)]


def test_lookups_over_many_ranges_equal_one_window(spark):
    """Samples and probes far apart, so that most ranges need the samples of others."""
    from mapweave.operators import temporal as T

    samples = spark.createDataFrame([(k % 2, t * 1000, float(t), n) for k in range(2) for n, t in enumerate((0, 0, 500, 510, 990))], "k int, t long, v double, seq int")
    probes = spark.range(-5, 1010).selectExpr("cast(id % 3 as int) as k", "id * 1000 as t", "id")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = T.ranged_bracket(probes, samples, ["k"], "t", "v", "seq")
        assert got.count() == 1015
        want = T.bracket(probes, samples, ["k"], "t", "v", "seq")
        key = lambda d: sorted(map(tuple, d.select("id", "t0", "v0", "t1", "v1").collect()), key=repr)
        assert key(got) == key(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_damage_in_one_task_ends_the_read_for_all(spark, tmp_path, monkeypatch):
    import struct

    with open(tmp_path / "d.mcap", "wb") as f:
        w = mcap.Writer(f)
        c = w.channel("/a", "lcm", "std_msgs.String")
        for k in range(60):
            w.write(c, k, k * 10**9, M.encode_lcm("std_msgs.String", {"data": "x" * 50}))
            w.flush()
        w.close()
    path = str(tmp_path / "d.mcap")
    f, size = recordings.opened(path)
    chunks = sorted(mcap.index(f, size).chunks)
    f.close()
    assert len(chunks) == 60 and recordings.first_unreadable(spark, path) is None
    monkeypatch.setattr(recordings, "TASK_BYTES", sum(c[1] for c in chunks) // 5)
    assert sorted(r.seq for r in recordings.messages(spark, path).collect()) == list(range(60))
    raw = bytearray((tmp_path / "d.mcap").read_bytes())
    for k in (45, 10):
        at, n = chunks[k][0], chunks[k][1]
        raw[at + n - 30 : at + n - 10] = b"\xff" * 20
    (tmp_path / "d.mcap").write_bytes(bytes(raw))
    assert struct.unpack_from("<B", raw, chunks[10][0]) == (mcap.CHUNK,)
    assert recordings.first_unreadable(spark, path) == chunks[10][0]
    assert sorted(r.seq for r in recordings.messages(spark, path).collect()) == list(range(10))


def test_timed_points_are_moved_to_the_end_of_their_scan(spark):
    schema = f"stream string, seq long, log long, stamp long, frame string, stored {frames.POSE}, offset long, x float, y float, z float"
    rows = [("/l", 1, 9, 10 * S, "lidar", None, o * 100_000_000, 5.0, float(o), 0.0) for o in (0, 5, 10)] + [("/l", 2, 9, 11 * S, "lidar", None, None, 7.0, 0.0, 0.0)]
    motion = spark.createDataFrame([(k * S, 0, ((float(k), 0.0, 0.0), (0.0, 0.0, 0.0, 1.0))) for k in range(9, 13)], f"t long, seq long, pose {frames.POSE}")
    got = sorted((r.seq, r.y, round(r.x, 4)) for r in mapping.deskewed_scans(spark.createDataFrame(rows, schema), motion, 0).collect())
    assert got == [(1, 0.0, 4.0), (1, 5.0, 4.5), (1, 10.0, 5.0), (2, 0.0, 7.0)]
