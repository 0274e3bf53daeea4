import math

import pytest
from pyspark.sql import functions as F

from mapweave.operators import frames, session

POSE = "struct<t: struct<x: double, y: double, z: double>, q: struct<x: double, y: double, z: double, w: double>>"
I4 = (0.0, 0.0, 0.0, 1.0)


@pytest.fixture(scope="module")
def tf(spark):
    s = 1_000_000
    rows = [("world", "odom", 0, 1, ((1.0, 0.0, 0.0), I4)), ("base_link", "lidar", 0, 1, ((0.0, 0.0, 0.5), I4))]
    rows += [("odom", "base_link", i * s, i, ((float(i), 0.0, 0.0), I4)) for i in range(11)]
    return spark.createDataFrame(rows, f"parent string, child string, t long, seq long, pose {POSE}")


def test_chained_lookup(spark, tf):
    s = 1_000_000
    p = spark.createDataFrame([(5 * s,), (5 * s + s // 2,), (20 * s,)], "t long")
    got = {r["t"]: r["pose"] for r in frames.lookup(p, tf, "world", "lidar", s // 10).collect()}
    assert tuple(got[5 * s]["t"]) == (6.0, 0.0, 0.5) and got[5 * s + s // 2]["t"]["x"] == 6.5 and got[20 * s] is None
    assert frames.lookup(p, tf, "world", "nowhere", s).where("pose is not null").count() == 0
    back = {r["t"]: r["pose"]["t"] for r in frames.lookup(p.where(f"t = {5 * s}"), tf, "lidar", "world", s).collect()}
    assert tuple(back[5 * s]) == (-6.0, 0.0, -0.5)


def test_constant_edge_on_another_clock(spark):
    rows = [("odom", "base", (i - 143) * 1_000_000, i, ((5.0, 0.0, 0.0), I4)) for i in range(50)]
    d = spark.createDataFrame(rows, f"parent string, child string, t long, seq long, pose {POSE}")
    p = spark.createDataFrame([(862_000_000,)], "t long")
    assert frames.lookup(p, d, "odom", "base", 1000).first()["pose"]["t"]["x"] == 5.0


def test_edge_statistics_and_roots(tf):
    e = {(r["parent"], r["child"]): r for r in frames.edges(tf).collect()}
    assert e["odom", "base_link"]["samples"] == 11 and not e["odom", "base_link"]["fixed"] and e["world", "odom"]["fixed"]
    assert frames.root_of([*e], "lidar") == ("world", 3)
    assert frames.path([*e], "lidar", "odom") == [("base_link", "lidar", True), ("odom", "base_link", True)]


def test_placed_and_deskewed(spark, tf):
    s = 1_000_000
    d = spark.createDataFrame([(2 * s, 3 * s, 1.0, 0.0, 0.0)], "t long, end long, x double, y double, z double")
    motion = tf.where("child = 'base_link'").select("t", "seq", "pose")
    r = frames.deskewed(d, motion, s).first()
    assert (r["x"], r["y"], r["z"]) == (0.0, 0.0, 0.0) and r["t"] == 2 * s
    assert frames.placed(frames.lookup(d, tf, "world", "base_link", s)).first()["x"] == 4.0


@pytest.fixture(scope="module")
def room(spark):
    floor = [(i * 0.05 + 0.02, j * 0.05 + 0.02, 0.02, 0.0, 0.0, 1.0) for i in range(60) for j in range(40)]
    table = [(1.0 + i * 0.05, 1.0 + j * 0.05, 0.75, 0.0, 0.0, 1.0) for i in range(10) for j in range(6)]
    legs = [(1.0, 1.0, 0.1 + 0.05 * k, 1.0, 0.0, 0.0) for k in range(13)]
    rows = [(i, *p) for i, p in enumerate(floor + table + legs)]
    return spark.createDataFrame(rows, "idx long, x double, y double, z double, nx double, ny double, nz double").cache()


def test_cleanup_and_undo(spark, room):
    box = {"center": [1.2, 1.1, 0.75], "size": [0.6, 0.4, 0.2]}
    gone = session.select(room, "deleteInside", box)
    assert gone.count() == 62  # the table and the tips of its legs
    with pytest.raises(ValueError):
        session.select(room, "cropOutside")
    h = session.History()
    log = gone.select(F.lit(h.record()).alias("edit"), "idx", F.lit("remove").alias("action"))
    assert session.visible(room, log, h.cursor).count() == room.count() - 62
    h.undo()
    assert session.visible(room, log, h.cursor).count() == room.count()
    assert h.redo() == 1 and h.redo() is None
    assert session.select(room, "floor", levels=[0.02]).count() == 2400
    assert session.select(room, "cropHeight", low=-1, high=0.5).count() == 60 + 4


def test_added_voxels_go_with_their_edit(spark, room):
    log = spark.createDataFrame([(1, 0, "remove"), (2, 1, "add"), (3, 1, "remove")], "edit int, idx long, action string")
    n = room.count()
    assert [session.visible(room, log, c).count() for c in range(4)] == [n - 1, n - 2, n - 1, n - 2]


def test_box_around_a_table(room):
    near = room.where(session.region({"center": [1.2, 1.1, 0.5], "size": [1.0, 1.0, 1.2]}))
    box = session.box_of(near, [0.02])
    assert abs(box["center"][0] - 1.225) < 0.05 and abs(box["center"][1] - 1.125) < 0.05 and box["yaw"] == 0.0


def test_objects(room):
    got = session.objects(room, 0.02, 3.0).collect()
    assert len(got) == 1 and got[0]["voxels"] == 73


def test_leveling_and_resting(room):
    t = session.leveling(room, 0.02)
    assert math.isclose(t["q"][3], 1.0) and math.isclose(t["lift"], -0.02)
    assert math.isclose(session.resting_z(room, 1.2, 1.1, 0.05), 0.75) and math.isclose(session.resting_z(room, 1.2, 1.1, 0.05, under=0.5), 0.02)


def test_annotations_and_names():
    a = session.Annotations()
    one, two = a.add("place", name="dock"), a.add("place", name="dock", pose={"x": 1, "y": 2})
    assert a.items[two]["name"] == "dock 2"
    assert a.update(two, {"pose": {"y": 3}, "id": "no"})["pose"] == {"x": 1, "y": 3} and a.items[two]["id"] == two
    a.remove(one)
    assert a.update(two, {"name": "dock"})["name"] == "dock"
    assert session.merged({"a": 1, "b": {"c": 1}}, {"a": None, "b": {"d": 2}}) == {"b": {"c": 1, "d": 2}}
    with pytest.raises(ValueError):
        session.checked_name("No")


def test_an_undone_edit_stays_undone_after_another(spark, room):
    h, log = session.History(), []
    for idx in (0, 1):
        log.append((h.record(), idx, "remove"))
    h.undo()
    log.append((h.record(), 2, "remove"))
    d = spark.createDataFrame(log, "edit int, idx long, action string")
    gone = {0, 1, 2, 3} - {r["idx"] for r in session.visible(room, d, h.cursor).collect()}
    assert gone == {0, 2} and h.redo() is None
    h.undo()
    h.undo()
    assert session.visible(room, d, h.cursor).count() == room.count()
