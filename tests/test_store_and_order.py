import itertools
import math

import pytest
from pyspark.sql import functions as F

from mapweave.operators import slices, store
from mapweave.streaming import live


@pytest.fixture
def points(spark):
    return spark.range(10).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))


def test_snapshots_masks_and_undo(spark, tmp_path, points):
    s = store.Sessions(spark, f"file://{tmp_path}/s")
    with pytest.raises(KeyError):
        s.state("a")
    assert s.save("a", points) == 1
    s.remove("a", points.where("idx < 3"))
    s.remove("a", points.selectExpr("idx + 2 as idx").where("idx < 5 or idx > 10"))
    assert sorted(r.idx for r in s.points("a").collect()) == [5, 6, 7, 8, 9]
    s.undo("a")
    assert s.points("a").count() == 7
    s.undo("a")
    with pytest.raises(ValueError, match="nothing"):
        s.undo("a")
    s.remove("a", points.limit(0))
    assert s.points("a").count() == 10 and s.points("a").columns == points.columns


def test_a_new_snapshot_leaves_old_masks_behind(spark, tmp_path, points):
    s = store.Sessions(spark, f"file://{tmp_path}/s")
    s.save("a", points)
    s.remove("a", points.where("idx < 3"))
    s.save("a", points.where("idx >= 3"))
    assert s.state("a")["masks"] == [] and s.points("a").count() == 7


def test_a_mask_of_another_map_is_ignored(spark, tmp_path, points):
    s = store.Sessions(spark, f"file://{tmp_path}/s")
    s.save("a", points)
    s.remove("a", points.where("idx < 3"))
    old = s.state("a")
    for wrong in ({"count": 11}, {"map": "map-other"}):
        s._put("a", {**old, "masks": [{**old["masks"][0], **wrong}]}, s.state("a")["number"])
        assert s.points("a").count() == 10


def test_a_crash_between_files_leaves_the_state_before(spark, tmp_path, points, monkeypatch):
    s = store.Sessions(spark, f"file://{tmp_path}/s")
    s.save("a", points)
    monkeypatch.setattr(store, "put_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    for change in (lambda: s.save("a", points.where("idx > 5")), lambda: s.remove("a", points)):
        with pytest.raises(OSError, match="lost"):
            change()
    monkeypatch.undo()
    assert s.states("a") == [1] and s.points("a").count() == 10


def test_of_two_writers_one_is_told(spark, tmp_path, points):
    s = store.Sessions(spark, f"file://{tmp_path}/s")
    s.save("a", points)
    seen = s.state("a")
    s.move("a", None)
    with pytest.raises(RuntimeError, match="another writer"):
        s._put("a", {**seen, "transform": [0.0] * 7}, seen["number"])
    assert s.state("a")["transform"] is None


def test_a_move_drops_plans(spark, tmp_path, points):
    s = store.Sessions(spark, f"file://{tmp_path}/s")
    s.save("a", points)
    s.keep_plan("a", "0", {"walls": 3})
    assert s.state("a")["plans"] == {"0": {"walls": 3}}
    s.move("a", [1.0, 2.0, 0.0, 0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4)])
    assert s.state("a")["plans"] == {}
    r = s.points("a", moved=True).where("idx = 3").first()
    assert (r.x, r.y, r.z) == pytest.approx((1.0, 5.0, 1.0)) and s.points("a").where("idx = 3").first().x == 3.0
    with pytest.raises(ValueError, match="transform"):
        s.move("a", [1.0])


def test_what_a_slice_shows():
    assert slices.heights(None, None) == (-math.inf, math.inf)
    assert slices.heights(1.0, 5.0, (2.0, 9.0)) == (2.0, 5.0) and slices.heights(None, 5.0, (2.0, 4.0)) == (2.0, 4.0)


def test_a_ray_that_meets_nothing(spark, points):
    d = points.withColumnRenamed("idx", "id")
    assert slices.picked(d, (0.5, 0.0, 1.0), (1.0, 0.0, 0.0), 0.1).first().id == 1
    assert slices.picked(d, (20.0, 0.0, 1.0), (1.0, 0.0, 0.0), 0.1).count() == 0


#: (seconds, source, id, value); the clock of the last rows moves the watermark past all others.
ROWS = [(0, "imu", 1, 1.0), (2, "scan", 2, 0.0), (3, "imu", 3, 2.0), (3, "scan", 4, 0.0), (4, "scan", 5, 0.0), (6, "imu", 6, 0.0), (7, "scan", 7, 0.0)]
WANT = [(2, 2.0), (4, 3.0), (5, 5.0), (7, 9.0)]


@pytest.mark.parametrize("order", [*itertools.islice(itertools.permutations(range(7)), 0, 5040, 1700), (6, 5, 4, 3, 2, 1, 0)])
def test_two_streams_in_order_whatever_the_arrival(spark, tmp_path, order):
    def position(state, source, t, value):
        """Speeds are integrated; a scan asks where we are."""
        x, v, last = state
        x += v * (t - last) if last >= 0 else 0.0
        return ((x, value, t), None) if source == "imu" else ((x, v, t), round(x, 6))

    late = [(100, "clock", 90, 0.0), (200, "clock", 91, 0.0), (1, "scan", 99, 0.0)]  # the last is too late
    batches = [[ROWS[i] for i in order[:3]], [ROWS[i] for i in order[3:5]], [ROWS[i] for i in order[5:]], late[:1], late[1:]]
    schema = "k string, ts timestamp, source string, id long, value double"
    for n, b in enumerate(batches):
        d = spark.createDataFrame([("a", 1000 + int(t), s, i, v) for t, s, i, v in b], "k string, t long, source string, id long, value double")
        d.select("k", F.timestamp_seconds("t").alias("ts"), "source", "id", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/batch={n}")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/batch=*")
    got = live.in_order(rows, "k", "20 seconds", (0.0, 0.0, -1.0), position)
    out = live.drained(got, "append").where("source = 'scan'").orderBy("ts", "id").collect()
    assert [(r.id, r.out) for r in out] == WANT
