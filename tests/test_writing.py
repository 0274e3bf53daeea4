import pytest

from mapweave.sources import mcap, recordings, writing
from mapweave.sources import messages as M


def note(t):
    return M.encode_lcm("std_msgs.String", {"data": t})


def test_db_streams(spark, tmp_path):
    path = str(tmp_path / "a.db")
    module = "robot.msgs.std_msgs.String.String"
    assert writing.append_rows(path, "note", [(2.0, note("b"), None, None), (1.0, note("a"), [0.0] * 7, '{"k": 1}')], module) == 2
    d = recordings.messages(spark, path)
    assert [M.decode_lcm(bytes(r["payload"]))["data"] for r in d.orderBy("log_time").collect()] == ["a", "b"]
    assert writing.write_stream(path, "copy", writing.messages_of(d), module) == 2
    with pytest.raises(ValueError):
        writing.write_stream(path, "copy", [(1.0, None)], module)
    assert writing.write_stream(path, "note", [(5.0, note("c"), None, None)], module) == 1
    assert {(r["stream"], r["count"]) for r in recordings.counted(recordings.messages(spark, path, ["note", "copy"])).collect()} == {("note", 1), ("copy", 2)}
    writing.delete_stream(path, "copy")
    assert [r["stream"] for r in recordings.messages(spark, path).where("stream = 'copy'").collect()] == []


def test_generations(tmp_path):
    path = str(tmp_path / "a.mcap")
    with open(path, "wb") as f:
        w = mcap.Writer(f)
        w.write(w.channel("/raw", "lcm", "std_msgs.String"), 0, 5, note("r"))
        w.close()
    for g in (1, 2):
        assert writing.append_generation(path, "/made", "lcm", "std_msgs.String", [(1.0, note(f"g{g}")), (2.0, note("x"))]) == 2
    with pytest.raises(ValueError, match="recorded"):
        writing.append_generation(path, "/raw", "lcm", "std_msgs.String", [])
    with open(path, "rb") as f:
        import os

        i = mcap.index(f, os.path.getsize(path))
    assert sorted((c.topic, c.metadata.get("generation"), i.counts[c.id]) for c in i.channels.values()) == [("/made", "1", 2), ("/made", "2", 2), ("/raw", None, 1)] or i.counts


def test_maps(spark, tmp_path):
    m = writing.Maps(spark, f"file://{tmp_path}/maps")
    assert m.names() == [] and m.newest() is None
    assert m.save("v1", {"voxels": spark.range(3), "path": spark.range(1)}) == 1
    assert m.save("v1", {"voxels": spark.range(5)}) == 2
    assert m.load("v1")["voxels"].count() == 5 and m.load("v1", 1)["voxels"].count() == 3
    (tmp_path / "maps" / "v1" / "3").mkdir()  # a save that died
    assert m.versions("v1") == [1, 2] and m.save("v1", {"voxels": spark.range(7)}) == 4
    m.save("other", {"voxels": spark.range(1)})
    assert m.names() == ["other", "v1"] and m.newest() == "other"
    with pytest.raises(KeyError):
        m.load("absent")


def test_superseded_generations_are_left_out(spark):
    g = spark.createDataFrame([("a", None, 1), ("b", 1, 2), ("b", 2, 3)], "stream string, generation int, channel int")
    d = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "stream string, channel int")
    assert sorted(map(tuple, writing.current(d, g).collect())) == [("a", 1), ("b", 3)]
