import json
import sqlite3

import numpy as np
import pytest

from mapweave.sources import mcap, recordings
from mapweave.sources import messages as M

HEADER = {"seq": 0, "sec": 5, "nsec": 250_000_000, "frame": "map"}
POSE = {"position": [1.0, 2.0, 3.0], "orientation": [0.0, 0.0, 0.0, 1.0]}


def cloud_message(n=3, big=False):
    a = np.zeros(n, np.dtype([(c, (">" if big else "<") + "f4") for c in ("x", "y", "z", "intensity")]))
    a["x"], a["y"], a["z"], a["intensity"] = np.arange(n), 1, 2, 7
    a["x"][-1] = np.nan
    fields = [{"name": c, "offset": 4 * i, "datatype": 7, "count": 1} for i, c in enumerate(("x", "y", "z", "intensity"))]
    return {"header": HEADER, "height": 1, "width": n, "fields": fields, "is_bigendian": big, "point_step": 16, "row_step": 16 * n, "data": a.tobytes(), "is_dense": False}


MESSAGES = {
    "tf2_msgs.TFMessage": {"edges": [{"header": HEADER, "child": "base", "translation": [1.0, 0.0, 0.5], "rotation": [0.0, 0.0, 0.0, 1.0]}] * 2},
    "sensor_msgs.PointCloud2": cloud_message(),
    "nav_msgs.Odometry": {"header": HEADER, "child": "base", "pose": POSE},
    "geometry_msgs.PoseStamped": {"header": HEADER, "pose": POSE},
    "nav_msgs.Path": {"header": HEADER, "poses": [{"header": HEADER, "pose": POSE}] * 3},
    "nav_msgs.OccupancyGrid": {"header": HEADER, "load_sec": 0, "load_nsec": 0, "resolution": 0.5, "width": 2, "height": 2, "origin": POSE, "data": b"\0\x64\xff\0"},
    "std_msgs.String": {"data": "häuser"},
    "sensor_msgs.Image": {"header": HEADER, "height": 1, "width": 2, "encoding": "rgb8", "is_bigendian": 0, "step": 6, "data": bytes([255, 0, 0, 10, 10, 10])},
    "sensor_msgs.CameraInfo": {"header": HEADER, "height": 4, "width": 6, "distortion_model": "plumb_bob", "d": [0.1] * 5, "k": [1.0] * 9},
    M.IMU: {"header": HEADER, "orientation": [0.0] * 4, "orientation_covariance": [0.0] * 9, "angular_velocity": [1.0, 2.0, 3.0], "angular_covariance": [0.0] * 9, "linear_acceleration": [0.0, 0.0, 9.8]},
}


@pytest.mark.parametrize("kind", MESSAGES)
def test_lcm_round_trip(kind):
    raw = M.encode_lcm(kind, MESSAGES[kind])
    assert M.decode_lcm(raw, kind) == MESSAGES[kind]
    assert kind == M.IMU or M.type_of(raw) == kind
    with pytest.raises(ValueError):
        M.decode_lcm(raw[: len(raw) // 2], kind)


@pytest.mark.parametrize("kind", M.CDR)
def test_cdr_round_trip(kind):
    assert M.decode_cdr(M.encode_cdr(kind, MESSAGES[kind]), kind) == MESSAGES[kind]


def test_cloud_drops_points_that_are_not_finite():
    for big in (False, True):
        p = M.cloud(cloud_message(4, big))
        assert p.tolist() == [[0, 1, 2, 7], [1, 1, 2, 7], [2, 1, 2, 7]]


def test_gray():
    assert M.gray(MESSAGES["sensor_msgs.Image"]).tolist() == [[76, 10]]


def write_mcap(path, n=40, cut=False):
    with open(path, "wb") as f:
        w = mcap.Writer(f)
        a, b = w.channel("/lidar", "cdr", "sensor_msgs/msg/PointCloud2"), w.channel("/note", "lcm", "std_msgs.String", {"generation": "2"})
        for i in range(n):
            w.write(a, i, i * 500_000_000, M.encode_cdr("sensor_msgs.PointCloud2", cloud_message()))
            if i % 4 == 0:
                w.write(b, i, i * 500_000_000 + 1, M.encode_lcm("std_msgs.String", {"data": str(i)}))
        w.close()
    if cut:
        raw = path.read_bytes()
        path.write_bytes(raw[: int(len(raw) * 0.6)])


def test_mcap_reads_by_stream(spark, tmp_path):
    write_mcap(path := tmp_path / "a.mcap")
    d = recordings.messages(spark, str(path))
    assert {(r["stream"], r["count"]) for r in recordings.counted(d).collect()} == {("/lidar", 40), ("/note", 10)}
    assert [r["stream"] for r in d.where("stream = '/note'").collect()] == ["/note"] * 10
    assert d.where("stream = 'absent'").count() == 0
    found = {r["stream"]: r["count"] for r in recordings.streams(spark, str(path)).collect()}
    assert found == {"/lidar": 40, "/note": 10}
    p = recordings.points(d)
    assert p.count() == 80 and p.first()["ts"] == 5.25


def test_mcap_prunes_chunks(tmp_path):
    write_mcap(path := tmp_path / "a.mcap")
    r = recordings.Reader(str(path), None)
    assert len(r.partitions()[0].chunks) > 2
    with open(path, "rb") as f:
        assert mcap.index(f, path.stat().st_size).complete
    r.streams = {"absent"}
    assert not r.partitions()[0].chunks


def test_cut_short_mcap_reads_what_is_whole(spark, tmp_path):
    write_mcap(path := tmp_path / "a.mcap", cut=True)
    with open(path, "rb") as f:
        i = mcap.index(f, path.stat().st_size)
    assert not i.complete and len(i.chunks) >= 1
    assert 0 < recordings.messages(spark, str(path)).count() < 50


def test_db(spark, tmp_path):
    path = tmp_path / "a.db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE _streams (name TEXT, config TEXT)")
    db.execute("INSERT INTO _streams VALUES ('tf', ?), ('empty', ?)", [json.dumps({"payload_module": "robot.msgs.tf2_msgs.TFMessage.TFMessage", "codec_id": "lcm"}), json.dumps({"payload_module": "std_msgs.String"})])
    for s in ("tf", "empty"):
        db.execute(f"CREATE TABLE {s} (id INTEGER PRIMARY KEY, ts REAL, value, pose_x, pose_y, pose_z, pose_qx, pose_qy, pose_qz, pose_qw, tags TEXT)")
    db.execute("CREATE TABLE tf_blob (id INTEGER PRIMARY KEY, data BLOB)")
    for i, ts in ((1, 2.0), (2, 1.0), (3, 3.0)):
        db.execute("INSERT INTO tf (id, ts, pose_x, tags) VALUES (?, ?, 1.0, '{\"k\": 1}')", [i, ts])
        db.execute("INSERT INTO tf_blob VALUES (?, ?)", [i, M.encode_lcm("tf2_msgs.TFMessage", MESSAGES["tf2_msgs.TFMessage"])])
    db.commit()
    db.close()
    d = recordings.messages(spark, str(path))
    rows = d.orderBy("log_time").collect()
    assert [r["seq"] for r in rows] == [2, 1, 3] and rows[0]["pose"] is None and json.loads(rows[0]["tags"]) == {"k": 1}
    assert rows[0]["type_name"] == "tf2_msgs.TFMessage"
    assert {(r["stream"], r["count"]) for r in recordings.streams(spark, str(path)).collect()} == {("tf", None), ("empty", None)}


def test_other_suffixes_are_refused():
    with pytest.raises(ValueError):
        recordings.kind_of("a.bag")


def rewritten(path, change):
    """The file with its records changed: change(op, content) gives the contents to write, one or more of (op, content), before which the old summary is forgotten."""
    import struct

    raw, out, at = path.read_bytes(), bytearray(mcap.MAGIC), 8
    summary = 0
    while at + 9 <= len(raw) - 8:
        op, n = struct.unpack_from("<BQ", raw, at)
        content = raw[at + 9 : at + 9 + n]
        for o, c in change(op, content):
            if op == mcap.DATA_END:
                summary = len(out) + 9 + len(c)
            if o == mcap.FOOTER:
                c = struct.pack("<QQI", summary, 0, 0)
            out += struct.pack("<BQ", o, len(c)) + c
        at += 9 + n
    path.write_bytes(bytes(out) + mcap.MAGIC)


def total(spark, path):
    return {r["stream"]: r["count"] for r in recordings.counted(recordings.messages(spark, str(path))).collect()}


def test_chunks_without_message_index_offsets_are_read(spark, tmp_path):
    import struct

    write_mcap(path := tmp_path / "a.mcap")

    def without(op, c):
        if op == mcap.CHUNK_INDEX:
            (n,) = struct.unpack_from("<I", c, 32)
            c = c[:32] + struct.pack("<I", 0) + c[36 + n :]
        return [(op, c)]

    rewritten(path, without)
    assert total(spark, path) == {"/lidar": 40, "/note": 10}


def test_a_summary_that_lists_some_chunks_only_is_not_believed(spark, tmp_path):
    write_mcap(path := tmp_path / "a.mcap")
    seen = []
    rewritten(path, lambda op, c: [] if op == mcap.CHUNK_INDEX and (seen.append(1) or len(seen) > 1) else [(op, c)])
    assert len(seen) > 2 and total(spark, path) == {"/lidar": 40, "/note": 10}


def test_messages_outside_chunks_are_read(spark, tmp_path):
    write_mcap(path := tmp_path / "a.mcap")
    drop = (mcap.MESSAGE_INDEX, mcap.CHUNK_INDEX, mcap.STATISTICS)
    rewritten(path, lambda op, c: [(o, x) for o, _, x in mcap.records(mcap.unpacked(c))] if op == mcap.CHUNK else [] if op in drop else [(op, c)])
    assert total(spark, path) == {"/lidar": 40, "/note": 10}
    assert recordings.messages(spark, str(path)).where("stream = '/note'").count() == 10


def test_a_damaged_chunk_ends_the_read_there(spark, tmp_path):
    write_mcap(path := tmp_path / "a.mcap")
    seen = []
    rewritten(path, lambda op, c: [(op, c[:60] + b"\xff" * 40 + c[100:])] if op == mcap.CHUNK and (seen.append(1) or len(seen) == 3) else [(op, c)])
    got = total(spark, path)
    assert 0 < sum(got.values()) < 50
