import os
import struct

import pytest

from mapweave.sources import appending, mcap, recordings, writing

S = 1_000_000_000
ROWS = "topic string, seq long, log long, published long, payload binary"


def recorded(path, n=30, every=10):
    """Two topics in chunks of ten messages; /raw has schema data that nobody here understands."""
    with open(path, "wb") as f:
        w = mcap.Writer(f)
        a, b = w.channel("/raw", "cdr", "kind/Raw", {"k": "v"}), w.channel("/other", "cdr", "kind/Other")
        for k in range(n):
            w.write(a if k % 3 else b, k, k * S // 10, b"payload %d" % k)
            if k % every == every - 1:
                w.flush()
        w.close()
    return str(path)


def rows(spark, topic, n, start=0, step=S, size=8):
    return spark.createDataFrame([(topic, k, start + k * step, start + k * step + 5, bytes([k % 256]) * size) for k in range(n)], ROWS)


def read(path):
    """topic -> messages (seq, log, published, data), in order of time, by the index; and by walking all records."""
    out = []
    for walk in (False, True):
        with open(path, "rb") as f:
            size = os.path.getsize(path)
            found = mcap.index(f, size)
            if walk:
                raw, at, found.chunks = f.seek(0) or f.read(), 8, []
                while at + 9 <= size:
                    op, n = struct.unpack_from("<BQ", raw, at)
                    if op == mcap.CHUNK:
                        found.chunks.append((at, 9 + n, None))
                    if op == mcap.DATA_END:
                        break
                    at += 9 + n
            got = {}
            for start, length, _ in found.chunks:
                for channel, seq, log, published, data in mcap.messages(f, start, length, None):
                    got.setdefault(found.channels[channel].topic if channel in found.channels else channel, []).append((seq, log, published, data))
            out.append({k: sorted(v, key=lambda m: (m[1], m[0])) for k, v in got.items()})
    assert out[0] == out[1]
    return out[0]


def spec(topic, generation=None, **kw):
    return appending.Spec(topic, "lcm", "kind/Made", metadata={} if generation is None else {"generation": str(generation)}, **kw)


def test_append_adds_and_keeps_all(spark, tmp_path):
    path = recorded(tmp_path / "a.mcap")
    before, old = read(path), (tmp_path / "a.mcap").read_bytes()
    assert appending.append(spark, path, rows(spark, "/new", 12), [spec("/new")]) == 12
    got = read(path)
    assert {k: got[k] for k in before} == before and [m[0] for m in got["/new"]] == list(range(12)) and got["/new"][3] == (3, 3 * S, 3 * S + 5, b"\3" * 8)
    new = (tmp_path / "a.mcap").read_bytes()
    changed = [i for i, (x, y) in enumerate(zip(old, new, strict=False)) if x != y]
    assert changed and len(changed) <= 9 and max(changed) - min(changed) < 9  # one header over the old summary
    with open(path, "rb") as f:
        i = mcap.index(f, len(new))
    assert i.complete and {c.topic: i.counts[k] for k, c in i.channels.items()} == {"/raw": 20, "/other": 10, "/new": 12}
    assert next(c for c in i.channels.values() if c.topic == "/raw").metadata == {"k": "v"}
    d = recordings.messages(spark, path)
    assert {(r["stream"], r["count"]) for r in recordings.counted(d).collect()} == {("/raw", 20), ("/other", 10), ("/new", 12)}


def test_an_append_goes_on_with_a_channel_that_says_the_same(spark, tmp_path):
    path = recorded(tmp_path / "a.mcap")
    for k in range(3):
        assert appending.append(spark, path, rows(spark, "/new", 2, k * 100 * S), [spec("/new")]) == 2
    with open(path, "rb") as f:
        i = mcap.index(f, os.path.getsize(path))
    assert [i.counts[k] for k, c in i.channels.items() if c.topic == "/new"] == [6] and len(read(path)["/new"]) == 6
    assert appending.append(spark, path, rows(spark, "/new", 0), []) == 0 and len(read(path)["/new"]) == 6


def test_chunks_are_cut_by_time_and_size_and_merged_by_time(spark, tmp_path, monkeypatch):
    path = recorded(tmp_path / "a.mcap")
    both = rows(spark, "/slow", 20, 0, 2 * S).unionByName(rows(spark, "/fast", 40, 0, S)).repartition(5)
    appending.append(spark, path, both, [spec("/slow"), spec("/fast")])
    with open(path, "rb") as f:
        i = mcap.index(f, os.path.getsize(path))
        spans = []
        for start, length, inside in i.chunks[3:]:
            times = [m[2] for m in mcap.messages(f, start, length, None)]
            assert times == sorted(times) and times[-1] - times[0] <= mcap.CHUNK_SPAN
            spans.append((times[0], times[-1], len(inside)))
    assert any(n == 2 for _, _, n in spans) and all(a[1] <= b[0] for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))
    monkeypatch.setattr(mcap, "CHUNK_BYTES", 1000)
    appending.append(spark, path, rows(spark, "/big", 30, 0, 1, size=400), [spec("/big")])
    with open(path, "rb") as f:
        i = mcap.index(f, os.path.getsize(path))
        big = next(k for k, c in i.channels.items() if c.topic == "/big")
        sizes = [len([*mcap.messages(f, s, n, None)]) for s, n, inside in i.chunks if big in inside]
    assert sum(sizes) == 30 and max(sizes) == 2


def test_a_generated_topic_is_replaced_and_a_recorded_one_is_not(spark, tmp_path):
    path = recorded(tmp_path / "a.mcap")
    before = read(path)
    with pytest.raises(ValueError, match="was recorded"):
        appending.append(spark, path, rows(spark, "/raw", 3), [spec("/raw", 1)], replace=True)
    with pytest.raises(ValueError, match="has a generation"):
        appending.append(spark, path, rows(spark, "/made", 3), [spec("/made")], replace=True)
    assert read(path) == before
    for g, n in ((1.0, 40), (2.0, 5)):
        assert appending.append(spark, path, rows(spark, "/made", n), [spec("/made", g)], replace=True) == n
        got = read(path)
        assert len(got["/made"]) == n and {k: got[k] for k in before} == before
        with open(path, "rb") as f:
            i = mcap.index(f, os.path.getsize(path))
        assert [(c.metadata["generation"], i.counts[k]) for k, c in i.channels.items() if c.topic == "/made"] == [(str(g), n)]


def test_others_in_a_chunk_that_goes_are_carried_over(spark, tmp_path):
    path = recorded(tmp_path / "a.mcap")
    both = rows(spark, "/made", 6).unionByName(rows(spark, "/kept", 6))
    appending.append(spark, path, both, [spec("/made", 1), spec("/kept", 1)])
    kept = read(path)["/kept"]
    assert appending.append(spark, path, rows(spark, "/made", 2), [spec("/made", 2)], replace=True) == 2 + 6
    got = read(path)
    assert got["/kept"] == kept and len(got["/made"]) == 2
    with open(path, "rb") as f:
        i = mcap.index(f, os.path.getsize(path))
    assert sum(i.counts.values()) == sum(map(len, got.values())) == 38


def test_what_fails_leaves_the_recording_as_it_was(spark, tmp_path, monkeypatch):
    path = recorded(tmp_path / "a.mcap")
    old = (tmp_path / "a.mcap").read_bytes()
    with pytest.raises(Exception, match="no channel for /stranger"):
        appending.append(spark, path, rows(spark, "/stranger", 3), [spec("/new")])
    assert (tmp_path / "a.mcap").read_bytes() == old
    real = mcap.messages
    monkeypatch.setattr(mcap, "messages", lambda *a: list(real(*a))[1:])
    with pytest.raises(ValueError, match="read back"):
        appending.append(spark, path, rows(spark, "/new", 3), [spec("/new")])
    monkeypatch.undo()
    assert (tmp_path / "a.mcap").read_bytes() == old
    # a writer that dies before the footer: the old end is still there to be cut back to
    with open(path, "ab") as f:
        f.write(b"\0" * 100)
    with pytest.raises(ValueError, match="summary"):
        appending.append(spark, path, rows(spark, "/new", 3), [spec("/new")])


def test_schema_data_and_other_records_stay(spark, tmp_path):
    path = recorded(tmp_path / "a.mcap")
    appending.append(spark, path, rows(spark, "/typed", 2), [spec("/typed", schema_encoding="ros2msg", schema_data=b"float64 x")])
    appending.append(spark, path, rows(spark, "/new", 2), [spec("/new")])
    with appending.Appender(path) as a:
        typed = next(c for c in a.channels.values() if c.topic == "/typed")
        assert a.schemas[typed.schema].endswith(b"float64 x") and len(a.channels) == 4
        a.others.append((appending.METADATA_INDEX, b"some index"))
        a.finish()
    appending.append(spark, path, rows(spark, "/new", 2, 50 * S), [spec("/new")])
    with appending.Appender(path) as a:
        assert a.others == [(appending.METADATA_INDEX, b"some index")] and len(a.schemas) == 4


def test_older_generations_are_taken_out(spark, tmp_path):
    path = recorded(tmp_path / "a.mcap")
    assert not appending.migrate(spark, path)
    for g in (1, 2, 3):
        assert writing.append_generation(path, "/made", "lcm", "kind/Made", [(float(k), b"%d" % g) for k in range(4)]) == 4
    assert len(read(path)["/made"]) == 12
    before = {k: v for k, v in read(path).items() if k != "/made"}
    assert appending.migrate(spark, path) and not appending.migrate(spark, path)
    got = read(path)
    assert [m[3] for m in got["/made"]] == [b"3"] * 4 and {k: v for k, v in got.items() if k != "/made"} == before
