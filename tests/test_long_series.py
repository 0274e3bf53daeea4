"""Steps whose work must grow no faster than a series, a group or a cloud."""

import numpy as np
import pytest

from mapweave.operators import fits, frames, spatial, temporal

POSE = frames.POSE


@pytest.mark.parametrize("of", ["bracket", "ranged_bracket"])
def test_lookups_run_forward_over_a_series(spark, of):
    """Both samples around a probe; a frame that ends at the end of the series is evaluated anew for each row."""
    samples = [("a", 10, 1.0, 2), ("a", 10, 9.0, 3), ("a", 20, 2.0, 1), ("b", 5, 7.0, 1)]
    probes = [("a", 5, 1), ("a", 10, 2), ("a", 10, 3), ("a", 15, 4), ("a", 25, 5), ("b", 5, 6), ("c", 1, 7)]
    d = getattr(temporal, of)(spark.createDataFrame(probes, "k string, t long, id long"), spark.createDataFrame(samples, "k string, t long, v double, seq long"), ["k"], "t", "v", "seq")
    got = {r["id"]: (r["t0"], r["v0"], r["t1"], r["v1"]) for r in d.collect()}
    none = (None, None)
    assert got == {1: (*none, 10, 1.0), 2: (10, 1.0, 10, 1.0), 3: (10, 1.0, 10, 1.0), 4: (10, 1.0, 20, 2.0), 5: (20, 2.0, *none), 6: (5, 7.0, 5, 7.0), 7: (*none, *none)}
    assert "unboundedfollowing" not in d._jdf.queryExecution().toString().lower()


def test_long_series_against_search(spark):
    rng = np.random.default_rng(5)
    times, probes = np.unique(rng.integers(0, 10**6, 3000)), rng.integers(-1000, 10**6 + 1000, 5000)
    s = spark.createDataFrame([(0, int(t), float(i), i) for i, t in enumerate(times)], "k int, t long, v double, seq long").repartition(4)
    p = spark.createDataFrame([(0, int(t), i) for i, t in enumerate(probes)], "k int, t long, id long").repartition(4)
    got = {r["id"]: (r["t0"], r["t1"]) for r in temporal.ranged_bracket(p, s, ["k"], "t", "v", "seq").collect()}
    a, b = np.searchsorted(times, probes, "right") - 1, np.searchsorted(times, probes, "left")
    assert got == {i: (int(times[a[i]]) if a[i] >= 0 else None, int(times[b[i]]) if b[i] < len(times) else None) for i in range(len(probes))}


def test_sparse_solve_and_long_chain():
    rng = np.random.default_rng(2)
    pairs = np.array(sorted({(k, k + 1) for k in range(59)} | {(3, 40), (10, 50), (10, 30), (0, 59)}))
    a, off = np.zeros((60, 3, 60, 3)), []
    for i, j in pairs:
        m = rng.normal(size=(3, 6))
        m = (m.T @ m).reshape(2, 3, 2, 3)
        for u, x in enumerate((i, j)):
            for v, y in enumerate((i, j)):
                a[x, :, y] += m[u, :, v]
        off.append(m[0, :, 1])
    a += np.eye(180).reshape(60, 3, 60, 3)
    g = rng.normal(size=(60, 3))
    got = fits.solve_sparse(np.array([a[k, :, k] for k in range(60)]), pairs, np.array(off), g)
    assert np.allclose(got.ravel(), np.linalg.solve(a.reshape(180, 180), g.ravel()))
    # a chain takes few rounds: 20,000 nodes at once
    n = 20_000
    x = fits.solve_sparse(np.full((n, 1, 1), 3.0), np.c_[np.arange(n - 1), np.arange(1, n)], np.full((n - 1, 1, 1), -1.0), np.ones((n, 1)))
    assert np.isclose(x[n // 2, 0], 1.0)


def test_medoid_measures_few_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    t = np.c_[rng.gamma(1, 0.4, 3000), rng.random(3000), np.zeros(3000)]
    t = np.r_[t, t[:500]]  # equal poses
    q = np.c_[np.zeros((len(t), 2)), np.sin(t[:, 1] / 3), np.cos(t[:, 1] / 3)]
    want, held, whole = int(fits.pose_distances(t, q).sum(1).argmin()), [], fits.pose_distances
    monkeypatch.setattr(fits, "pose_distances", lambda *a: held.append(whole(*a)) or held[-1])
    assert fits.medoid(t, q) == want
    assert sum(d.size for d in held) < len(t) ** 2 / 2 and max(d.size for d in held) <= fits.PAIRS


def plain_pose(t, q):
    """A group by itself: all pairs, then five weighted means."""
    best = fits.pose_distances(t, q).sum(1).argmin()
    pos, rot = t[best], q[best]
    for _ in range(5):
        r = np.linalg.norm(t - pos, axis=1) + np.arccos(np.minimum(np.abs(q @ rot), 1.0))
        w = np.where(r <= 0.05, 1.0, 0.05 / np.maximum(r, 1e-12))
        pos = (w[:, None] * t).sum(0) / w.sum()
        rot = np.linalg.eigh((w[:, None, None] * q[:, :, None] * q[:, None, :]).sum(0))[1][:, -1]
    return np.r_[pos, rot * (1 if rot[3] >= 0 else -1)]


def test_session_poses_of_many_groups_at_once(spark, monkeypatch):
    """Groups over the ends of batches, of up to two rows, of copies, and one that is too large for all pairs."""
    rng, rows = np.random.default_rng(6), []
    sizes = [*rng.integers(1, 9, 400).tolist(), 70, 150, 1300]
    for k, n in enumerate(sizes):
        p = np.c_[rng.gamma(1, 0.4, (n, 3)), rng.normal(size=(n, 4)) * 0.2 + [0, 0, 0, 1]]
        p = np.r_[p, p[: n // 3], p[: n // 3]] if n > 5 else p
        rows += [(None if k == 7 else k, *x) for x in rng.permutation(p).tolist()]
    d = spark.createDataFrame(rows, "k long, x double, y double, z double, qx double, qy double, qz double, qw double").repartition(3)
    monkeypatch.setattr(fits, "BATCH", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        poses = fits.session_poses(d, ["k"])
        got = {r[0]: r[1:] for r in poses.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for k, *p in rows:
        groups.setdefault(k, []).append(p)
    assert set(got) == {k for k, g in groups.items() if len(g) >= 3}
    for k, (n, *pose) in got.items():
        p = np.array(sorted(groups[k]))
        assert n == len(p) and np.allclose(pose, plain_pose(p[:, :3], p[:, 3:] / np.linalg.norm(p[:, 3:], axis=1, keepdims=True)), atol=1e-9)
    assert "FlatMapGroups" not in poses._jdf.queryExecution().executedPlan().toString()  # no call of Python per group


def test_groups_of_one_size_take_one_call(monkeypatch):
    rng, calls, whole = np.random.default_rng(7), [], fits.robust_poses
    n = rng.integers(3, 8, 5000)
    p = np.c_[rng.random((n.sum(), 3)), np.zeros((n.sum(), 3)), np.ones(n.sum())]
    monkeypatch.setattr(fits, "robust_poses", lambda *a: calls.append(len(a[0])) or whole(*a))
    assert fits._segment_poses(p, np.cumsum(n) - n).shape == (5000, 7)
    assert len(calls) == 5 and sum(calls) == 5000


def test_neighbours_of_a_dense_cloud_with_copies(spark, monkeypatch):
    """Every pair within 0.1 would be millions here."""
    rng = np.random.default_rng(4)
    p = np.r_[rng.normal(size=(2000, 3)) * 0.01, np.zeros((2000, 3)), [[5.0, 0, 0], [5.0, 0, 0]]]
    d = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    pairs, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a: pairs.append(join(*a).count()) or join(*a))
    got = {}
    for r in spatial.nearest(d, d, 4, 0.1).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    for i in [*range(0, 4002, 97), 4000, 4001]:
        away = np.sqrt(((p - p[i]) ** 2).sum(1))
        order = [int(j) for j in np.lexsort((np.arange(len(p)), away)) if j != i][:4]
        assert [got[i][r] for r in (1, 2, 3, 4)] == order
    assert len(got) == len(p) and sum(pairs) < 100 * len(p)
