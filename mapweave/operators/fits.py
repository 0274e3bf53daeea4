"""Robust fits and iterative solvers in numpy, each over one bounded group (a plane's band, a loop pair, a pose graph), sessions over many at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Pose = tuple[np.ndarray, np.ndarray]  # position, unit quaternion (x, y, z, w)


#: Distances that are held at once where a medoid is looked for.
PAIRS = 1_000_000
#: Rows from which whole groups are worked on at once.
BATCH = 65_536


def pose_distances(t: np.ndarray, q: np.ndarray, weight: float = 0.5, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
    """From `rows` to all: metres, and weight metres per radian. Groups may be stacked in front."""
    d = sum((t[..., rows, c][..., None] - t[..., None, :, c]) ** 2 for c in range(3))
    return np.sqrt(d) + weight * 2 * np.arccos(np.minimum(np.abs(q[..., rows, :] @ q.swapaxes(-1, -2)), 1.0))


def medoid(t: np.ndarray, q: np.ndarray, weight: float = 0.5, count: np.ndarray | None = None) -> int:
    """The pose with the least sum of distances to all, the first of equal ones; `count` says how often each is there. The distance is a metric, so a measured sum bounds all others from below (by how far they are from it), and poses whose bound is over the best sum are not measured.
    At most PAIRS distances are held; equal poses of a large group are measured once. Poses whose sums all but agree (on a circle, say) are all measured."""
    count = np.ones(len(t)) if count is None else count
    if len(t) ** 2 <= PAIRS:
        return int((pose_distances(t, q, weight) * count).sum(1).argmin())
    both, first, at = np.unique(np.c_[t, q], axis=0, return_index=True, return_inverse=True)
    t, q, m, count = both[:, :3], both[:, 3:], len(both), np.bincount(at.ravel(), count)
    n = count.sum()
    low, open_, best = np.zeros(m), np.ones(m, bool), (np.inf, len(at))
    rows = np.unique(np.linspace(0, m - 1, min(m, 16, max(1, PAIRS // m))).astype(int))
    while len(rows):
        d = pose_distances(t, q, weight, rows)
        sums = d @ count
        best = min(best, *zip(sums.tolist(), first[rows].tolist(), strict=True))
        open_[rows] = False
        for s, r in zip(sums, d, strict=True):
            np.maximum(low, np.abs(s - n * r), out=low)
        left = np.flatnonzero(open_ & (low <= best[0] + 1e-6 * n))  # arccos is exact to 1e-8
        rows = left[np.argsort(low[left], kind="stable")[: min(64, max(1, PAIRS // m))]]
    return best[1]


def robust_pose(t: np.ndarray, q: np.ndarray, delta: float = 0.05, weight: float = 0.5, steps: int = 5) -> Pose:
    """`robust_poses` of one group."""
    pos, rot = robust_poses(t[None], q[None], np.ones((1, len(t))), delta, weight, steps)
    return pos[0], rot[0]


def robust_poses(t: np.ndarray, q: np.ndarray, count: np.ndarray, delta: float = 0.05, weight: float = 0.5, steps: int = 5) -> Pose:
    """Of stacked groups of one size (group, pose, axis), count times each pose: the medoid, then reweighted means: Huber weights by the distance to the estimate; orientations by the leading eigenvector of the weighted sum of q q'."""
    if t.shape[1] ** 2 <= PAIRS:
        best = (pose_distances(t, q, weight) * count[:, None]).sum(2).argmin(1)
    else:
        best = np.array([medoid(*g[:2], weight, g[2]) for g in zip(t, q, count, strict=True)])
    pos, rot = (np.take_along_axis(a, best[:, None, None], 1)[:, 0] for a in (t, q))
    for _ in range(steps):
        r = np.linalg.norm(t - pos[:, None], axis=2) + weight * 2 * np.arccos(np.minimum(np.abs(q @ rot[:, :, None])[:, :, 0], 1.0))
        w = count * np.where(r <= delta, 1.0, delta / np.maximum(r, 1e-12))
        pos = (w[:, :, None] * t).sum(1) / w.sum(1)[:, None]
        rot = np.linalg.eigh((w[:, :, None] * q).swapaxes(1, 2) @ q)[1][:, :, -1]
    return pos, rot * np.where(rot[:, 3:] >= 0, 1, -1)


def _segment_poses(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """`robust_poses` of sorted poses (x, y, z, qx, qy, qz, qw), a group from each index of `first`: equal poses once, groups of one size at once."""
    other = np.r_[True, (p[1:] != p[:-1]).any(1)]
    other[first] = True
    kept = np.flatnonzero(other)
    count, first = np.diff(np.r_[kept, len(p)]).astype(float), np.searchsorted(kept, first)
    size = np.diff(np.r_[first, len(kept)])
    t, q = p[kept, :3], p[kept, 3:]
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    out = np.empty((len(first), 7))
    for m in np.unique(size):
        same = np.flatnonzero(size == m)
        for part in np.split(same, range(k := max(1, PAIRS // m**2), len(same), k)):
            at = first[part, None] + np.arange(m)
            out[part, :3], out[part, 3:] = robust_poses(t[at], q[at], count[at])
    return out


def session_poses(rows: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Per group of glimpses (x, y, z, qx, qy, qz, qw) with at least `least`: the robust pose and how many there were. Tasks take their sorted rows by whole groups, some BATCH rows at a time."""
    pose = [*"xyz", "qx", "qy", "qz", "qw"]

    def poses(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        first = np.flatnonzero(whole["__nth"].to_numpy() == 1)
        n = np.diff(np.r_[first, len(whole)])
        on = np.repeat(n >= least, n)
        first, n = first[n >= least], n[n >= least]
        if len(n):
            out = _segment_poses(np.column_stack([whole[c].to_numpy()[on] for c in pose]), np.cumsum(n) - n)
            keys = whole.select(by).take(first).columns
            yield from pa.table([*keys, pa.array(n), *map(pa.array, out.T)], [*by, "n", *pose]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            starts = np.flatnonzero(b.column("__nth").to_numpy() == 1)
            if len(starts) and size + starts[-1] >= BATCH:
                yield from poses([*held, b.slice(0, starts[-1])])
                held, size, b = [], 0, b.slice(starts[-1])
            held.append(b)
            size += len(b)
        if size:
            yield from poses(held)

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by) + ", n long, x double, y double, z double, qx double, qy double, qz double, qw double"
    d = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in pose])
    # the window brings a group's rows together and in order
    return d.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*pose))).mapInArrow(run, schema)


def plane(points: np.ndarray) -> tuple[float, float, float] | None:
    """z = a x + b y + c by least squares."""
    if len(points) < 3:
        return None
    m = np.c_[points[:, :2], np.ones(len(points))]
    s, *_ = np.linalg.lstsq(m, points[:, 2], rcond=None)
    return tuple(s)


def robust_plane(points: np.ndarray, threshold: float, draws: int = 300, tilt: float = 15.0, least: int = 30, seed: int = 1) -> tuple[tuple[float, float, float], int] | None:
    """Of seeded draws of three points, the first plane with most points within threshold and at most `tilt` degrees from level; refitted twice to its inliers. Points are sorted first, so the result does not depend on their order."""
    points = points[np.lexsort(points.T[::-1])]
    if len(points) < least:
        return None
    rng, best, count = np.random.Generator(np.random.PCG64(seed)), None, 0
    for _ in range(draws):
        some = points[rng.choice(len(points), 3, replace=False)]
        n = np.cross(some[1] - some[0], some[2] - some[0])
        if abs(n[2]) < 1e-9 or np.degrees(np.arccos(min(1.0, abs(n[2]) / np.linalg.norm(n)))) > tilt:
            continue
        a, b = -n[0] / n[2], -n[1] / n[2]
        c = some[0, 2] - a * some[0, 0] - b * some[0, 1]
        hit = int((np.abs(points @ [a, b, -1] + c) <= threshold).sum())
        if hit > count:
            best, count = (a, b, c), hit
    for _ in range(2):
        if best is None:
            return None
        near = points[np.abs(points @ [best[0], best[1], -1] + best[2]) <= threshold]
        if len(near) < least:
            return None
        best, count = plane(near), len(near)
    return best, count


def planes(rows: DataFrame, by: list[str], threshold: float) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = robust_plane(pdf[[*"xyz"]].to_numpy(float), threshold)
        return pd.DataFrame([[*pdf[by].iloc[0], *got[0], got[1]]] if got else [], columns=[*by, *"abc", "inliers"])

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by) + ", a double, b double, c double, inliers long"
    return rows.groupBy(*by).applyInPandas(run, schema)


def rotation(v: np.ndarray) -> np.ndarray:
    """The matrix of a rotation vector."""
    angle = np.linalg.norm(v)
    if angle < 1e-12:
        return np.eye(3)
    k = v / angle
    m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * m + (1 - np.cos(angle)) * m @ m


def log_rotation(r: np.ndarray) -> np.ndarray:
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return v / 2 if angle < 1e-9 else v * angle / (2 * np.sin(angle))


class _Grid:
    """Nearest target points by cells of the search radius."""

    def __init__(self, points: np.ndarray, radius: float) -> None:
        self.points, self.radius = points, radius
        key = np.floor(points / radius).astype(np.int64)
        self.low, self.span = key.min(0) - 1, key.max(0) - key.min(0) + 3
        flat = self._flat(key)
        self.order = np.argsort(flat, kind="stable")
        self.flat = flat[self.order]

    def _flat(self, key: np.ndarray) -> np.ndarray:
        k = np.clip(key - self.low, 0, self.span - 1)
        return (k[:, 0] * self.span[1] + k[:, 1]) * self.span[2] + k[:, 2]

    def nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (or -1) and distance of the nearest point within the radius."""
        best, far = np.full(len(at), -1), np.full(len(at), self.radius)
        key = np.floor(at / self.radius).astype(np.int64)
        for d in np.ndindex(3, 3, 3):
            k = key + d - 1
            inside = ((k >= self.low) & (k < self.low + self.span)).all(1)
            f = self._flat(k)
            a, z = np.searchsorted(self.flat, f, "left"), np.searchsorted(self.flat, f, "right")
            z[~inside] = a[~inside]
            for j in range(int((z - a).max(initial=0))):
                on = np.flatnonzero(a + j < z)
                i = self.order[a[on] + j]
                r = np.linalg.norm(self.points[i] - at[on], axis=1)
                closer = (r < far[on]) | ((r == far[on]) & (best[on] < 0))
                best[on[closer]], far[on[closer]] = i[closer], r[closer]
        return best, far


def local_normals(points: np.ndarray, radius: float, k: int = 30) -> np.ndarray:
    out = np.zeros_like(points)
    for i, p in enumerate(points):
        d = np.linalg.norm(points - p, axis=1)
        near = np.flatnonzero(d <= radius)
        near = near[np.argsort(d[near], kind="stable")[:k]]
        if len(near) >= 5:
            out[i] = np.linalg.eigh(np.cov(points[near].T))[1][:, 0]
    return out


def icp(source: np.ndarray, target: np.ndarray, normals: np.ndarray, most: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Point-to-plane registration: rotation, translation, mean squared distance of the matches, and the share of source points that match."""
    grid, r, t, fit, err = _Grid(target, most), np.eye(3), np.zeros(3), 0.0, np.inf
    for _ in range(steps):
        moved = source @ r.T + t
        i, d = grid.nearest(moved)
        on = (i >= 0) & (np.abs(normals[np.maximum(i, 0)]).sum(1) > 0)
        if on.sum() < 6:
            break
        p, q, n = moved[on], target[i[on]], normals[i[on]]
        fit, err = on.mean(), float((d[on] ** 2).mean())
        step, *_ = np.linalg.lstsq(np.c_[np.cross(p, n), n], ((q - p) * n).sum(1), rcond=None)
        turn = rotation(step[:3])
        r, t = turn @ r, turn @ t + step[3:]
        if np.linalg.norm(step) < 1e-7:
            break
    return r, t, err, float(fit)


def solve_blocks(h: list[dict[int, np.ndarray]], g: np.ndarray) -> np.ndarray:
    """Solves a symmetric positive definite system of blocks h[i][j] and right sides g[i] by elimination in order; only blocks that are there or fill in are touched (a chain stays a chain)."""
    h, g, done = [dict(row) for row in h], g.copy(), []
    for k, row in enumerate(h):
        near = sorted(j for j in row if j > k)
        x = np.linalg.solve(row[k], np.c_[g[k], *(row[j] for j in near)])
        m = len(g[k])
        cols = {j: x[:, 1 + m * c : 1 + m * (c + 1)] for c, j in enumerate(near)}
        for i in near:
            g[i] -= h[i][k] @ x[:, 0]
            for j in near:
                h[i][j] = h[i].get(j, 0) - h[i][k] @ cols[j]
        done.append((x[:, 0], cols))
    out = np.empty_like(g)
    for k in range(len(h) - 1, -1, -1):
        out[k] = done[k][0] - sum((c @ out[j] for j, c in done[k][1].items()), np.zeros_like(g[k]))
    return out


def solve_sparse(diag: np.ndarray, ends: np.ndarray, off: np.ndarray, g: np.ndarray) -> np.ndarray:
    """As `solve_blocks`, for diagonal blocks diag[i] and blocks off[e] at (i, j) = ends[e], i < j, each pair once. Nodes with at most two neighbours are eliminated many at a time (those that come before their neighbours in a fixed shuffle), so a chain takes rounds by the logarithm of its length; what is left goes one by one."""
    n, m = g.shape
    diag, g, live, done = diag.copy(), g.copy(), np.ones(n, bool), []
    turn = np.random.Generator(np.random.PCG64(1)).permutation(n)
    while True:
        degree = np.bincount(ends.ravel(), minlength=n)
        low = np.where(live & (degree <= 2), turn, n)
        least = low.copy()
        for a, b in ((0, 1), (1, 0)):
            np.minimum.at(least, ends[:, a], low[ends[:, b]])
        nodes = np.flatnonzero((low < n) & (low <= least))
        if not len(nodes):
            break
        at = np.full(n, -1)
        at[nodes] = np.arange(len(nodes))
        block, near = np.zeros((2, len(nodes), m, m)), np.full((2, len(nodes)), -1)
        for a, b in ((0, 1), (1, 0)):
            e = np.flatnonzero(at[ends[:, a]] >= 0)
            k, to = at[ends[e, a]], ends[e, b]
            order = np.lexsort((to, k))
            e, k, to = e[order], k[order], to[order]
            place = (np.r_[False, k[1:] == k[:-1]] if len(k) else np.zeros(0, bool)).astype(int) + (near[0, k] >= 0)
            near[place, k], block[place, k] = to, off[e] if a == 0 else off[e].transpose(0, 2, 1)
        x = np.linalg.solve(diag[nodes], np.concatenate([g[nodes][:, :, None], block[0], block[1]], axis=2))
        x0, xs = x[:, :, 0], (x[:, :, 1 : 1 + m], x[:, :, 1 + m :])
        for s in (0, 1):
            has = near[s] >= 0
            np.add.at(g, near[s][has], -np.einsum("kji,kj->ki", block[s][has], x0[has]))
            np.add.at(diag, near[s][has], -block[s][has].transpose(0, 2, 1) @ xs[s][has])
        done.append((nodes, near, x0, xs))
        live[nodes] = False
        keep, two = live[ends].all(1), (near >= 0).all(0)
        fill, pair = -block[0][two].transpose(0, 2, 1) @ xs[1][two], near[:, two].T
        swap = pair[:, 0] > pair[:, 1]
        fill[swap], pair[swap] = fill[swap].transpose(0, 2, 1), pair[swap][:, ::-1]
        ends, off = _merged(np.concatenate([ends[keep], pair]), np.concatenate([off[keep], fill]))
    out = np.zeros_like(g)
    rest = np.flatnonzero(live)
    if len(rest):
        at = np.full(n, -1)
        at[rest] = np.arange(len(rest))
        h = [{k: diag[i]} for k, i in enumerate(rest)]
        for (i, j), b in zip(at[ends], off, strict=True):
            h[i][j], h[j][i] = b, b.T
        out[rest] = solve_blocks(h, g[rest])
    for nodes, near, x0, xs in reversed(done):
        out[nodes] = x0 - sum(np.where((near[s] >= 0)[:, None], np.einsum("kij,kj->ki", xs[s], out[near[s]]), 0.0) for s in (0, 1))
    return out


def _merged(ends: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of the same place added up."""
    if not len(ends):
        return ends.reshape(0, 2), blocks
    pairs, to = np.unique(ends, axis=0, return_inverse=True)
    out = np.zeros((len(pairs), *blocks.shape[1:]))
    np.add.at(out, to.ravel(), blocks)
    return pairs, out


def _rotations(v: np.ndarray) -> np.ndarray:
    """`rotation` of many."""
    angle = np.linalg.norm(v, axis=1)
    x, y, z = (v / np.maximum(angle, 1e-12)[:, None]).T
    o = np.zeros_like(x)
    m = np.stack([o, -z, y, z, o, -x, -y, x, o], 1).reshape(-1, 3, 3)
    out = np.eye(3) + np.sin(angle)[:, None, None] * m + (1 - np.cos(angle))[:, None, None] * (m @ m)
    out[angle < 1e-12] = np.eye(3)
    return out


def _log_rotations(r: np.ndarray) -> np.ndarray:
    """`log_rotation` of many."""
    angle = np.arccos(np.clip((np.trace(r, axis1=1, axis2=2) - 1) / 2, -1, 1))
    v = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1)
    small = angle < 1e-9
    return v * np.where(small, 0.5, angle / np.where(small, 1.0, 2 * np.sin(angle)))[:, None]


def pose_graph(poses: list[Pose3], factors: list[tuple[int, int, Pose3, np.ndarray]], steps: int = 20, huber: float = np.inf) -> list[Pose3]:  # noqa: F821
    """Levenberg-Marquardt over poses (rotation matrix, position); factor (i, j, measured pose of j in i, 6 x 6 information: rotation, then translation). Node 0 is fixed. All factors are worked on at once."""
    if len(poses) < 2 or not factors:
        return poses
    damp, n = 1e-4, len(poses) - 1
    now_at = np.array([p[0] for p in poses], float), np.array([p[1] for p in poses], float)
    i, j = (np.array([f[c] for f in factors]) for c in (0, 1))
    back, there, info = np.array([f[2][0] for f in factors], float).transpose(0, 2, 1), np.array([f[2][1] for f in factors], float), np.array([f[3] for f in factors], float)
    turn = lambda m, v: np.einsum("kij,kj->ki", m, v)

    def residual(ri, ti, rj, tj) -> np.ndarray:
        inv = ri.transpose(0, 2, 1)
        return np.c_[_log_rotations(back @ inv @ rj), turn(back, turn(inv, tj - ti) - there)]

    def ends(at) -> list[np.ndarray]:
        return [at[0][i], at[1][i], at[0][j], at[1][j]]

    def sizes(e) -> np.ndarray:
        return np.sqrt(np.einsum("ki,kij,kj->k", e, info, e))

    def cost(at) -> float:
        s = sizes(residual(*ends(at)))
        return float(np.where(s <= huber, s * s, 2 * min(huber, 1e300) * s - min(huber, 1e150) ** 2).sum())

    now = cost(now_at)
    for _ in range(steps):
        own = ends(now_at)
        e = residual(*own)
        w = info * np.minimum(1.0, huber / np.maximum(sizes(e), 1e-300))[:, None, None]
        jac = np.empty((2, len(i), 6, 6))
        for side in (0, 1):
            for c in range(6):
                d = np.zeros(6)
                d[c] = 1e-6
                other = list(own)
                other[2 * side], other[2 * side + 1] = own[2 * side] @ rotation(d[:3]), own[2 * side + 1] + d[3:]
                jac[side, :, :, c] = (residual(*other) - e) / 1e-6
        h, g = np.zeros((n + 1, 6, 6)), np.zeros((n + 1, 6))
        left = [jac[s].transpose(0, 2, 1) @ w for s in (0, 1)]
        for s, node in ((0, i), (1, j)):
            np.add.at(g, node, -turn(left[s], e))
            np.add.at(h, node, left[s] @ jac[s])
        cross, pair, twice = left[0] @ jac[1], np.stack([i, j], 1), i == j
        np.add.at(h, i[twice], cross[twice] + cross[twice].transpose(0, 2, 1))
        swap = i > j
        cross[swap], pair[swap] = cross[swap].transpose(0, 2, 1), pair[swap][:, ::-1]
        free = (pair[:, 0] > 0) & ~twice
        places, off = _merged(pair[free] - 1, cross[free])
        h, g = h[1:], g[1:]
        h[:, range(6), range(6)] += damp * (h[:, range(6), range(6)] + 1e-9)
        step = solve_sparse(h, places, off, g)
        new = np.concatenate([now_at[0][:1], now_at[0][1:] @ _rotations(step[:, :3])]), np.concatenate([now_at[1][:1], now_at[1][1:] + step[:, 3:]])
        if (then := cost(new)) < now:
            done = now - then < 1e-10 * max(now, 1e-12)
            now_at, now, damp = new, then, damp / 3
            if done:
                break
        else:
            damp *= 5
            if damp > 1e8:
                break
    return [*zip(*now_at, strict=True)]


Pose3 = tuple[np.ndarray, np.ndarray]


def grouped(rows: DataFrame, by: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.groupBy(*by).applyInPandas(run, schema)


def icp_groups(rows: DataFrame, by: list[str], radius: float = 0.3) -> DataFrame:
    """Per group of source and target points (side 's' or 't'): translation, mean squared distance and fitness."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*"xyz"])
        s, t = (pdf.loc[pdf["side"] == k, [*"xyz"]].to_numpy(float) for k in "st")
        r, move, err, fit = icp(s, t, local_normals(t, radius))
        return pd.DataFrame([[*pdf[by].iloc[0], len(s), *move, float(np.linalg.norm(log_rotation(r))), err, fit]], columns=[*by, "n", *"xyz", "turn", "rmse2", "fitness"])

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by) + ", n long, x double, y double, z double, turn double, rmse2 double, fitness double"
    return grouped(rows, by, run, schema)
