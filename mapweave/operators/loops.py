"""Loop closure over one recording's keyframes: candidates, submap registration, and the pose graph. In order, so one task per recording."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .fits import icp, local_normals, log_rotation, pose_graph


@dataclass
class Options:
    step_m: float = 0.5
    step_deg: float = 10.0
    search_m: float = 2.0
    gap_s: float = 20.0
    score: float = 0.3
    around: int = 10
    voxel: float = 0.2
    least_keyframes: int = 10
    pause_s: float = 5.0
    rotation_variance: float = 1e-6
    xy_variance: float = 1e-4
    z_variance: float = 1e-6
    loop_rotation_variance: float = 0.05


def downsampled(points: np.ndarray, voxel: float) -> np.ndarray:
    """The mean of each voxel, voxels in key order."""
    if not len(points):
        return points
    _, at, n = np.unique(np.floor(points / voxel).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    out = np.zeros((len(n), 3))
    np.add.at(out, at.ravel(), points)
    return out / n[:, None]


@dataclass
class Closer:
    """Feed scans (time, pose, points in the sensor's frame); corrected poses come back."""

    options: Options = field(default_factory=Options)
    times: list[float] = field(default_factory=list)
    raw: list = field(default_factory=list)
    poses: list = field(default_factory=list)
    scans: list[np.ndarray] = field(default_factory=list)
    factors: list = field(default_factory=list)
    loops: list[tuple[int, int]] = field(default_factory=list)
    last_loop: float = float("-inf")

    def is_keyframe(self, r: np.ndarray, t: np.ndarray) -> bool:
        if not self.raw:
            return True
        pr, pt = self.raw[-1]
        return np.linalg.norm(t - pt) > self.options.step_m or np.degrees(np.linalg.norm(log_rotation(pr.T @ r))) > self.options.step_deg

    def process(self, time: float, r: np.ndarray, t: np.ndarray, points: np.ndarray) -> bool:
        """True if the scan became a keyframe."""
        o = self.options
        if not self.is_keyframe(r, t):
            return False
        if self.raw:
            pr, pt = self.raw[-1]
            step = (pr.T @ r, pr.T @ (t - pt))
            qr, qt = self.poses[-1]
            self.poses.append((qr @ step[0], qr @ step[1] + qt))
            self.factors.append((len(self.raw) - 1, len(self.raw), step, np.diag(1 / np.array([o.rotation_variance] * 3 + [o.xy_variance, o.xy_variance, o.z_variance]))))
        else:
            self.poses.append((r, t))
        self.times.append(time)
        self.raw.append((r, t))
        self.scans.append(downsampled(points, o.voxel))
        if len(self.raw) >= o.least_keyframes and time - self.last_loop >= o.pause_s and self.search(len(self.raw) - 1):
            self.last_loop = time
            self.poses = pose_graph(self.poses, self.factors)
        return True

    def submap(self, at: int) -> np.ndarray:
        near = range(max(0, at - self.options.around), min(len(self.scans), at + self.options.around + 1))
        return downsampled(np.concatenate([self.scans[i] @ self.poses[i][0].T + self.poses[i][1] for i in near]), self.options.voxel)

    def search(self, at: int) -> bool:
        """Registers the keyframe on the submap of the nearest older one that is within reach and long ago."""
        o, here = self.options, self.poses[at][1]
        far = [(float(np.linalg.norm(self.poses[i][1] - here)), i) for i in range(at) if self.times[at] - self.times[i] > o.gap_s]
        far = sorted(x for x in far if x[0] <= o.search_m)
        if not far:
            return False
        to = far[0][1]
        target = self.submap(to)
        source = self.scans[at] @ self.poses[at][0].T + self.poses[at][1]
        r, t, err, _ = icp(source, target, local_normals(target, 3 * o.voxel))
        if not err <= o.score:
            return False
        pr, pt = r @ self.poses[at][0], r @ self.poses[at][1] + t
        qr, qt = self.poses[to]
        self.factors.append((to, at, (qr.T @ pr, qr.T @ (pt - qt)), np.diag(1 / np.array([o.loop_rotation_variance] * 3 + [max(err, 1e-4)] * 3))))
        self.loops.append((to, at))
        return True
