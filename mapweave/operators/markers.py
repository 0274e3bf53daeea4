"""Marker glimpses: camera models, pose from a square's corners, sharpness, thresholds, codes, and the gates' numbers. Numpy kernels for one glimpse or image each."""

from __future__ import annotations

import numpy as np


def otsu(gray: np.ndarray) -> int:
    """The threshold of 256 bins that parts two classes best; the first of equals."""
    h = np.bincount(gray.ravel(), minlength=256).astype(float)
    w, m = h.cumsum(), (h * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
    between[~np.isfinite(between)] = -1
    return int(between.argmax())


def sharpness(gray: np.ndarray, box: tuple[int, int, int, int]) -> float:
    """Variance of the Laplacian over a box (x0, y0, x1, y1), edges reflected without repeating."""
    x0, y0, x1, y1 = box
    g = np.pad(gray[y0:y1, x0:x1].astype(float), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def tag_pixels(corners: np.ndarray) -> float:
    x, y = corners.T
    return float(np.sqrt(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)))


def undistorted(p: np.ndarray, k: np.ndarray, d: np.ndarray, fisheye: bool = False) -> np.ndarray:
    """Pixels to normalized image coordinates. Radial-tangential (up to eight coefficients) by fixed-point steps, equidistant by Newton's."""
    x = (p - [k[0, 2], k[1, 2]]) / [k[0, 0], k[1, 1]]
    if fisheye:
        r = np.linalg.norm(x, axis=1)
        t = r.copy()
        for _ in range(10):
            powers = t[:, None] ** np.arange(2, 10, 2)
            f = t * (1 + powers @ d[:4]) - r
            t -= f / (1 + powers @ (d[:4] * [3, 5, 7, 9]))
        return x * (np.tan(t) / np.where(r > 0, r, 1))[:, None]
    c = np.zeros(8)
    c[: min(8, len(d))] = d[:8]
    u = x.copy()
    for _ in range(5):
        r2 = (u**2).sum(1)
        radial = (1 + ((c[4] * r2 + c[1]) * r2 + c[0]) * r2) if len(d) == 5 else (1 + ((c[4] * r2 + c[1]) * r2 + c[0]) * r2) / (1 + ((c[7] * r2 + c[6]) * r2 + c[5]) * r2)
        tang = np.c_[2 * c[2] * u[:, 0] * u[:, 1] + c[3] * (r2 + 2 * u[:, 0] ** 2), c[2] * (r2 + 2 * u[:, 1] ** 2) + 2 * c[3] * u[:, 0] * u[:, 1]]
        u = (x - tang) / radial[:, None]
    return u


def homography(plane: np.ndarray, image: np.ndarray) -> np.ndarray:
    """From four plane points to normalized image points."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(plane, image, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(rhs)), 1).reshape(3, 3)


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v


def _refined(r: np.ndarray, t: np.ndarray, square: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gauss-Newton over the reprojection of the corners."""
    from .fits import rotation

    def errors(r_, t_) -> np.ndarray:
        p = square @ r_.T + t_
        return (p[:, :2] / p[:, 2:] - image).ravel()

    for _ in range(20):
        e, jac = errors(r, t), np.empty((8, 6))
        for c in range(6):
            d = np.zeros(6)
            d[c] = 1e-7
            jac[:, c] = (errors(rotation(d[:3]) @ r, t + d[3:]) - e) / 1e-7
        step = np.linalg.lstsq(jac, -e, rcond=None)[0]
        r, t = rotation(step[:3]) @ r, t + step[3:]
        if np.linalg.norm(step) < 1e-10:
            break
    return r, t, float(np.sqrt((errors(r, t) ** 2).mean()))


def square_pose(corners: np.ndarray, side: float, k: np.ndarray, d: np.ndarray, fisheye: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, position and RMS reprojection (normalized) of a square seen at four corners. A square's pose has a mirrored twin; the better of both wins."""
    h = side / 2
    square = np.array([[-h, h, 0], [h, h, 0], [h, -h, 0], [-h, -h, 0]])
    image = undistorted(corners, k, d, fisheye)
    m = homography(square[:, :2], image)
    scale = 2 / (np.linalg.norm(m[:, 0]) + np.linalg.norm(m[:, 1]))
    if m[2, 2] * scale < 0:
        scale = -scale
    a, b, t = (m * scale).T
    r = nearest_rotation(np.c_[a, b, np.cross(a, b)])
    best = _refined(r, t, square, image)
    n, sight = best[0][:, 2], best[1] / np.linalg.norm(best[1])
    axis = np.cross(n, sight)
    if np.linalg.norm(axis) > 1e-6:
        from .fits import rotation

        angle = 2 * np.arctan2(np.linalg.norm(axis), n @ sight)
        twin = _refined(rotation(axis / np.linalg.norm(axis) * angle) @ best[0], best[1], square, image)
        twin = min(twin, _refined(rotation(axis / np.linalg.norm(axis) * (angle - 2 * np.pi)) @ best[0], best[1], square, image), key=lambda x: x[2])
        best = min(best, twin, key=lambda x: x[2]) if twin[1][2] > 0 else best
    return best


def view_quality(position: np.ndarray, normal: np.ndarray) -> tuple[float, float]:
    """Distance to a marker and the angle (degrees) between its normal and the line of sight."""
    far = float(np.linalg.norm(position))
    return far, float(np.degrees(np.arccos(min(1.0, abs(normal @ position) / (far + 1e-9)))))


def identify(bits: np.ndarray, codes: list[np.ndarray], correct: int) -> tuple[int, int, int] | None:
    """(id, turns, distance) of the first code within floor(0.6 * correct) bits over four quarter turns."""
    most = int(0.6 * correct)
    for i, code in enumerate(codes):
        for turn in range(4):
            dist = int((np.rot90(bits, -turn) != code).sum())
            if dist <= most:
                return i, turn, dist
    return None


def without_nested(markers: list[tuple[float, np.ndarray]]) -> list[int]:
    """Of (size, corners), biggest first, those whose center lies in none kept before."""
    kept: list[int] = []
    for i in sorted(range(len(markers)), key=lambda i: (-markers[i][0], i)):
        c = markers[i][1].mean(0)

        def inside(q: np.ndarray, c=c) -> bool:
            e = np.roll(q, -1, 0) - q
            s = e[:, 0] * (c[1] - q[:, 1]) - e[:, 1] * (c[0] - q[:, 0])
            return bool((s >= 0).all() or (s <= 0).all())

        if not any(inside(markers[j][1]) for j in kept):
            kept.append(i)
    return sorted(kept)
