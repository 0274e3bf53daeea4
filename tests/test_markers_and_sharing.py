import math

import numpy as np
import pytest

from mapweave.operators import markers as K
from mapweave.operators import sharing
from mapweave.operators.fits import rotation
from mapweave.operators.loops import Closer, downsampled

CAMERA = np.array([[600.0, 0, 320], [0, 600, 240], [0, 0, 1]])


@pytest.mark.parametrize("turn", [(0.1, 0.2, 0.3), (0.6, -0.3, 1.2), (-0.4, 0.5, -2.0)])
def test_square_pose(turn):
    r, t = rotation(np.array([math.pi, 0, 0])) @ rotation(np.array(turn)), np.array([0.1, -0.05, 0.8])
    h = 0.05
    p = np.array([[-h, h, 0], [h, h, 0], [h, -h, 0], [-h, -h, 0]]) @ r.T + t
    seen = p[:, :2] / p[:, 2:] * 600 + [320, 240]
    got_r, got_t, err = K.square_pose(seen, 0.1, CAMERA, np.zeros(5))
    assert np.allclose(got_t, t, atol=1e-4) and np.allclose(got_r, r, atol=1e-3) and err < 1e-6
    far, angle = K.view_quality(got_t, got_r[:, 2])
    assert math.isclose(far, np.linalg.norm(t), abs_tol=1e-4) and 0 <= angle <= 90


def test_undistortion():
    x = np.array([[0.1, -0.2], [0.3, 0.05]])
    d = np.array([-0.1, 0.02, 0.001, -0.002, 0.003])
    r2 = (x**2).sum(1)
    bent = x * (1 + d[0] * r2 + d[1] * r2**2 + d[4] * r2**3)[:, None]
    bent += np.c_[2 * d[2] * x[:, 0] * x[:, 1] + d[3] * (r2 + 2 * x[:, 0] ** 2), d[2] * (r2 + 2 * x[:, 1] ** 2) + 2 * d[3] * x[:, 0] * x[:, 1]]
    assert np.allclose(K.undistorted(bent * 600 + [320, 240], CAMERA, d), x, atol=1e-5)


def test_images():
    g = np.r_[np.full(50, 20), np.full(30, 200)].astype(np.uint8).reshape(8, 10)
    assert 20 <= K.otsu(g) < 200
    assert K.sharpness(np.full((9, 9), 7, np.uint8), (0, 0, 9, 9)) == 0
    assert K.tag_pixels(np.array([[0, 0], [4, 0], [4, 4], [0, 4]])) == 4


def test_codes():
    r = np.random.Generator(np.random.PCG64(1))
    codes = [r.integers(0, 2, (6, 6)) for _ in range(5)]
    bits = np.rot90(codes[3], 1).copy()
    bits[0, 0] ^= 1
    assert K.identify(bits, codes, 5) == (3, 1, 1) and K.identify(1 - codes[0], codes[:1], 2) is None
    box = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert K.without_nested([(4, box / 2 + 1), (10, box), (10, box + 50)]) == [1, 2]


def test_codec(spark):
    r = np.random.Generator(np.random.PCG64(2))
    keys = np.unique(r.integers(-50, 400, (3000, 3)), axis=0)
    got = sharing.unpack(sharing.pack(r.permutation(keys)))
    assert (np.unique(got, axis=0) == keys).all() and len(got) == len(keys)
    assert len(sharing.unpack(sharing.pack(keys[:0]))) == 0
    v = np.array([0, 1, 127, 128, 300, 2**40], np.uint64)
    assert (sharing.integers(sharing.varints(v)) == v).all()
    with pytest.raises(ValueError):
        sharing.integers(b"\x80")
    d = spark.createDataFrame([(float(x) * 0.5, float(x % 7) * 0.5, 0.0) for x in range(200)], "x float, y float, z float")
    assert sharing.unpacked(sharing.packed(d, 0.5)).distinct().count() == 200


def test_loop_closure_halves_the_drift():
    """Two laps of a square corridor with yaw drift."""
    g = np.arange(-6, 6, 0.25)
    walls = np.r_[[(x, s * 6, z) for x in g for s in (-1, 1) for z in (0, 0.5, 1)], [(s * 6, y, z) for y in g for s in (-1, 1) for z in (0, 0.5, 1)], [(x, y, 0) for x in g[::2] for y in g[::2]]].astype(float)
    c, true, raw, yaw = Closer(), [], [], 0.0
    pos = np.zeros(3)
    for i in range(80):
        a = 2 * math.pi * i / 40
        r, t = rotation(np.array([0, 0, a])), 4 * np.array([math.cos(a), math.sin(a), 0])
        if true:
            pr, pt = true[-1]
            yaw += 0.002
            step_r, step_t = pr.T @ r @ rotation(np.array([0, 0, 0.002])), pr.T @ (t - pt)
            pos = raw[-1][0] @ step_t + raw[-1][1]
            raw.append((raw[-1][0] @ step_r, pos))
        else:
            raw.append((r, t))
        true.append((r, t))
        local = (walls - t) @ r
        c.process(float(i), *raw[-1], local[np.linalg.norm(local, axis=1) < 8])
    assert c.loops and len(c.poses) == 80
    err = lambda poses: np.mean([np.linalg.norm(p[1] - q[1]) for p, q in zip(poses[40:], true[40:], strict=True)])
    assert err(c.poses) < 0.5 * err(raw)


def test_downsampled():
    assert downsampled(np.array([[0.1, 0, 0], [0.3, 0, 0], [1.2, 0, 0]]), 1.0).tolist() == [[0.2, 0, 0], [1.2, 0, 0]]
