"""Scenes of voxel walls, all straightened in one call: each stands on a ground of its own, 20 m from the next."""

import math

import numpy as np
import pandas as pd
import pytest

from mapweave.operators import walls

V, APART = 0.05, 400
FLOOR = 0.025


class Scene:
    """Cells are (column, row, layer); a floor at layer 0."""

    def __init__(self):
        self.cells = {(i, j, 0) for i in range(120) for j in range(120)}

    def wall(self, a, b, thick, fringe=False, keep=lambda i, j, k: True):
        way = np.subtract(b, a) / math.dist(a, b)
        for i in range(120):
            for j in range(120):
                p = np.array([i + 0.5, j + 0.5]) * V - a
                t, d = p @ way, way[0] * p[1] - way[1] * p[0]
                if -thick / 2 - 1e-9 <= t <= math.dist(a, b) + thick / 2 + 1e-9 and abs(d) <= thick / 2 + 1e-9:
                    for k in range(1, 41):
                        if not keep(i, j, k):
                            continue
                        self.cells.add((i, j, k))
                        if fringe and (3 * i + 5 * j + 2 * k) % 13 == 0:  # now and then something hugs a face
                            off = (thick / 2 + V * (1 + k % 2)) * (1 if (i + j + k) % 2 else -1)
                            q = np.array([i + 0.5, j + 0.5]) * V + off * np.array([-way[1], way[0]])
                            self.cells.add((*np.floor(q / V).astype(int).tolist(), k))
        return self

    def footprint(self):
        return {(i, j) for i, j, k in self.cells if k > 0}


def only(a, b, thick):
    s = Scene()
    s.wall(a, b, thick)
    return s.footprint()


def in_band(c, a, b, width, edge=1e-6):
    way = np.subtract(b, a) / math.dist(a, b)
    p = np.array([c[0] + 0.5, c[1] + 0.5]) * V - a
    return -edge <= p @ way <= math.dist(a, b) + edge and abs(way[0] * p[1] - way[1] * p[0]) <= width / 2 + edge


def doubled():
    """A two-voxel wall that wanders by a voxel, its ghost three voxels off, and another wall across its left end."""
    s, rng = Scene().wall((1.025, 1.0), (1.025, 5.0), 0.1), np.random.default_rng(3)
    wander = np.repeat(rng.integers(0, 2, 30), 4)
    for i in range(22, 95):
        for k in range(1, 41):
            s.cells |= {(i, j + int(wander[i]), k) for j in (60, 61) if rng.random() < 0.85}
            s.cells |= {(i, 64, k)} if rng.random() < 0.6 else set()
            s.cells |= {(i, int(rng.integers(54, 70)), k)} if rng.random() < 0.04 else set()
    return s


def furnished():
    s = Scene().wall((0.5, 3.025), (5.5, 3.025), 0.05).wall((3.025, 3.1), (3.025, 5.5), 0.1)
    s.cells |= {(i, 60 + off, k) for i, off in SPECKS for k in (5, 6, 20)}
    s.cells |= {(i, j, k) for i in range(30, 42) for j in range(52, 60) for k in range(1, 17)}
    return s


SPECKS = [(20, 2), (24, -3), (46, 3), (51, -8), (72, 8), (81, -9), (93, 2)]
SLANT = (2.1, 1.5 + 2.4)
SCENES = {
    "thick": (Scene().wall((1.0, 3.025), (5.0, 3.025), 0.15, True), (2.3, 3.025), (3.8, 3.025), 0.4),
    "part": (doubled(), (1.6, 3.02), (3.9, 3.14), 0.4),
    "past": (doubled(), (0.9, 3.05), (5.2, 3.08), 0.45),
    "corner": (Scene().wall((1.0, 2.0), (4.0, 2.0), 0.1, True).wall((4.0, 2.0), (4.0, 5.0), 0.1), (1.2, 2.0), (4.3, 2.0), 0.4),
    "sharp": (Scene().wall((0.8, 1.5), (3.5, 1.5), 0.1, True).wall((3.5, 1.5), SLANT, 0.1), (1.0, 1.5), (3.6, 1.5), 0.4),
    "joint": (Scene().wall((1.025, 1.0), (1.025, 5.0), 0.15).wall((1.025, 3.0), (4.5, 3.0), 0.1, True), (0.9, 3.0), (4.4, 3.0), 0.4),
    "furnished": (furnished(), (0.8, 3.025), (5.2, 3.025), 0.4),
    "crossing": (Scene().wall((0.5, 3.0), (5.5, 3.0), 0.1, True).wall((3.0, 0.5), (3.0, 5.5), 0.1), (1.0, 3.0), (5.0, 3.0), 0.4),
    "door": (Scene().wall((0.5, 3.025), (5.5, 3.025), 0.05, True, lambda i, j, k: not 50 <= i < 68 or k > 30), (1.0, 3.025), (5.0, 3.025), 0.4),
    "gap": (Scene().wall((0.5, 3.025), (5.5, 3.025), 0.05, False, lambda i, j, k: not 50 <= i < 56), (1.0, 3.025), (5.0, 3.025), 0.4),
    "bare": (Scene(), (1.0, 3.0), (5.0, 3.0), 0.4),
}


def frames(spark, scenes, thickness=None, bottom=None, top=None, above=None):
    rows, strokes, cells = [], [], []
    for n, (s, a, b, width) in enumerate(scenes):
        dx = n * APART
        for c in sorted(s.cells):
            rows.append((len(rows), *((np.array(c) + [dx + 0.5, 0.5, 0.5]) * V).tolist()))
            cells.append(c)
        strokes.append((n, a[0] + dx * V, a[1], b[0] + dx * V, b[1], width, thickness, bottom, top, above))
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "x", "y", "z"]))
    kinds = "wall long, from_x double, from_y double, to_x double, to_y double, width double, thickness double, bottom double, top double, above_floor double"
    return points, spark.createDataFrame(strokes, kinds), cells


def edited(spark, scenes, **reach):
    """Per scene: cells removed, added, and all after the edit."""
    points, strokes, cells = frames(spark, scenes, **reach)
    removed, added = walls.straighten(points, strokes, V, FLOOR)
    gone, new = [set() for _ in scenes], [set() for _ in scenes]
    for r in removed.collect():
        gone[r.wall].add(cells[r.id])
    for r in added.collect():
        c = np.floor(np.array([r.x, r.y, r.z]) / V).astype(int)
        new[r.wall].add((int(c[0]) - r.wall * APART, int(c[1]), int(c[2])))
        assert abs(math.hypot(r.nx, r.ny) - 1) < 1e-9 and r.nz == 0
    return [(g, n, (s.cells - g) | n) for g, n, (s, *_) in zip(gone, new, scenes, strict=True)]


@pytest.fixture(scope="module")
def after(spark):
    return dict(zip(SCENES, edited(spark, [*SCENES.values()]), strict=True))


def columns(cells):
    return {(i, j) for i, j, k in cells if k > 0}


def rows_of(name, after, margin=0.1):
    """Per column of cells along x, the wall's rows in the band."""
    _, a, b, width = SCENES[name]
    held = columns(after[name][2])
    span = range(math.floor((a[0] + margin) / V), math.floor((b[0] - margin) / V) + 1)
    return [[j for j in range(120) if in_band((i, j), a, b, width) and (i, j) in held] for i in span]


@pytest.mark.parametrize("name", SCENES)
def test_nothing_changes_outside_the_band(after, name):
    _, a, b, width = SCENES[name]
    removed, added, _ = after[name]
    assert all(in_band(c, a, b, width) and c[2] > 0 for c in removed | added)
    assert bool(removed | added) == (name != "bare")


def test_fringe_goes_and_the_slab_is_the_wall(after):
    scene, a, b, width = SCENES["thick"]
    inside = lambda cs: {c for c in cs if in_band(c, a, b, width)}
    assert inside(columns(after["thick"][2])) == inside(only((1.0, 3.025), (5.0, 3.025), 0.15))
    assert {j for _, j in inside(columns(after["thick"][2]))} == {59, 60, 61}


@pytest.mark.parametrize("name", ["part", "past"])
def test_a_wall_seen_twice_becomes_one(after, name):
    rows = rows_of(name, after)
    rows = rows[3:] if name == "past" else rows  # beside the wall across, what leans on it carries on
    assert all(not r or r[-1] - r[0] == len(r) - 1 for r in rows)
    inner = [r for r in rows[5:-12]] if name == "past" else rows
    assert all(1 <= len(r) <= 3 for r in inner if r) and len({j for r in inner for j in r}) <= 3


def test_a_stroke_past_the_end_stops_at_the_last_voxel(after):
    assert max(i for i, _, _ in after["past"][1]) < 96
    assert only((1.025, 1.0), (1.025, 5.0), 0.1) <= columns(after["past"][2])


@pytest.mark.parametrize("name, mine, other, box, allowed", [
    ("corner", ((1.0, 2.0), (4.0, 2.0), 0.1), ((4.0, 2.0), (4.0, 5.0), 0.1), (24, 86, 36, 44), 2),
    ("sharp", ((0.8, 1.5), (3.5, 1.5), 0.1), ((3.5, 1.5), SLANT, 0.1), (20, 72, 26, 34), 3),
    ("joint", ((1.025, 3.0), (4.5, 3.0), 0.1), ((1.025, 1.0), (1.025, 5.0), 0.15), (18, 88, 56, 64), 2),
    ("crossing", ((0.5, 3.0), (5.5, 3.0), 0.1), ((3.0, 0.5), (3.0, 5.5), 0.1), (20, 100, 56, 64), 2),
])
def test_walls_that_meet_it_stay(after, name, mine, other, box, allowed):
    held, kept = columns(after[name][2]), only(*other)
    assert kept <= held
    near = lambda cs: {c for c in cs if box[0] <= c[0] < box[1] and box[2] <= c[1] < box[3]}
    want, got = near(only(*mine) | kept), near(held)
    assert len(want - got) <= allowed and len(got - want) <= allowed, (want - got, got - want)


def test_furniture_and_a_crossing_wall_stay_and_specks_go(after):
    held = columns(after["furnished"][2])
    assert only((3.025, 3.1), (3.025, 5.5), 0.1) <= held and {(i, j) for i in range(30, 42) for j in range(52, 60)} <= held
    assert [((i, 60 + off) in held) for i, off in SPECKS] == [abs(off) > 4 for _, off in SPECKS]


def test_a_doorway_keeps_its_header_and_a_narrow_gap_is_closed(after):
    low = {i: min((k for a, j, k in after["door"][2] if a == i and j == 60 and k > 0), default=None) for i in range(25, 95)}
    assert all(low[i] == (31 if 50 <= i < 68 else 1) for i in low), low
    assert {(i, 60, k) for i in range(50, 56) for k in range(1, 41)} <= after["gap"][1]


def test_reach_and_thickness(spark):
    scene = SCENES["thick"]
    (gone, new, _), = edited(spark, [scene], thickness=0.25, bottom=0.5, top=1.5)
    assert all(10 <= k < 30 for _, _, k in gone | new)
    assert {j for _, j, _ in new} >= {58, 62}
    (gone, new, _), = edited(spark, [scene], above=1.0)
    assert max(k for _, _, k in gone | new) <= 20


def test_a_jog_is_straightened_run_by_run(spark):
    a0, a1, b0, b1 = (2.025, 0.5), (2.025, 2.525), (1.625, 2.525), (1.625, 4.5)
    s = Scene().wall(a0, a1, 0.05, True).wall(a1, b0, 0.05, True).wall(b0, b1, 0.05, True)
    for a, b in (((2.025, 0.4), (2.025, 2.6)), ((2.1, 2.525), (1.55, 2.525)), ((1.625, 2.45), (1.625, 4.6))):
        (_, _, s.cells), = edited(spark, [(s, a, b, 0.3)])
    want = only(a0, a1, 0.05) | only(a1, b0, 0.05) | only(b0, b1, 0.05)
    assert want <= s.footprint() and len(s.footprint() - want) <= 4


def test_no_points_and_no_strokes(spark):
    points, strokes, _ = frames(spark, [SCENES["bare"]])
    for p, s in ((points.limit(0), strokes), (points, strokes.limit(0)), (points, strokes.selectExpr("wall", "from_x", "from_y", "from_x as to_x", "from_y as to_y", "width", "thickness", "bottom", "top", "above_floor"))):
        assert [d.count() for d in walls.straighten(p, s, V, FLOOR)] == [0, 0]
