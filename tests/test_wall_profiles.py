"""Heights along walls against plain loops, and plans and rank sharing that do not grow with one wall."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mapweave.functions import picks
from mapweave.operators import walls

KINDS = "wall long, bin int, bottom long, low long, high long"


def scenes():
    rng, rows = np.random.default_rng(8), []
    for wall, n in enumerate([1, 2, 7, 40, 90, 3, 250, 12]):
        open_from = int(rng.integers(0, n))
        for b in range(n):
            low = None if rng.random() < 0.2 or open_from <= b < open_from + 9 else int(rng.integers(0, 8))
            rows.append((wall, b, None if rng.random() < 0.3 or wall == 5 else int(rng.integers(-1, 2)), low, None if low is None else low + int(rng.integers(0, 5))))
    return rows


def plain(rows, voxel):
    """Doorways and extents of one wall, bin by bin."""
    reach, n = int(0.4 / voxel + 0.5), len(rows)
    middle = lambda v, part=2: sorted(v)[len(v) // part] if v else None
    usual = middle([r[3] for r in rows if r[2] is not None and r[3] is not None], 4)
    is_open = [bo is None or lo is None or lo - max(bo if usual is None else usual, bo) > int(0.5 / voxel + 0.5) for _, _, bo, lo, _ in rows]
    doors, b = [], 0
    while b < n:
        e = b
        while e < n and is_open[e]:
            e += 1
        if e > b and b > 0 and e < n and round((e - b) * voxel, 9) >= 0.6:
            doors.append((b, e - 1))
        b = max(e, b + 1)
    own = []
    for i in range(n):
        near = rows[max(i - reach, 0) : i + reach + 1]
        top = middle([r[4] for r in near if r[2] is not None and r[4] is not None])
        door = next((d for d in doors if d[0] <= i <= d[1]), None)
        if door:
            bottom = middle([r[3] for r in rows[door[0] : door[1] + 1] if r[2] is not None and r[3] is not None])
        else:
            bottom = rows[i][2] if rows[i][2] is not None else middle([r[2] for r in near if r[2] is not None])
        own.append(None if top is None or bottom is None else (bottom, top))
    known = [i for i in range(n) if own[i] is not None]
    return doors, [(i, *own[min(known, key=lambda j: (abs(i - j), j))]) for i in range(n) if known]


@pytest.mark.parametrize("batch", [3, 10000])
def test_heights_and_doorways_are_those_of_plain_loops(spark, batch):
    rows = scenes()
    d = spark.createDataFrame(rows, KINDS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got, doors = sorted(map(tuple, walls.extents(d, 0.1).collect())), sorted(map(tuple, walls.doorways(d, 0.1).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {w: plain([r for r in rows if r[0] == w], 0.1) for w in {r[0] for r in rows}}
    assert doors == sorted((w, *p) for w, (ps, _) in want.items() for p in ps) and doors
    assert got == sorted((w, *p) for w, (_, ps) in want.items() for p in ps)


def test_bins_are_read_and_dealt_once(spark):
    d = spark.createDataFrame(scenes(), KINDS)
    plan = walls.extents(d, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan ExistingRDD") == 1 and "unboundedfollowing" not in plan


def test_layers_of_a_slab_are_not_dealt(spark):
    heights = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 2, 1), (2, 0, 1, 2), (2, 1, 5, 5)], "wall long, bin int, bottom long, top long")
    held = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (1, 0, 9), (1, 1, 2), (2, 0, 1), (2, 0, 2), (3, 0, 0)], "wall long, bin int, k long")
    d = walls.additions(heights, held)
    assert sorted(map(tuple, d.collect())) == [(1, 0, 0), (1, 0, 2), (1, 0, 3), (2, 1, 5)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_first_rows_of_one_group_are_ranked_by_ranges(spark):
    rows = pd.DataFrame({"g": [0] * 4000 + [1] * 5, "v": [i * 37 % 500 for i in range(4005)], "id": range(4005)})
    got = picks.first_rows(spark.createDataFrame(rows), ["g"], ["v", "id"], F.greatest(F.expr("n * 6 div 10"), F.lit(4)))
    want = pd.concat([r.sort_values(["v", "id"]).head(max(len(r) * 6 // 10, 4)) for _, r in rows.groupby("g")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.to_numpy().tolist()))
    assert "__part" in got._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_fitted_without_a_window_over_its_points(spark):
    rng = np.random.default_rng(4)
    t, off = rng.random(3000) * 9, rng.normal(0, 0.05, 3000)
    off[::7] = 1.5
    points = spark.createDataFrame(pd.DataFrame({"wall": 0, "id": range(3000), "x": t - 0.5 * off, "y": 0.5 * t + off}))
    d = walls.trimmed_axis(points, ["wall"])
    line, = d.collect()
    assert line.n == 1800 and abs(line.dy / line.dx - 0.5) < 0.01
    for w in [x for x in d._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]:
        assert "__part" in w, w
