"""Correcting a whole recording: what moves, tag sightings as factors, the solve per recording, and the correction as samples of an edge.

Poses are structs of t and q (`frames.POSE`), times long microseconds. Lookups over time are range-sorted (`temporal.ranged_bracket`); a recording's keyframes (a few per metre of path), loops and sightings are one group of one task, which is what a pose graph needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.geometry import compose, invert, let, place, quaternion, slerp
from mapweave.functions.work import written

from . import fits
from .frames import POSE, poses_at
from .temporal import gap_sessions, ranged_bracket

S = 1_000_000
#: What a tag's pose is worth. Variances of its turn and place along its own axes at 0.4 m and 1 px; they grow with the squares of both, not below a quarter.
TURN, MOVE, NEAR, SHARP, LEAST = (0.04, 0.04, 0.0025), (0.0025, 0.0025, 0.25), (0.4, 0.2), (1.0, 0.5), 0.25
#: Standard deviations of odometry between keyframes (turn in rad, place in m a step) and of loops.
ODOMETRY, LOOP = (0.01, 0.02), (0.02, 0.05)
#: A trajectory is not read across a longer gap, nor further outside.
GAP, OUTSIDE = 2 * S, 200_000


# ---- what moves ----


@dataclass
class Plan:
    """The sensor whose motion is corrected, the moving edge (parent, child) over it, and the frame above the parent that gets the correction."""

    sensor: str
    parent: str
    child: str
    above: str
    replaces: bool
    notes: list[str] = field(default_factory=list)


def plan(graph: list[tuple[str, str, int, bool]], frame: str, sensor: str = "", above: str = "world") -> Plan:
    """graph: parent, child, samples, fixed of a recording's edges (tens). frame: of the cloud. A cloud in the root of its tree needs the sensor's own frame. A frame has the parent with the most samples."""
    up: dict[str, tuple[str, int, bool]] = {}
    for parent, child, samples, fixed in sorted(graph):
        if child not in up or samples > up[child][1]:
            up[child] = parent, samples, fixed
    names = {x for p, c, _, _ in graph for x in (p, c)}

    def root(at: str) -> str:
        seen = {at}
        while at in up and up[at][0] not in seen:
            at = up[at][0]
            seen.add(at)
        return at

    frame, sensor, notes = frame.lstrip("/"), sensor.lstrip("/"), []
    if frame not in names:
        raise ValueError(f"{frame} is not in the frame tree")
    if frame not in up:
        if not sensor:
            raise ValueError(f"{frame} is a root: the sensor's own frame is needed")
        if sensor not in up or root(sensor) != frame:
            raise ValueError(f"{sensor} is not under {frame}")
        notes.append(f"clouds in {frame} are moved back into {sensor} first")
    else:
        sensor = frame
    child = sensor
    while up[child][2]:
        child = up[child][0]
        if child not in up:
            raise ValueError(f"nothing moves {sensor}: there is no odometry to correct")
    if child != sensor:
        notes.append(f"{sensor} is fixed to {child}")
    parent = up[child][0]
    if parent in up:
        notes.append(f"the edge from {up[parent][0]} to {parent} is replaced")
        return Plan(sensor, parent, child, up[parent][0], True, notes)
    above = above.strip().lstrip("/") or "world"
    if above in names and root(above) == root(parent):
        raise ValueError(f"{above} is in the tree of {parent} already")
    return Plan(sensor, parent, child, above, False, notes)


# ---- tags ----


def _mid(a: Column, b: Column, u: Column) -> Column:
    return F.struct(F.struct(*[(a["t"][c] + (b["t"][c] - a["t"][c]) * u).alias(c) for c in "xyz"]).alias("t"), slerp(quaternion(a["q"]), quaternion(b["q"]), u).alias("q")).cast(POSE)


def _times(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: compose(s["a"]["t"], s["a"]["q"], s["b"]["t"], s["b"]["q"])).cast(POSE)


def pose_at(probes: DataFrame, trajectory: DataFrame, by: list[str], name: str = "raw") -> DataFrame:
    """Adds the trajectory's pose at each probe's t: between two samples no more than GAP apart, or an end's within OUTSIDE of it, else null. trajectory: by, t, seq, pose."""
    d = ranged_bracket(probes, trajectory, by, "t", "pose", "seq")
    a, b, t = F.col("v0"), F.col("v1"), F.col("t")
    inside = F.when(F.col("t0") == F.col("t1"), a).when(F.col("t1") - F.col("t0") <= GAP, _mid(a, b, (t - F.col("t0")) / (F.col("t1") - F.col("t0"))))
    both = a.isNotNull() & b.isNotNull()
    got = F.when(both, inside).when(a.isNull() & (F.col("t1") - t < OUTSIDE), b).when(b.isNull() & (t - F.col("t0") < OUTSIDE), a)
    return d.select(*probes.columns, got.cast(POSE).alias(name))


def sightings(detections: DataFrame, tf: DataFrame, trajectory: DataFrame, sensor: str, camera: str, tolerance: int = 100_000) -> DataFrame:
    """Adds to detections of one recording (t, pose: of the tag in the camera) `sensor_tag`, the tag in the sensor, and `raw`, the sensor's pose; null where there is none, so both null counts as not placed. The camera's mount is taken at the time, else whenever it is known."""
    ever = 1 << 60
    timed = poses_at(detections, tf, sensor, camera, tolerance).withColumnRenamed("pose", "__a")
    always = poses_at(detections, tf, sensor, camera, ever).withColumnRenamed("pose", "__b")
    d = detections.join(timed, "t", "left").join(always, "t", "left").withColumn("__m", F.coalesce("__a", "__b"))
    d = d.withColumn("sensor_tag", F.when(F.col("__m").isNotNull(), _times(F.col("__m"), F.col("pose")))).select(*detections.columns, "sensor_tag")
    one = d.withColumn("__one", F.lit(1))
    return pose_at(one, trajectory.withColumn("__one", F.lit(1)), ["__one"]).drop("__one")


def variance_scale(distance: Column, pixels: Column) -> Column:
    """How much less a glimpse is worth than one from 0.4 m at a reprojection error of 1 px."""
    far, blurred = F.greatest(distance, F.lit(NEAR[1])) / NEAR[0], F.greatest(pixels, F.lit(SHARP[1])) / SHARP[0]
    return F.greatest(far * far * blurred * blurred, F.lit(LEAST))


def information(rotation: np.ndarray, distance: float, pixels: float) -> np.ndarray:
    """6 x 6, turn before place, of a tag seen in a frame where its own axes are the columns of rotation."""
    scale = max((max(distance, NEAR[1]) / NEAR[0]) ** 2 * (max(pixels, SHARP[1]) / SHARP[0]) ** 2, LEAST)
    out = np.zeros((6, 6))
    for k, variances in ((0, TURN), (3, MOVE)):
        out[k : k + 3, k : k + 3] = rotation @ np.diag(1 / (scale * np.array(variances))) @ rotation.T
    return out


def tag_spread(seen: DataFrame, by: list[str], marker: str = "marker", gap: int = 20 * S) -> DataFrame:
    """Per recording, over the markers seen in at least two visits (more than `gap` apart): markers, and the mean of how far the visits' mean places lie about their own mean (root of the mean square). seen: by, marker, t, x, y, z."""
    keys = [*by, marker]
    visits = gap_sessions(seen, keys, "t", gap, ["x", "y", "z"]).groupBy(*keys, "session").agg(*[F.avg(a).alias(a) for a in "xyz"])
    spread = visits.groupBy(*keys).agg(F.count("*").alias("visits"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread")).where("visits >= 2")
    return spread.groupBy(*by).agg(F.count("*").alias("markers"), F.avg("spread").alias("spread"))


def tag_places(seen: DataFrame, pose: str) -> DataFrame:
    """x, y, z of the tags of sightings when the sensor is at `pose`; sightings without are left out."""
    at = let(F.struct(F.col(pose).alias("m"), F.col("sensor_tag.t").alias("p")), lambda s: place(s["m"]["t"], s["m"]["q"], s["p"]))
    d = seen.where(F.col(pose).isNotNull() & F.col("sensor_tag").isNotNull()).withColumn("__at", at)
    return d.select(*[c for c in seen.columns if c not in "xyz"], *[F.col(f"__at.{a}").alias(a) for a in "xyz"])


# ---- the solve ----

_FLAT = ["x", "y", "z", "qx", "qy", "qz", "qw"]


def _flat(pose: str) -> list[Column]:
    return [F.col(f"{pose}.t.{a}").alias(a) for a in "xyz"] + [F.col(f"{pose}.q.{a}").alias(f"q{a}") for a in "xyzw"]


def _matrix(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y, z, w = row[3:7] / (np.linalg.norm(row[3:7]) or 1.0)
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return r, row[:3]


def _between(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    return a[0].T @ b[0], a[0].T @ (b[1] - a[1])


def _after(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    return a[0] @ b[0], a[0] @ b[1] + a[1]


def _diagonal(turn: float, move: float) -> np.ndarray:
    return np.diag([turn**-2] * 3 + [move**-2] * 3)


def solve(keyframes: DataFrame, loops: DataFrame, seen: DataFrame, by: str = "recording", steps: int = 30) -> DataFrame:
    """by, t, pose, corrected of each keyframe: one graph per recording of odometry between keyframes, loops (by, t, to, pose of `to` in t's) and tag sightings (by, t, marker, sensor_tag, raw, distance, pixels), each marker a node of its own. The first keyframe stays.

    Sightings hang on the keyframe before them, moved by the raw motion since; loops that name no keyframe, and sightings that could not be placed, are left out."""
    null = lambda kind, c: F.lit(None).cast(kind).alias(c)
    k = keyframes.select(by, F.lit("k").alias("kind"), "t", null("long", "to"), null("long", "marker"), *_flat("pose"), *[null("double", f"r{c}") for c in _FLAT], null("double", "distance"), null("double", "pixels"))
    lp = loops.select(by, F.lit("l").alias("kind"), "t", F.col("to").cast("long").alias("to"), null("long", "marker"), *_flat("pose"), *[null("double", f"r{c}") for c in _FLAT], null("double", "distance"), null("double", "pixels"))
    raw = [c.alias(f"r{n}") for c, n in zip(_flat("raw"), _FLAT, strict=True)]
    sg = seen.where("sensor_tag is not null and raw is not null").select(by, F.lit("s").alias("kind"), "t", null("long", "to"), F.col("marker").cast("long").alias("marker"), *_flat("sensor_tag"), *raw, "distance", "pixels")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[pdf["kind"] == "k"].drop_duplicates("t").sort_values("t")
        if not len(keys):
            return pd.DataFrame(columns=[by, "t", *[f"c{k}" for k in range(12)]])
        times = keys["t"].to_numpy()
        rows = keys[_FLAT].to_numpy(float)
        first = [_matrix(r) for r in rows]
        nodes = list(first)
        factors = [(i, i + 1, _between(first[i], first[i + 1]), _diagonal(*ODOMETRY)) for i in range(len(first) - 1)]
        at = {t: i for i, t in enumerate(times.tolist())}
        for r in pdf[pdf["kind"] == "l"].sort_values(["t", "to"]).itertuples():
            i, j = at.get(r.t), at.get(int(r.to))
            if i is not None and j is not None and i != j:
                factors.append((i, j, _matrix(np.array([getattr(r, c) for c in _FLAT], float)), _diagonal(*LOOP)))
        markers: dict[int, int] = {}
        for r in pdf[pdf["kind"] == "s"].sort_values(["t", "marker"]).itertuples():
            i = max(0, int(np.searchsorted(times, r.t, "right")) - 1)
            tag = _matrix(np.array([getattr(r, c) for c in _FLAT], float))
            own = _matrix(np.array([getattr(r, f"r{c}") for c in _FLAT], float))
            measured = _after(_between(first[i], own), tag)
            if (m := int(r.marker)) not in markers:
                markers[m] = len(nodes)
                nodes.append(_after(first[i], measured))
            # the residual's frame is the tag's own, in which its axes are those of the variances
            factors.append((i, markers[m], measured, information(np.eye(3), r.distance, r.pixels)))
        done = fits.pose_graph(nodes, factors, steps)[: len(first)] if len(nodes) > 1 else nodes
        out = np.array([np.r_[r.ravel(), t] for r, t in done])
        return pd.DataFrame({by: keys[by].to_numpy(), "t": times, **{f"c{k}": out[:, k] for k in range(12)}})

    kind = dict(keyframes.dtypes)[by]
    got = k.unionByName(lp).unionByName(sg).groupBy(by).applyInPandas(run, f"{by} {kind}, t long, " + ", ".join(f"c{k} double" for k in range(12)))
    m = [[F.col(f"c{3 * i + j}") for j in range(3)] for i in range(3)]
    w = F.sqrt(F.greatest(1 + m[0][0] + m[1][1] + m[2][2], F.lit(0.0))) / 2
    parts = [F.sqrt(F.greatest(1 + s[0] * m[0][0] + s[1] * m[1][1] + s[2] * m[2][2], F.lit(0.0))) / 2 for s in ((1, -1, -1), (-1, 1, -1), (-1, -1, 1))]
    signs = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    turned = [F.when(s < 0, -p).otherwise(p).alias(a) for s, p, a in zip(signs, parts, "xyz", strict=True)]
    corrected = F.struct(F.struct(*[F.col(f"c{9 + i}").alias(a) for i, a in enumerate("xyz")]).alias("t"), F.struct(*turned, w.alias("w")).alias("q")).cast(POSE)
    return keyframes.join(got.select(by, "t", corrected.alias("corrected")), [by, "t"]).select(by, "t", "pose", "corrected")


def corrections(solved: DataFrame, by: str = "recording") -> DataFrame:
    """by, t, seq, pose: what moves each keyframe from where odometry had it to where it belongs."""
    back = let(F.struct(F.col("corrected").alias("c"), F.col("pose").alias("p")), lambda s: let(invert(s["p"]["t"], s["p"]["q"]), lambda i: compose(s["c"]["t"], s["c"]["q"], i["t"], i["q"])))
    return solved.select(by, "t", F.lit(0).alias("seq"), back.cast(POSE).alias("pose"))


def correction_at(probes: DataFrame, corrected: DataFrame, by: str = "recording", name: str = "correction") -> DataFrame:
    """Adds the correction at each probe's t: between keyframes, or the end's. corrected: by, t, seq, pose."""
    d = ranged_bracket(probes, corrected, [by], "t", "pose", "seq")
    a, b = F.col("v0"), F.col("v1")
    got = F.when(F.col("t0") == F.col("t1"), a).when(a.isNotNull() & b.isNotNull(), _mid(a, b, (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))).otherwise(F.coalesce(a, b))
    return d.select(*probes.columns, got.cast(POSE).alias(name))


def sample_times(spans: DataFrame, keyframes: DataFrame, step: int, by: str = "recording") -> DataFrame:
    """by, t: every `step` from start on, each keyframe's time within the span, and the end; times closer than a microsecond are one. spans: by, start, end. keyframes: by, t."""
    grid = spans.where("start <= end").select(by, F.explode(F.sequence("start", "end", F.lit(step).cast("long"))).alias("t"))
    inside = keyframes.join(spans, by).where(F.col("t").between(F.col("start"), F.col("end"))).select(by, "t")
    return grid.unionByName(inside).unionByName(spans.where("start <= end").select(by, F.col("end").alias("t"))).distinct()


def edge_samples(spans: DataFrame, corrected: DataFrame, rate: float, by: str = "recording") -> DataFrame:
    """by, t, pose of the edge that carries the correction, `rate` (0.1 to 1000) times a second."""
    return correction_at(sample_times(spans, corrected, round(S / min(max(rate, 0.1), 1000.0)), by), corrected, by, "pose")


def report(solved: DataFrame, seen: DataFrame, by: str = "recording") -> DataFrame:
    """by, keyframes, max_shift (how far a keyframe moved at most), markers, spread_raw and spread_corrected of the tags."""
    c = written(corrections(solved, by), "corrections")
    size = lambda p: F.sqrt(F.col(f"{p}.x") ** 2 + F.col(f"{p}.y") ** 2 + F.col(f"{p}.z") ** 2)
    moved = c.groupBy(by).agg(F.count("*").alias("keyframes"), F.max(size("pose.t")).alias("max_shift"))
    placed = seen.where("sensor_tag is not null and raw is not null")
    now = correction_at(placed, c, by).withColumn("now", F.when(F.col("correction").isNotNull(), _times(F.col("correction"), F.col("raw"))))
    spreads = [tag_spread(tag_places(now, pose).select(by, "marker", "t", *"xyz"), [by]).select(by, "markers", F.col("spread").alias(name)) for pose, name in (("raw", "spread_raw"), ("now", "spread_corrected"))]
    return moved.join(spreads[0], by, "left").join(spreads[1].drop("markers"), by, "left")


def keyframes_of(poses: DataFrame, by: str, move: float, turn: float) -> DataFrame:
    """Numbers each recording's poses by cells of path length and turn, and keeps the first of each: a keyframe about every `move` metres or `turn` radians. poses: by, t, seq, pose."""
    w = Window.partitionBy(by).orderBy("t", "seq")
    before = F.lag("pose").over(w)
    step = F.sqrt(sum(((F.col(f"pose.t.{a}") - before["t"][a]) ** 2 for a in "yz"), (F.col("pose.t.x") - before["t"]["x"]) ** 2))
    dot = F.abs(sum((F.col(f"pose.q.{a}") * before["q"][a] for a in "yzw"), F.col("pose.q.x") * before["q"]["x"]))
    angle = 2 * F.acos(F.least(dot, F.lit(1.0)))
    d = poses.withColumn("__way", F.coalesce(step / move, F.lit(0.0)) + F.coalesce(angle / turn, F.lit(0.0)))
    d = d.withColumn("__cell", F.floor(F.sum("__way").over(w)))
    first = Window.partitionBy(by, "__cell").orderBy("t", "seq")
    return d.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(*poses.columns)
