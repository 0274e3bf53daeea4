"""Fits over bounded groups; SQL cannot express them, so their tests compare with known geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mapweave.operators import fits as R
from mapweave.operators import temporal as T

from .registry import events, query, vectors


@query()
def robust_session_pose(spark, sf_dir):
    """Per user and 24-hour session of events: value and hour as position, the hour as a turn about z."""
    e = T.gap_sessions(events(spark, sf_dir), ["u"], "t", 24 * 3_600_000_000, ["id"])
    hour = (F.col("t") / 3_600_000_000 % 24).cast("double")
    turn = hour / 24 * np.pi / 4
    zero = F.lit(0.0)
    d = e.select("u", "session", (F.col("v") / 100).alias("x"), (hour / 24).alias("y"), zero.alias("z"), zero.alias("qx"), zero.alias("qy"), F.sin(turn / 2).alias("qz"), F.cos(turn / 2).alias("qw"))
    return R.session_poses(d, ["u", "session"])


@query()
def ransac_plane(spark, sf_dir):
    """Per label a near-level plane through scattered heights."""
    d = vectors(spark, sf_dir).select("label", "x", "y", (0.1 * F.col("x") - 0.05 * F.col("y") + F.col("z") * 0.1).alias("z"))
    return R.planes(d, ["label"], 0.02)


@query()
def icp_pairs(spark, sf_dir):
    """Per label the points against themselves, moved by a known step."""
    v = vectors(spark, sf_dir)
    s = v.select("label", F.lit("s").alias("side"), (F.col("x") + 0.01).alias("x"), (F.col("y") - 0.005).alias("y"), "z")
    return R.icp_groups(s.unionByName(v.select("label", F.lit("t").alias("side"), "x", "y", "z")), ["label"])


@query()
def pose_graph(spark, sf_dir):
    """Per label a chain of all points by id as positions, with drift and one loop back to the start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        true = pdf[["x", "y", "z"]].to_numpy(float)
        eye, info = np.eye(3), np.eye(6)
        drift = np.outer(np.arange(len(true)), [0.01, 0.0, 0.0])
        poses = [(eye, p) for p in true + drift]
        factors = [(i, i + 1, (eye, poses[i + 1][1] - poses[i][1]), info) for i in range(len(true) - 1)]
        if len(true) > 2:
            factors.append((0, len(true) - 1, (eye, true[-1] - true[0]), info * 100))
        out = R.pose_graph(poses, factors)
        return pd.DataFrame({"label": pdf["label"], "id": pdf["id"], **{a: [float(p[1][k]) for p in out] for k, a in enumerate("xyz")}})

    return vectors(spark, sf_dir).groupBy("label").applyInPandas(run, "label int, id long, x double, y double, z double")
