"""Sessions that outlive their process: snapshots of a map, what is removed from it as deltas, its transform and plans.

Tables are written first, under names of their own; a state (one small JSON file that names them) is written last and renamed into place, which fails where another writer was faster. So a crash between files leaves the newest whole state readable, and what
it left behind is never named. A mask counts only for the map that it was made on: it keeps that map's version and number of points.

Defined results: a session that was never saved is a KeyError; masks name indexes, each may name some again; an empty mask removes nothing; indexes that the map does not have are ignored; a null transform is the identity.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.geometry import let, place
from mapweave.functions.work import names_in, put_once, shared_dir, text_of

_POSE = "named_struct('t', named_struct('x', {0}D, 'y', {1}D, 'z', {2}D), 'q', named_struct('x', {3}D, 'y', {4}D, 'z', {5}D, 'w', {6}D))"


class Sessions:
    """Sessions under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/sessions").rstrip("/")

    def states(self, name: str) -> list[int]:
        return sorted(int(n[6:-5]) for n in names_in(self.spark, f"{self.root}/{name}") if n.startswith("state-") and n.endswith(".json"))

    def state(self, name: str) -> dict:
        known = self.states(name)
        if not known:
            raise KeyError(name)
        return {"number": known[-1], **json.loads(text_of(self.spark, f"{self.root}/{name}/state-{known[-1]:08d}.json"))}

    def _put(self, name: str, state: dict, before: int) -> int:
        number = before + 1
        body = json.dumps({k: v for k, v in state.items() if k != "number"}, sort_keys=True)
        if not put_once(self.spark, f"{self.root}/{name}/state-{number:08d}.json", body):
            raise RuntimeError(f"{name} was changed by another writer")
        return number

    def save(self, name: str, points: DataFrame, transform: list[float] | None = None) -> int:
        """A new snapshot (idx, x, y, z and more columns), with nothing removed. transform: x, y, z, qx, qy, qz, qw."""
        before = (self.states(name) or [0])[-1]
        table = f"map-{uuid.uuid4().hex}"
        points.write.parquet(f"{self.root}/{name}/{table}")
        count = self.spark.read.parquet(f"{self.root}/{name}/{table}").count()
        return self._put(name, {"map": table, "count": count, "masks": [], "transform": transform, "plans": {}}, before)

    def remove(self, name: str, gone: DataFrame) -> int:
        """Removes points by idx."""
        s = self.state(name)
        table = f"mask-{uuid.uuid4().hex}"
        gone.select(F.col("idx").cast("long").alias("idx")).where("idx is not null").distinct().write.parquet(f"{self.root}/{name}/{table}")
        return self._put(name, {**s, "masks": [*s["masks"], {"table": table, "map": s["map"], "count": s["count"]}]}, s["number"])

    def undo(self, name: str) -> int:
        """Takes back the last mask."""
        s = self.state(name)
        if not s["masks"]:
            raise ValueError("nothing is removed")
        return self._put(name, {**s, "masks": s["masks"][:-1]}, s["number"])

    def move(self, name: str, transform: list[float] | None) -> int:
        """Sets where the map's frame is; plans were drawn in the old one and go."""
        s = self.state(name)
        if transform is not None and len(transform) != 7:
            raise ValueError("a transform is x, y, z, qx, qy, qz, qw")
        return self._put(name, {**s, "transform": transform, "plans": {}}, s["number"])

    def keep_plan(self, name: str, storey: str, plan: dict) -> int:
        s = self.state(name)
        return self._put(name, {**s, "plans": {**s["plans"], storey: plan}}, s["number"])

    def points(self, name: str, moved: bool = False) -> DataFrame:
        """What is visible; moved: in the frame that the transform leads to."""
        s = self.state(name)
        d = self.spark.read.parquet(f"{self.root}/{name}/{s['map']}")
        masks = [f"{self.root}/{name}/{m['table']}" for m in s["masks"] if (m["map"], m["count"]) == (s["map"], s["count"])]
        if masks:
            d = d.join(self.spark.read.schema("idx long").parquet(*masks), "idx", "left_anti").select(*d.columns)
        if moved and s["transform"]:
            pose = F.expr(_POSE.format(*map(float, s["transform"])))
            at = let(F.struct(pose.alias("m"), F.struct(*[F.col(a).cast("double").alias(a) for a in "xyz"]).alias("p")), lambda r: place(r["m"]["t"], r["m"]["q"], r["p"]))
            d = d.withColumn("__at", at).withColumns({a: F.col(f"__at.{a}") for a in "xyz"}).drop("__at")
        return d
