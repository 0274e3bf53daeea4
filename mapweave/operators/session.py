"""An editing session over a voxel map: cleanup selections, an append-only edit log with undo and redo, annotations, names.

Voxels stay a DataFrame (idx, x, y, z, nx, ny, nz); a selection is a DataFrame of idx. Edits append (edit, idx, action) rows; visibility replays
the log up to the cursor, so nothing is changed in place and several sessions can share one map.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.geometry import in_box, in_view
from mapweave.functions.picks import percentiles

from . import spatial, voxels

#: Undo steps that are kept, and points of a preview.
UNDO, PREVIEW = 500, 200_000
NAME = re.compile(r"^[a-z][a-z0-9_]{0,62}$")


def region(spec: dict | str | None, view: list[float] | None = None) -> Column:
    """None or "all"; "view" for the reported camera matrix; or a box with center, size and yaw."""
    if spec in (None, "all"):
        return F.lit(True)
    xyz = [F.col(c) for c in "xyz"]
    if spec == "view":
        if view is None:
            raise ValueError("no view was reported")
        return in_view(*xyz, view)
    return in_box(*xyz, tuple(spec["center"]), tuple(spec["size"]), spec.get("yaw", 0.0))


def select(points: DataFrame, op: str, spec: dict | str | None = None, view: list[float] | None = None, levels: list[float] = (), voxel: float = 0.05, **options) -> DataFrame:
    """idx of the voxels that a cleanup operation removes."""
    inside = region(spec, view)
    if op in ("cropOutside", "deleteInside") and not isinstance(spec, dict):
        raise ValueError(f"{op} needs a box")
    named = points.withColumnRenamed("idx", "id")
    if op == "cropOutside":
        return points.where(~inside).select("idx")
    if op == "deleteInside":
        return points.where(inside).select("idx")
    if op == "cropHeight":
        return points.where(~F.col("z").between(options["low"], options["high"])).select("idx")
    if op == "floating":
        found = spatial.floating(named, voxel, options.get("least", 30)).select(F.col("id").alias("idx"))
    elif op == "outliers":
        found = spatial.outliers(named, options.get("k", 20), options.get("sigmas", 2.0), options.get("radius", 4 * voxel)).select(F.col("id").alias("idx"))
    elif op == "floor":
        found = voxels.floor_points(points, levels, options.get("thickness", 1.6 * voxel)).select("idx")
    elif op == "walls":
        found = voxels.wall_points(points, levels, options.get("least", 0.3)).select("idx")
    elif op == "keepWalls":
        walls = voxels.wall_points(points, levels, options.get("least", 0.3)).select("idx")
        found = points.select("idx").join(walls, "idx", "left_anti")
    else:
        raise ValueError(f"unknown operation {op}")
    return points.where(inside).select("idx").join(found, "idx", "left_semi")


def preview(points: DataFrame, selection: DataFrame) -> DataFrame:
    return points.join(selection, "idx", "left_semi").select("x", "y", "z").limit(PREVIEW)


def visible(points: DataFrame, log: DataFrame, cursor: int | tuple[int, ...]) -> DataFrame:
    """Voxels whose last action among the edits that count is not a removal. cursor: those edits (`History.cursor`), or the last of them where none was undone. log: edit, idx, action ('remove' or 'add'); voxels that only other edits added are invisible."""
    counts = F.col("edit") <= cursor if isinstance(cursor, int) else F.col("edit").isin([*cursor])
    last = log.where(counts).groupBy("idx").agg(F.max(F.struct("edit", "action")).alias("v")).select("idx", F.col("v.action").alias("__a"))
    later = log.where(~counts & (F.col("action") == "add")).select("idx").distinct()
    d = points.join(last, "idx", "left").where("__a is null or __a = 'add'").drop("__a")
    return d.join(later.join(last.where("__a is not null").select("idx"), "idx", "left_anti"), "idx", "left_anti")


def erased_again(points: DataFrame, erased_keys: DataFrame, voxel: float) -> DataFrame:
    """idx of voxels of a rebuilt map that lie where voxels were erased before. erased_keys: kx, ky, kz."""
    return voxels.keyed(points, voxel).join(erased_keys.distinct(), voxels.KEYS, "left_semi").select("idx")


@dataclass
class History:
    """Which edits count, with an undo limit. An edit that was undone never counts again once another is recorded, though its rows stay in the log."""

    edits: list[int] = field(default_factory=list)
    undone: list[int] = field(default_factory=list)
    next: int = 1

    def record(self) -> int:
        self.edits.append(self.next)
        self.undone.clear()
        self.next += 1
        return self.edits[-1]

    def undo(self) -> int | None:
        if not self.edits or len(self.undone) >= UNDO:
            return None
        self.undone.append(self.edits.pop())
        return self.undone[-1]

    def redo(self) -> int | None:
        if not self.undone:
            return None
        self.edits.append(self.undone.pop())
        return self.edits[-1]

    @property
    def cursor(self) -> tuple[int, ...]:
        return tuple(self.edits)


@dataclass
class Annotations:
    """Annotations by kind; ids are kept over updates, place names are unique."""

    items: dict[str, dict] = field(default_factory=dict)
    made: int = 0

    def add(self, kind: str, **values) -> str:
        self.made += 1
        ident = f"{kind}-{self.made}"
        self.items[ident] = {"id": ident, "kind": kind, **values}
        if "name" in values:
            self.items[ident]["name"] = self.unique(values["name"], ident)
        return ident

    def unique(self, name: str, but: str | None = None) -> str:
        taken = {a.get("name") for i, a in self.items.items() if i != but}
        n, out = 1, name
        while out in taken:
            n += 1
            out = f"{name} {n}"
        return out

    def update(self, ident: str, patch: dict) -> dict:
        """Deep merge; a null takes a field away; id and kind stay."""
        new = merged(self.items[ident], {k: v for k, v in patch.items() if k not in ("id", "kind")})
        if "name" in patch and patch["name"] is not None:
            new["name"] = self.unique(patch["name"], ident)
        self.items[ident] = new
        return new

    def remove(self, ident: str) -> None:
        del self.items[ident]


def merged(base: dict, patch: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        else:
            out[k] = copy.deepcopy(v)
    return out


def checked_name(name: str, taken: set[str] = frozenset()) -> str:
    if not NAME.match(name):
        raise ValueError("a name is lower-case letters, digits and underscores, a letter first")
    if name in taken:
        raise ValueError(f"{name} is taken")
    return name


def box_of(points: DataFrame, levels: list[float], voxel_cell: float = 0.12, least: int = 4) -> dict | None:
    """A box around the piece nearest to the region's middle: floors left out, turned to the main axis only if that footprint is over a tenth smaller, trimmed at 2 and 98 percent (0 and 98 in z)."""
    import math

    body = points.join(voxels.floor_points(points, levels, 0.08).select("idx"), "idx", "left_anti") if levels else points
    body = spatial.checkpointed(body.select(F.col("idx").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    mid = body.agg(F.count("*").alias("n"), *[((F.min(c) + F.max(c)) / 2).alias(c) for c in "xy"]).first()
    if mid["n"] < least:
        return None
    labels, keyed = spatial.cell_components(body, voxel_cell)
    pieces = keyed.join(labels, ["cx", "cy", "cz"])
    away = F.sqrt((F.col("x") - mid["x"]) ** 2 + (F.col("y") - mid["y"]) ** 2)
    best = pieces.groupBy("label").agg(F.count("*").alias("n"), F.min(away).alias("d")).where(F.col("n") >= least).orderBy("d", F.desc("n"), "label").limit(1)
    piece = spatial.checkpointed(pieces.join(best.select("label"), "label", "left_semi") if not best.isEmpty() else pieces)
    cov = spatial.covariance(piece.withColumn("all", F.lit(1)), ["all"], "xy").first()
    turned = 0.5 * math.atan2(2 * cov["sxy"], cov["sxx"] - cov["syy"])

    def extent(yaw: float) -> dict:
        c, s = math.cos(yaw), math.sin(yaw)
        d = piece.select(F.lit(1).alias("all"), (F.col("x") * c + F.col("y") * s).alias("u"), (F.col("y") * c - F.col("x") * s).alias("v"), "z")
        at = {a: percentiles(d, ["all"], a, {"low": 0.0 if a == "z" else 0.02, "high": 0.98}).first() for a in "uvz"}
        return {a: (r["low"], r["high"]) for a, r in at.items()}

    plain, other = extent(0.0), extent(turned)
    area = lambda e: (e["u"][1] - e["u"][0]) * (e["v"][1] - e["v"][0])
    yaw, e = (turned, other) if area(other) < 0.9 * area(plain) else (0.0, plain)
    u, v, z = ((e[a][0] + e[a][1]) / 2 for a in "uvz")
    return {"center": [u * math.cos(yaw) - v * math.sin(yaw), u * math.sin(yaw) + v * math.cos(yaw), z], "size": [max(0.05, e[a][1] - e[a][0]) for a in "uvz"], "yaw": yaw}


def objects(points: DataFrame, level: float, top: float, voxel: float = 0.05, least: int = 25, most: int = 60) -> DataFrame:
    """Pieces that stand on a storey: 8-neighbour components of columns between 0.06 m and 2 m over the floor, at least `least` voxels, long high walls left out, biggest first."""
    cell = max(2 * voxel, 0.08)
    body = points.where((F.col("z") > level + 0.06) & (F.col("z") < min(level + 2.0, top)) & (F.abs("nz") <= 1)).select(F.col("idx").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    labels, keyed = spatial.cell_components(body, cell, "xy")
    d = keyed.join(labels, ["cx", "cy"])
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    g = d.groupBy("label").agg(F.count("*").alias("voxels"), *ends)
    run = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    g = g.where((F.col("voxels") >= least) & ~((run > 4.0) & (F.col("max_z") - F.col("min_z") > 1.2)))
    return g.orderBy(F.desc("voxels"), "min_x", "min_y").limit(most).drop("label")


def leveling(points: DataFrame, level: float) -> dict:
    """The turn that brings the lowest floor's mean normal upright, and the lift that puts the floor at 0."""
    import math

    near = points.where((F.col("nz") > 0.85) & (F.abs(F.col("z") - level) <= 0.15))
    m = near.agg(*[F.avg(c).alias(c) for c in ("nx", "ny", "nz", "z")]).first()
    if m["nz"] is None:
        raise ValueError("no floor to level by")
    n = math.sqrt(m["nx"] ** 2 + m["ny"] ** 2 + m["nz"] ** 2)
    x, y, z = m["nx"] / n, m["ny"] / n, m["nz"] / n
    w = math.sqrt((1 + z) / 2)
    return {"q": [y / (2 * w), -x / (2 * w), 0.0, w], "lift": -m["z"]}


def resting_z(points: DataFrame, x: float, y: float, voxel: float, under: float | None = None) -> float | None:
    """The highest layer with at least three up-facing voxels within one and a half voxels of (x, y)."""
    d = points.where((F.col("nz") > 0.8) & (F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2) <= 1.5 * voxel))
    if under is not None:
        d = d.where(F.col("z") <= under)
    r = d.groupBy(F.floor(F.col("z") / voxel).alias("layer")).agg(F.count("*").alias("n"), F.avg("z").alias("z")).where("n >= 3").orderBy(F.desc("layer")).first()
    return r["z"] if r else None
