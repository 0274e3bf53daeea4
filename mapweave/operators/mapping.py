"""A voxel map from a recording as one plan: which stream, which world frame, how scans are placed, on which clock, and the voxels that their points fall into.

Choices are made from the index (streams), the frame graph (tens of edges) and counts of scans that a choice places; scans and points stay distributed. Poses are looked up once per scan, at its stamp and at its log time in one pass, and joined to its points.
Every scan counts where the clock is chosen. Times are long microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions import geometry as G
from mapweave.functions.work import written

from .frames import POSE, deskewed, path, placed, poses_at
from .temporal import clock_offset

#: Names of world frames, in order of preference.
WORLDS = ("world", "map", "odom")
#: Words in the name of a cloud stream that holds a map, not scans.
MAP_WORDS = ("map", "accumulated", "aggregated", "voxel")
BODY = "__body"
EVER = 1 << 60


# ---- which streams ----


def map_like(name: Column) -> Column:
    out = F.lit(False)
    for word in MAP_WORDS:
        out = out | F.contains(F.lower(name), F.lit(word))
    return out


def ranked_clouds(streams: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cloud streams with `rank` (1: the one to build from): no map before a map (its name has `map`), a corrected copy before the stream it derives from, the most messages, the name. streams: stream, kind, count, derived_from (the stream that this one corrects, or null)."""
    by = by or []
    clouds = streams.where("kind = 'cloud'")
    sources = clouds.where("derived_from is not null").select(*by, F.col("derived_from").alias("stream"), F.lit(True).alias("has_copy")).distinct()
    d = clouds.join(sources, [*by, "stream"], "left").withColumns({"has_copy": F.coalesce("has_copy", F.lit(False)), "is_map": F.contains(F.col("stream"), F.lit("map"))})
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("is_map", "has_copy", F.desc("count"), "stream")))  # a recording has tens of streams


def lidar_and_imu(streams: DataFrame, by: list[str] | None = None) -> DataFrame:
    """lidar and imu to estimate odometry from: the lidar with the most messages that has an IMU under its topic's prefix, else the lidar with the most and the only IMU there is. No row where there is odometry already, no lidar (scans as recorded, no map), no IMU, or several that fit none. Streams without messages don't count."""
    by = by or []
    live = streams.where("count > 0").withColumns({"prefix": F.when(F.contains(F.col("stream"), F.lit("/")), F.regexp_replace("stream", "/[^/]*$", "")).otherwise(""), "all": F.lit(1)})
    keys = by or ["all"]
    moved = live.where("kind = 'odometry'").select(*keys).distinct()
    lidars = live.where((F.col("kind") == "cloud") & F.col("derived_from").isNull() & ~map_like(F.col("stream"))).join(moved, keys, "left_anti").select(*keys, F.col("stream").alias("lidar"), F.col("count").alias("scans"), "prefix")
    imus = live.where("kind = 'imu'").select(*keys, F.col("stream").alias("imu"), F.col("prefix").alias("imu_prefix"), F.count("*").over(Window.partitionBy(*keys)).alias("imus"))
    pairs = lidars.join(imus, keys).withColumn("apart", F.col("prefix") != F.col("imu_prefix")).where(~F.col("apart") | (F.col("imus") == 1))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("apart", F.desc("scans"), "lidar", "imu")))  # tens of streams
    return best.where("r = 1").select(*by, "lidar", "imu")


# ---- where and when ----


def world_of(known: list[tuple[str, str]], frame: str) -> str:
    """The world frame of clouds in `frame`: that frame itself if it is one, else the first that the frame graph connects it to, else `world`."""
    if frame in WORLDS:
        return frame
    return next((w for w in WORLDS if path(known, w, frame)), "world")


def parent_of(graph: DataFrame, by: list[str] | None = None) -> DataFrame:
    """child, parent, fixed: of several edges into a frame the one with the most samples (then the first name). graph: parent, child, samples, fixed."""
    by = by or []
    first = Window.partitionBy(*by, "child").orderBy(F.desc("samples"), "parent")
    return graph.withColumn("r", F.row_number().over(first)).where("r = 1").select(*by, "child", "parent", "fixed")


def moved_by_tf(graph: DataFrame, frame: str) -> bool:
    """Whether an edge between the frame and its root moves."""
    up = {r["child"]: (r["parent"], r["fixed"]) for r in parent_of(graph).collect()}  # tens of edges
    at = frame.lstrip("/")
    for _ in range(len(up)):
        if at not in up:
            return False
        at, fixed = up[at]
        if not fixed:
            return True
    return False


def heads(scans: DataFrame) -> DataFrame:
    """A row per scan (recorders may leave seq at 0, so the log time tells scans apart): stream, seq, log, stamp, frame, stored."""
    return scans.groupBy("stream", "seq", "log").agg(F.max("stamp").alias("stamp"), F.first("frame", True).alias("frame"), F.first("stored", True).alias("stored"))


def placed_by(scans: DataFrame, tf: DataFrame, world: str, frame: str, offset: int, tolerance: int) -> int:
    """How many stamped scans the tree places at their stamps moved by `offset`."""
    at = scans.where("stamp > 0").select((F.col("stamp") + offset).alias("t"))
    return at.join(poses_at(at, tf, world, frame, tolerance), "t", "left_semi").count()


def clock_choice(scans: DataFrame, tf: DataFrame, world: str, frame: str, tolerance: int) -> tuple[int, int, int, int]:
    """The stamps' offset to the log clock, how many scans the tree places without and with it, and what is chosen: 0, or the offset where it places strictly more scans."""
    shift = clock_offset(scans, "stamp", "log").first()["offset"]
    as_is = placed_by(scans, tf, world, frame, 0, tolerance)
    moved = placed_by(scans, tf, world, frame, shift, tolerance) if shift else as_is
    return shift, as_is, moved, shift if moved > as_is else 0


def stamp_offset(scans: DataFrame, tf: DataFrame, world: str, frame: str, tolerance: int) -> int:
    """What stamps are moved by before they are looked up (`clock_choice`)."""
    return clock_choice(scans, tf, world, frame, tolerance)[3]


def timed_poses(scans: DataFrame, tf: DataFrame, world: str, frame: str, offset: int, tolerance: int, name: str) -> DataFrame:
    """Adds the pose of `frame` in `world` at each scan's stamp (moved by offset), else at its log time, else null. Both are looked up in one pass."""
    s = scans.withColumn("__stamp", F.when(F.col("stamp") > 0, F.col("stamp") + offset))
    times = s.select(F.col("__stamp").alias("t")).unionByName(s.select(F.col("log").alias("t")))
    at = written(poses_at(times, tf, world, frame, tolerance), "scan-poses")
    d = s.join(at.select(F.col("t").alias("__stamp"), F.col("pose").alias("__a")), "__stamp", "left").join(at.select(F.col("t").alias("log"), F.col("pose").alias("__b")), "log", "left")
    return d.select(*scans.columns, F.coalesce("__a", "__b").alias(name))


@dataclass
class Placement:
    """How scans are placed: kind (tf, world, stored or mounted), the world frame, the frame that is looked up, the stamps' offset, and notes for people."""

    kind: str
    world: str
    frame: str
    offset: int = 0
    notes: list[str] = field(default_factory=list)


def placement(scans: DataFrame, tf: DataFrame, trajectory: DataFrame, world: str = "", sensor: str = "", tolerance: int = 100_000) -> Placement:
    """Decided from the first scan's frame, the frame graph and what is there. scans: heads. tf: parent, child, t, seq, pose. trajectory: t, seq, pose, perhaps empty."""
    first = scans.orderBy("log", "seq").first()
    if first is None:
        raise ValueError("there are no scans")
    frame = (first["frame"] or "").lstrip("/")
    known = [(r["parent"], r["child"]) for r in tf.select("parent", "child").distinct().collect()]  # the frame graph: tens of edges
    world, sensor = world or world_of(known, frame), sensor.lstrip("/")
    offset = stamp_offset(scans, tf, world, frame, tolerance)
    notes = [f"stamps are {offset / 1e6:+.1f} s off the log clock, on which tf places more scans: moved onto it"] if offset else []
    if sensor and sensor != frame:
        if path(known, world, sensor) is None or path(known, frame, sensor) is None:
            raise ValueError(f"tf does not connect {sensor} to {world} and {frame}")
        return Placement("mounted", world, sensor, offset, [*notes, f"clouds in {frame} moved back into {sensor}, placed in {world} by tf"])
    if frame in (world, ""):
        return Placement("world", world, frame, offset, [*notes, f"clouds are in {world} already" + ("" if not trajectory.isEmpty() else ", and nothing says where they were taken")])
    if path(known, world, frame) is not None:
        return Placement("tf", world, frame, offset, [*notes, f"clouds in {frame} placed in {world} by tf"])
    if first["stored"] is not None:
        return Placement("stored", world, frame, offset, [*notes, f"no way from {frame} to {world}: poses stored with the scans"])
    raise ValueError(f"clouds in {frame} cannot be placed: no way to {world}, no stored poses")


def sensor_poses(scans: DataFrame, how: Placement, tf: DataFrame, trajectory: DataFrame, tolerance: int = 100_000) -> DataFrame:
    """Adds to each scan `sensor`, its pose in the world (null: it cannot be placed), and `cloud`, the pose in the world of the frame that its points are in (null in scans in `sensor`'s own frame: that one).

    tf: stamp, else log time, else the stored pose. world: stored, else the trajectory at the log time, else the identity; points are in the world already. stored: that. mounted: the sensor by tf alone, its points' frame by tf too."""
    none, identity = F.lit(None).cast(POSE), F.expr("named_struct('t', named_struct('x', 0D, 'y', 0D, 'z', 0D), 'q', named_struct('x', 0D, 'y', 0D, 'z', 0D, 'w', 1D))").cast(POSE)
    if how.kind == "stored":
        return scans.withColumns({"sensor": F.col("stored"), "cloud": none})
    if how.kind == "world":
        own = trajectory.select(F.lit(how.world).alias("parent"), F.lit(BODY).alias("child"), "t", "seq", "pose")
        at = poses_at(scans.select(F.col("log").alias("t")), own, how.world, BODY, tolerance, [(how.world, BODY)])
        d = scans.join(at.select(F.col("t").alias("log"), F.col("pose").alias("__at")), "log", "left")
        return d.select(*scans.columns, F.coalesce("stored", "__at", identity).alias("sensor"), identity.alias("cloud"))
    if how.kind == "mounted":
        d = timed_poses(scans, tf, how.world, how.frame, how.offset, tolerance, "sensor")
        frames_ = [r["frame"] for r in scans.select("frame").distinct().collect()]  # tens of frames
        parts = [timed_poses(d.where(F.col("frame") == f), tf, how.world, f, how.offset, tolerance, "cloud") for f in frames_]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    d = timed_poses(scans, tf, how.world, how.frame, how.offset, tolerance, "__tf")
    return d.select(*scans.columns, F.coalesce("__tf", "stored").alias("sensor"), none.alias("cloud"))


def every_nth_scan(scans: DataFrame, n: int) -> DataFrame:
    """Every n-th scan of a stream by (log, seq), the first among them; their numbers are a recording's scans."""
    if n <= 1:
        return scans
    nth = F.row_number().over(Window.partitionBy("stream").orderBy("log", "seq")) - 1
    return scans.withColumn("__n", nth).where(F.col("__n") % n == 0).drop("__n")


def world_points(points: DataFrame, poses: DataFrame, most: float | None = None) -> DataFrame:
    """Points of placed scans moved into the world, at most `most` from their sensor: the columns of points, x, y, z in the world. poses: stream, seq, log, sensor, cloud."""
    p = poses.where("sensor is not null").select("stream", "seq", "log", F.coalesce("cloud", "sensor").alias("__pose"), F.col("sensor.t").alias("__at"))
    d = placed(points.join(p, ["stream", "seq", "log"]), "__pose")
    if most is not None:
        gap = sum(((F.col(a) - F.col(f"__at.{a}")) * (F.col(a) - F.col(f"__at.{a}")) for a in "yz"), (F.col("x") - F.col("__at.x")) * (F.col("x") - F.col("__at.x")))
        d = d.where(F.sqrt(gap) <= most)
    return d.select(*points.columns)


def deskewed_scans(points: DataFrame, motion: DataFrame, offset: int, tolerance: int = 100_000) -> DataFrame:
    """The points of scans that carry their own times, each moved along the sensor's motion to its scan's end, in the frame that it has there; points of scans without times stay as they are. points: as `recordings.scans` gives them. motion: t, seq, pose of the sensor. offset: added to stamps."""
    scan = ["stream", "seq", "log"]
    timed = points.where(F.col("offset").isNotNull() & (F.col("stamp") > 0)).withColumn("t", F.col("stamp") + offset + F.floor(F.col("offset") / 1000))
    ends = timed.groupBy(*scan).agg(F.max("t").alias("end"))
    moved = deskewed(timed.join(ends, scan).select(*points.columns, "t", "end"), motion, tolerance)
    return moved.select(*points.columns).unionByName(points.where(F.col("offset").isNull() | (F.col("stamp") <= 0)))


@dataclass
class Map:
    """stream, placement, scans (with sensor poses), voxels (kx, ky, kz, n, x, y, z: centers)."""

    stream: str
    how: Placement
    scans: DataFrame
    voxels: DataFrame


def build(streams: DataFrame, scans: DataFrame, tf: DataFrame, trajectory: DataFrame, voxel: float, stream: str = "", world: str = "", sensor: str = "", most: float | None = 30.0, every: int = 1, tolerance: int = 100_000) -> Map:
    """The map of a recording without ray tracing: every return within `most` of its sensor lands in a voxel and stays.

    streams: stream, kind, count, derived_from. scans: the points of `recordings.scans`. tf: `recordings.edges`. trajectory: `recordings.trajectories`; the first stream by name is used. Scans that cannot be placed are left out and keep a null `sensor` in `Map.scans`."""
    if stream:
        if streams.where((F.col("stream") == stream) & (F.col("kind") == "cloud")).isEmpty():
            raise ValueError(f"no cloud stream named {stream}")
    else:
        best = ranked_clouds(streams).where("rank = 1").first()
        if best is None:
            raise ValueError("the recording has no point clouds")
        stream = best["stream"]
    points = scans.where(F.col("stream") == stream)
    all_heads = written(heads(points), "scans")
    name = trajectory.agg(F.min("stream")).first()[0]
    way = trajectory.where(F.col("stream") == name) if name is not None else trajectory
    how = placement(all_heads, tf, way, world, sensor, tolerance)
    used = written(sensor_poses(every_nth_scan(all_heads, every), how, tf, way, tolerance), "placed-scans")
    p = world_points(points.select("stream", "seq", "log", "x", "y", "z"), used, most)
    keys = {f"k{a}": G.voxel_key(F.col(a), voxel) for a in "xyz"}
    cells = p.select(*[v.alias(k) for k, v in keys.items()]).groupBy(*keys).agg(F.count("*").alias("n"))
    return Map(stream, how, used, cells.select(*keys, "n", *[G.voxel_center(F.col(f"k{a}"), voxel).alias(a) for a in "xyz"]))


