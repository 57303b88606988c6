"""Operators on frames and depth pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import DEFAULTS, Params


def intrinsics(frames: DataFrame, camera: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """fx, fy, cx, cy of each frame, scaled to the depth grid; a frame that lacks one has all four of ``camera`` (a single row)."""
    names = ("fx", "fy", "cx", "cy")
    lacks = F.lit(False)
    for c in names:
        lacks = lacks | F.col(c).isNull() | F.isnan(c)
    one = F.broadcast(camera.select(*[F.col(c).alias(f"camera_{c}") for c in names]).limit(1))
    scale = p.depth_width / p.colour_width
    both = frames.crossJoin(one)
    kept = [F.col(c) for c in frames.columns if c not in names]
    return both.select(*kept, *[(F.when(lacks, F.col(f"camera_{c}")).otherwise(F.col(c)) * scale).alias(c) for c in names])


def stride_sample(frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Every s-th frame of each capture, s = max(5, frames / 1200 rounded half to even)."""
    n = frames.groupBy("capture_id").agg(F.count("*").alias("n"))
    stride = F.greatest(F.lit(p.min_stride), F.bround(F.col("n") / p.target_frames).cast("long"))
    return frames.join(n, "capture_id").where(F.col("frame") % stride == 0).drop("n")


def missing_depth(frames: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Frames without a depth file."""
    return frames.join(files.select(*keys).distinct(), keys, "left_anti")


def wanted(frames: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """Only the frames that are asked for."""
    return frames.join(picks.select(*keys), keys, "left_semi")


def to_world(pixels: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (row, col, depth) with x, y, z in the world, by the pose and intrinsics of their frame."""
    c = F.col
    joined = pixels.join(poses, keys)
    camera = g.back_project(c("row"), c("col"), c("depth"), c("fx"), c("fy"), c("cx"), c("cy"))
    x, y, z = g.rotate(g.quaternion_to_matrix(c("qx"), c("qy"), c("qz"), c("qw")), *camera)
    return joined.select(*[pixels[k] if k not in keys else c(k) for k in pixels.columns], (x + c("px")).alias("x"), (y + c("py")).alias("y"), (z + c("pz")).alias("z"))


def trusted(pixels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pixels of enough confidence, in range, whose four neighbours differ by less than a share of their depth.

    Neighbours count before any filter, so a hole rejects the pixels around it; beyond the border a pixel is its own neighbour.
    """
    d = F.col("depth")
    row, col = Window.partitionBy("frame", "row").orderBy("col"), Window.partitionBy("frame", "col").orderBy("row")
    jumps = [F.abs(F.coalesce(f("depth").over(w), d) - d) for w in (row, col) for f in (F.lag, F.lead)]
    jump = pixels.withColumn("jump", F.greatest(*jumps))
    return jump.where((F.col("conf") >= p.min_confidence) & (d > p.min_depth) & (d < p.max_depth) & (F.col("jump") < p.edge_threshold * d)).drop("jump")


def normals(grid: DataFrame) -> DataFrame:
    """frame, row, col and the unit normal of inner cells of x, y, z grids: right difference x down difference."""
    row, col = Window.partitionBy("frame", "row").orderBy("col"), Window.partitionBy("frame", "col").orderBy("row")
    step = lambda w: [F.lead(c).over(w) - F.lag(c).over(w) for c in "xyz"]
    diff = grid.select("frame", "row", "col", *[s.alias(f"r{i}") for i, s in enumerate(step(row))], *[s.alias(f"d{i}") for i, s in enumerate(step(col))])
    n = g.cross(tuple(F.col(f"r{i}") for i in range(3)), tuple(F.col(f"d{i}") for i in range(3)))
    n = tuple(x for x in n)
    size = F.sqrt(g.dot(n, n))
    out = diff.select("frame", "row", "col", *[c.alias(f"n{a}") for a, c in zip("xyz", n, strict=True)], size.alias("size")).where("size > 0")
    return out.select("frame", "row", "col", *[(F.col(f"n{a}") / F.col("size")).alias(f"n{a}") for a in "xyz"])


def first_greatest(named: list[tuple[str, Column]]) -> Column:
    """The name of the greatest value, the first of equals."""
    best = F.greatest(*[c for _, c in named])
    out = F.lit(named[-1][0])
    for name, c in reversed(named[:-1]):
        out = F.when(c == best, F.lit(name)).otherwise(out)
    return out


def mean_direction(rows: DataFrame, keys: list[str], axis: list[Column]) -> DataFrame:
    """The mean of directions in each group, as a unit vector x, y, z."""
    m = rows.groupBy(*keys).agg(*[F.avg(c).alias(a) for a, c in zip("xyz", axis, strict=True)])
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return m.withColumn("size", size).where("size > 0").select(*keys, *[(F.col(a) / F.col("size")).alias(a) for a in "xyz"])


def chunks(frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Frames with the number of their tumbling window, counted from the capture's first frame."""
    first = F.min("ts").over(Window.partitionBy("capture_id"))
    return frames.withColumn("chunk", F.floor((F.col("ts") - first) / p.chunk_seconds).cast("long"))


def sharpest(frames: DataFrame, windows: int) -> DataFrame:
    """The frame of the greatest score, the first of equals, in each of some equal windows of a capture's frames.

    Window k holds frames from floor(k n / windows) up to the next bound; empty ones give nothing.
    """
    w = Window.partitionBy("capture_id")
    k = F.floor(((F.col("frame") + 1) * windows - 1) / F.count("*").over(w)).cast("long")
    return frames.withColumn("window", k).groupBy("capture_id", "window").agg(F.max_by("frame", F.struct(F.col("score"), -F.col("frame"))).alias("frame"))


def stays(frames: DataFrame, gap: float) -> DataFrame:
    """Frames with the number of their stay in a capture: a new one begins where the time since the last frame is over ``gap``."""
    w = Window.partitionBy("capture_id").orderBy("ts", "frame")
    new = (F.col("ts") - F.lag("ts").over(w) > gap).cast("int")
    return frames.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("stay", F.sum("new").over(w)).drop("new")


def longest_stay(frames: DataFrame, gap: float) -> DataFrame:
    """The stay with most frames of each capture, the first of equals."""
    per = stays(frames, gap).groupBy("capture_id", "stay").agg(F.count("*").alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end"))
    best = per.groupBy("capture_id").agg(F.max_by(F.struct("stay", "n", "begin", "end"), F.struct(F.col("n"), -F.col("stay"))).alias("b"))
    return best.select("capture_id", "b.*")


def crossings(frames: DataFrame) -> DataFrame:
    """Frames whose room differs from the last known one; frames without a room are passed over."""
    w = Window.partitionBy("capture_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    seen = frames.withColumn("before", F.last("room", ignorenulls=True).over(w))
    return seen.where("room is not null and before is not null and room <> before")


def best_crossing(cross: DataFrame, frames: DataFrame, reach: int) -> DataFrame:
    """For each unordered pair of rooms the sharpest frame within ``reach`` frames of any of their crossings (the first of equals)."""
    marks = cross.select("capture_id", F.col("frame").alias("at"), F.least("room", "before").alias("a"), F.greatest("room", "before").alias("b"))
    # frames and crossings meet by stretches of frames, each crossing in all that it reaches
    marks = marks.withColumn("piece", F.explode(F.sequence(F.floor((F.col("at") - reach) / reach), F.floor((F.col("at") + reach - 1) / reach))))
    near = frames.withColumn("piece", F.floor(F.col("frame") / reach)).join(marks, ["capture_id", "piece"]).where((F.col("frame") >= F.col("at") - reach) & (F.col("frame") < F.col("at") + reach))
    return near.groupBy("capture_id", "a", "b").agg(F.max_by("frame", F.struct(F.col("score"), -F.col("frame"))).alias("frame"))


def even_picks(frames: DataFrame, m: int) -> DataFrame:
    """``m`` frames of each capture, evenly from the first to the last; fewer where these coincide."""
    n = F.count("*").over(Window.partitionBy("capture_id"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(m - 1, 1)))
    return frames.withColumn("n", n).where(F.array_contains(F.transform(picks, lambda i: i.cast("long")), F.col("frame").cast("long"))).drop("n")
