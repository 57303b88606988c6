"""Checks of reconstructed cameras, pieces and rooms against a capture whose truth is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .motion import similarity

C = F.col
POSE = ("px", "py", "pz", "qx", "qy", "qz", "qw")
#: Cameras that a similarity needs.
LEAST = 3


def _vector(prefix: str) -> tuple:
    return tuple(C(f"{prefix}{c}") for c in "xyz")


def _quaternion(prefix: str) -> tuple:
    return tuple(C(f"{prefix}{c}") for c in "xyzw")


def fitted(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """Cameras with the similarity that takes their centres best onto the true ones (scale, r00 to r22, tx, ty, tz), and their centres moved by it (ax, ay, az).

    ``cameras`` have frame, px to qw (camera to the reconstruction's frame and units) and the true ones tpx to tqw. Groups of fewer than three have no similarity and are left out.
    """
    pairs = cameras.select(*keys, *[C(f"p{c}").alias(c) for c in "xyz"], *[C(f"tp{c}").alias(c * 2) for c in "xyz"])
    fit = similarity(pairs, keys).where(C("n") >= LEAST).drop("n")
    j = cameras.join(fit, keys)
    m = {f"r{i}{k}": C(f"r{i}{k}") for i in range(3) for k in range(3)}
    moved = g.rotate(m, *_vector("p"))
    return j.select("*", *[(C("scale") * x + C(f"t{c}")).alias(f"a{c}") for c, x in zip("xyz", moved, strict=True)])


def camera_check(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """How far reconstructed cameras are from the true ones: keys, cameras, path, rms, worst, percent, scale, view_mean, view_worst, turn_mean, turn_worst.

    After the best similarity: distances of the centres, in metres and percent of the true path; degrees between viewing directions; and degrees by which
    the turn from one camera to the next differs from the true one, which needs no similarity.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    m = {f"r{i}{k}": C(f"r{i}{k}") for i in range(3) for k in range(3)}
    named = lambda prefix, parts: {f"{prefix}{c}": x for c, x in zip("xyzw", parts, strict=False)}
    looks = lambda q: tuple(2 * x for x in (q[0] * q[2] + q[1] * q[3], q[1] * q[2] - q[0] * q[3])) + (1 - 2 * (q[0] * q[0] + q[1] * q[1]),)  # noqa: E731  where z goes
    # a column a step: what is used several times is worked out once
    j = fitted(cameras, keys)
    for n in ("q", "tq"):
        q = _quaternion(n)
        size = F.sqrt(g.dot(q, q))
        j = j.withColumn("__size", F.when(size > 0, size)).withColumns(named(f"__{n}", [x / C("__size") for x in q]))
    q, tq = (tuple(C(f"__{n}{c}") for c in "xyzw") for n in ("q", "tq"))
    j = j.withColumns({**named("__look", looks(q)), **named("__true", looks(tq))})
    look, true = (tuple(C(f"__{n}{c}") for c in "xyz") for n in ("look", "true"))
    j = j.withColumns(named("__view", g.rotate(m, *look)))
    view = tuple(C(f"__view{c}") for c in "xyz")
    j = j.withColumns(named("__apart", g.cross(view, true)))
    apart = tuple(C(f"__apart{c}") for c in "xyz")
    angle = F.degrees(F.atan2(F.sqrt(g.dot(apart, apart)), g.dot(view, true)))  # exact for small angles too
    gap = tuple(C(f"a{c}") - C(f"tp{c}") for c in "xyz")
    # turns from the camera before, and the difference of both
    for n in ("q", "tq"):
        before = {f"__b{n}{c}": F.lag(f"__{n}{c}").over(w) for c in "xyzw"}
        j = j.withColumns(before)
        b = tuple(C(f"__b{n}{c}") for c in "xyzw")
        j = j.withColumns(named(f"__r{n}", g.quaternion_product((-b[0], -b[1], -b[2], b[3]), tuple(C(f"__{n}{c}") for c in "xyzw"))))
    j = j.withColumns({f"__s{c}": C(f"tp{c}") - F.lag(f"tp{c}").over(w) for c in "xyz"})
    step = tuple(C(f"__s{c}") for c in "xyz")
    turn = g.turn_between(tuple(C(f"__rtq{c}") for c in "xyzw"), tuple(C(f"__rq{c}") for c in "xyzw"))
    rows = j.select(*keys, "scale", F.sqrt(g.dot(gap, gap)).alias("gap"), F.sqrt(g.dot(step, step)).alias("step"), angle.alias("view"), turn.alias("turn"))
    rms = F.sqrt(F.avg(C("gap") * C("gap")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("cameras"), F.sum("step").alias("path"), rms.alias("rms"), F.max("gap").alias("worst"), (100 * rms / F.sum("step")).alias("percent"), F.first("scale").alias("scale"),
        F.avg("view").alias("view_mean"), F.max("view").alias("view_worst"), F.avg("turn").alias("turn_mean"), F.max("turn").alias("turn_worst"),
    )


def piece_check(cameras: DataFrame, scales: DataFrame, ups: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of pieces in size and upright: keys, placed, path, scale_error (a share), up_camera, up_room (degrees), note.

    ``scales`` are the metres that a unit was given, ``ups`` the direction (x, y, z, in the piece's frame) that was taken for up. The true ones follow from the similarity onto the true
    path. Pieces with fewer than three cameras, or without a scale, have a note and no errors.
    """
    j = fitted(cameras, keys)
    w = Window.partitionBy(*keys).orderBy("frame")
    step = tuple(C(f"tp{c}") - F.lag(f"tp{c}").over(w) for c in "xyz")
    placed = cameras.select(*keys, F.sqrt(g.dot(step, step)).alias("step")).groupBy(*keys).agg(F.count("*").alias("placed"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"))
    x, y, z, w_ = _quaternion("q")
    size = x * x + y * y + z * z + w_ * w_
    own = (2 * (z * w_ - x * y), size - 2 * (y * y + w_ * w_), -2 * (y * z + x * w_))  # where -y goes: rows of pictures go down
    one = j.select(*keys, "scale", *[C(f"r1{i}").alias(f"u{c}") for i, c in enumerate("xyz")], *[(v / F.when(size > 0, size)).alias(f"c{c}") for c, v in zip("xyz", own, strict=True)])
    one = one.groupBy(*keys).agg(F.first("scale").alias("true_scale"), *[F.first(f"u{c}").alias(f"u{c}") for c in "xyz"], *[F.avg(f"c{c}").alias(f"c{c}") for c in "xyz"])
    j = placed.join(one, keys, "left").join(scales.select(*keys, C("scale").alias("given")), keys, "left").join(ups.select(*keys, *"xyz"), keys, "left")
    true = _vector("u")  # the similarity's second row: what it takes onto the true up
    sized = C("given").isNotNull() & C("true_scale").isNotNull()
    return j.select(
        *keys, "placed", "path", F.when(sized, C("given") / C("true_scale") - 1).alias("scale_error"), F.when(sized, g.angle(_vector("c"), true)).alias("up_camera"), F.when(sized, g.angle(_vector(""), true)).alias("up_room"),
        F.when(~sized, "too few spots to scale").alias("note"),
    )


def view_check(cameras: DataFrame, ratios: DataFrame, focals: DataFrame, keys: list[str]) -> DataFrame:
    """Reconstructed views against a depth sensor: keys, frames, spread, scaled, depth_vs_path, focal_percent.

    ``ratios`` have frame and ratio (reconstructed over sensed depth, of sure pixels), ``focals`` focal, width (of the picture that it holds for), true_focal, true_width.
    The spread of the frames' median ratios over their mean, the mean error of depths after the common scale, how far the size by depth is from the size by path, and that of the focal length.
    """
    scale = ratios.groupBy(*keys).agg(F.median("ratio").alias("ratio_scale"))
    by_frame = ratios.groupBy(*keys, "frame").agg(F.median("ratio").alias("m")).groupBy(*keys).agg(F.count("*").alias("frames"), (F.stddev_pop("m") / F.avg("m")).alias("spread"))
    errors = ratios.join(scale, keys).groupBy(*keys, "ratio_scale").agg(F.avg(F.abs(C("ratio") / C("ratio_scale") - 1)).alias("scaled"))
    path = fitted(cameras, keys).groupBy(*keys).agg(F.first("scale").alias("path_scale"))
    focal = focals.select(*keys, (100 * (C("focal") * C("true_width") / C("width") / C("true_focal") - 1)).alias("focal_percent"))
    j = errors.join(by_frame, keys).join(path, keys, "left").join(focal, keys, "left")
    return j.select(*keys, "frames", "spread", "scaled", (1 / C("ratio_scale") / C("path_scale") - 1).alias("depth_vs_path"), "focal_percent")


def room_check(rooms: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """The largest room of each photo reconstruction against the true one, by dimension: keys, dimension, value, truth, error, percent.

    Which of its sides is the width is open, so the pairing of width and length with the lesser sum of errors counts. A dimension that isn't measured has no error.
    """
    best = rooms.groupBy(*keys).agg(F.max_by(F.struct("width", "length", "floor_area", "ceiling"), F.struct(C("floor_area"), -C("room_id"))).alias("r"))
    j = best.join(truth.select(*keys, *[C(c).alias(f"true_{c}") for c in ("width", "length", "floor_area", "ceiling")]), keys)
    off = lambda a, b: F.abs(C(f"r.{a}") - C(f"true_{b}"))
    swap = F.coalesce(off("width", "length") + off("length", "width") < off("width", "width") + off("length", "length"), F.lit(False))
    value = {"width": F.when(swap, C("r.length")).otherwise(C("r.width")), "length": F.when(swap, C("r.width")).otherwise(C("r.length")), "floor_area": C("r.floor_area"), "ceiling": C("r.ceiling")}
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value"), C(f"true_{d}").alias("truth")) for d, v in value.items()])).alias("d")
    told = j.select(*keys, rows).select(*keys, "d.*")
    return told.withColumns({"error": C("value") - C("truth"), "percent": 100 * (C("value") - C("truth")) / F.when(C("truth") != 0, C("truth"))})
