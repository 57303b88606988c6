"""Operators on walls: finding them in points, gaps between them, and matching them with rooms and other walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from ..storage import keyed, written
from .raster import cells_of, dealt_charts, in_rooms

C = F.col


def _axes(points: DataFrame) -> DataFrame:
    """Each point twice: across and along for walls of constant x, and of constant z. Further columns stay."""
    a = F.array(F.struct(F.lit("x").alias("axis"), C("x").alias("across"), C("z").alias("along")), F.struct(F.lit("z").alias("axis"), C("z").alias("across"), C("x").alias("along")))
    others = [c for c in points.columns if c not in ("x", "z")]
    return points.select(*others, F.explode(a).alias("a")).select(*others, "a.*")


#: Words of 63 bits in which the height slices of a wall band are held.
WORDS = 2
_SETS = [f"{name}{i}" for name in ("any", "held") for i in range(WORDS)]


def sliced(points: DataFrame, bands: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Points with the height slice that they lie in as a set: clipped to the band (any) and only where it is in it (held); slices is how many there are.

    ``bands`` has low and high of each capture's wall band. A band of more than 126 slices (12.6 m) is refused.
    """
    slices = F.greatest(F.round((C("high") - C("low")) / p.height_cell).cast("int"), F.lit(1))
    slices = F.when(slices <= 63 * WORDS, slices).otherwise(F.raise_error(F.lit("a wall band has more height slices than there are bits for")).cast("int"))
    # slices are told once a capture, not once a point
    told = bands.select("capture_id", "low", slices.alias("slices"))
    s = points.join(keyed(told), "capture_id").withColumn("slice", F.floor((C("y") - C("low")) / p.height_cell).cast("int"))
    bit = lambda n, word: F.when((n >= 63 * word) & (n < 63 * word + 63), F.call_function("shiftleft", F.lit(1).cast("long"), n - 63 * word)).otherwise(F.lit(0).cast("long"))
    clipped = F.greatest(F.lit(0), F.least(C("slices") - 1, C("slice")))
    held = F.when((C("slice") >= 0) & (C("slice") < C("slices")), C("slice")).otherwise(-1)
    words = {**{f"any{i}": bit(clipped, i) for i in range(WORDS)}, **{f"held{i}": bit(held, i) for i in range(WORDS)}}
    return s.withColumns(words).drop("low", "slice", "y")


def columns(band: DataFrame, bands: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Band points by their place in plan: capture_id, x, z, slices, k (points there) and the sets of their slices. Points that stand above each other are one row from here on."""
    s = sliced(band.select("capture_id", "x", "z", "y"), bands, p)
    return s.groupBy("capture_id", "x", "z", "slices").agg(F.count("*").alias("k"), *[F.bit_or(c).alias(c) for c in _SETS])


def near_spikes(band: DataFrame, spikes: DataFrame, reach: float, p: Params = DEFAULTS) -> DataFrame:
    """Band points (or ``columns``) within ``reach`` of a spike, with the spike's axis and strip; a point may be near two.

    Points and spikes meet by strip, each spike in all strips that it reaches, and are checked there.
    """
    n = int(reach / p.strip) + 1
    laid = spikes.select("capture_id", "axis", C("strip").alias("spike"), "centre", F.explode(F.sequence(C("strip") - n, C("strip") + n)).alias("strip"))
    pts = _axes(band).withColumn("strip", F.floor(C("across") / p.strip).cast("long"))
    return pts.join(keyed(laid), ["capture_id", "axis", "strip"]).where(F.abs(C("across") - C("centre")) <= reach).drop("strip")


#: Reach of the points by which a wall's prominence is rated.
WIDE = 0.10


def runs(near: DataFrame, bands: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pieces of wall along each spike: capture_id, axis, spike, run, first, last (cells), height_cover.

    ``bands`` has low and high of each capture's wall band. A cell of 5 cm counts where half of the height slices hold a point; holes of up to six cells are
    bridged; a piece must be long enough, and most of its height slices must be seen somewhere along it.
    """
    s = (sliced(near, bands, p) if "y" in near.columns else near).withColumn("cell", F.floor(C("along") / p.along_cell).cast("long"))
    keys = ["capture_id", "axis", "spike"]
    seen = s.groupBy(*keys, "slices", "cell").agg(*[F.bit_or(c).alias(c) for c in _SETS])
    size = lambda name: sum((F.bit_count(C(f"{name}{i}")) for i in range(WORDS)), F.lit(0))
    w = Window.partitionBy(*keys).orderBy("cell")
    solid = seen.withColumn("at", F.when(size("any") >= p.min_cell_cover * C("slices"), C("cell")))
    before = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("at", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    solid = solid.withColumns({"before": before, "after": after})
    new = C("at").isNotNull() & (C("before").isNull() | (C("cell") - C("before") > p.max_gap_cells + 1))
    piece = solid.withColumn("run", F.sum(new.cast("int")).over(w))
    # thin cells between two of a piece count for its slices
    inside = piece.where(C("at").isNotNull() | (C("after") - C("before") <= p.max_gap_cells + 1))
    cover = inside.groupBy(*keys, "slices", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), *[F.bit_or(f"held{i}").alias(f"held{i}") for i in range(WORDS)])
    cover = cover.withColumn("height_cover", size("held") / C("slices"))
    return cover.where(((C("last") + 1 - C("first")) * p.along_cell >= p.min_length - 1e-9) & (C("height_cover") >= p.min_height_cover)).select(*keys, "run", "first", "last", "height_cover")


def rated_runs(band: DataFrame, spikes: DataFrame, bands: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Runs with position, points and prominence, as ``find_walls`` has them, before those that don't stand out are dropped.

    ``band`` are points or their ``columns``; only these are laid to spikes, written once, and read for each of the three steps.
    """
    wide = written(near_spikes(band if "k" in band.columns else columns(band, bands, p), spikes, WIDE, p), "near")
    near = wide.where(F.abs(C("across") - C("centre")) <= p.wall_reach)
    found = runs(near, bands, p)
    keys = ["capture_id", "axis", "spike"]
    start, end = C("first") * p.along_cell, (C("last") + 1) * p.along_cell
    on = near.join(keyed(found), keys).where((C("along") >= start) & (C("along") <= end))
    own = [*keys, "run", "first", "last", "height_cover"]
    places = on.groupBy(*own, "across").agg(F.sum("k").alias("k"))
    placed = written(places.groupBy(*own).agg(F.percentile("across", 0.5, C("k")).alias("position"), F.sum("k").alias("points")), "placed")
    # all band points along the wall, up to 7 cm from its position, which is up to 3 cm from the spike
    o = C("across") - C("position")
    n = lambda when: F.sum(F.when(when, C("k")).otherwise(0))
    sides = F.greatest(n((o >= -0.07) & (o <= -0.04)) / 3, n((o >= 0.04) & (o <= 0.07)) / 3, F.lit(1.0))
    along = wide.join(keyed(placed.drop("k")), keys).where((C("along") >= start) & (C("along") <= end))
    return along.groupBy(*keys, "run", "first", "last", "height_cover", "position", "points").agg((n(F.abs(o) <= 0.02) / 4 / sides).alias("prominence"))


def find_walls(band: DataFrame, spikes: DataFrame, bands: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Walls of each capture, numbered by axis, spike and run: wall_idx, axis, position, start, end, length, points, height_cover, prominence.

    Position is the median of the points within 3 cm of the spike along the run. Prominence compares the density within 2 cm of the position with that
    of the bands 4 to 7 cm off; walls that don't stand out are dropped.
    """
    rated = rated_runs(band, spikes, bands, p).where(C("prominence") >= p.min_prominence)
    start, end = C("first") * p.along_cell, (C("last") + 1) * p.along_cell
    order = Window.partitionBy("capture_id").orderBy("axis", "spike", "run")
    return rated.select(
        "capture_id", (F.row_number().over(order) - 1).cast("int").alias("wall_idx"), "axis", F.round("position", 4).alias("position"), F.round(start, 3).alias("start"), F.round(end, 3).alias("end"),
        F.round(end - start, 3).alias("length"), "points", F.round("height_cover", 2).alias("height_cover"), F.round("prominence", 1).alias("prominence"),
    )


def find_gaps(walls: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """From each wall end the nearest wall ahead, up to 1.2 m: capture_id, ax, az, bx, bz, width, kind ('door' from 0.6 m, else 'wall').

    Ahead is a wall of the same axis in line (within 15 cm), or one across whose span takes in the end (within 15 cm). The first of equally near
    walls counts, and of gaps between the same two points (to 10 cm) the first. A capture's walls are few; they meet by capture.
    """
    ends = walls.select("capture_id", C("wall_idx").alias("u"), "axis", "position", F.explode(F.array(F.struct(C("end").alias("at"), F.lit(1).alias("way")), F.struct(C("start").alias("at"), F.lit(-1).alias("way")))).alias("e")).select("capture_id", "u", "axis", "position", "e.*")
    v = walls.select("capture_id", C("wall_idx").alias("v"), C("axis").alias("v_axis"), C("position").alias("v_position"), C("start").alias("v_start"), C("end").alias("v_end"))
    j = ends.join(keyed(v), "capture_id").where("u <> v")
    near = F.when(C("way") == 1, C("v_start")).otherwise(C("v_end"))
    same = (C("axis") == C("v_axis")) & (F.abs(C("position") - C("v_position")) <= p.align_tolerance)
    across = (C("axis") != C("v_axis")) & (C("position") >= C("v_start") - p.align_tolerance) & (C("position") <= C("v_end") + p.align_tolerance)
    target = F.when(same, near).when(across, C("v_position"))
    j = j.withColumn("target", target).withColumn("width", C("way") * (C("target") - C("at"))).where((C("width") >= 0) & (C("width") <= p.door_max))
    first = Window.partitionBy("capture_id", "u", "way").orderBy("width", "v")
    j = j.withColumn("n", F.row_number().over(first)).where("n = 1")
    along, other = C("at"), C("target")
    both = lambda value, x_wall: F.when(C("axis") == "x", x_wall).otherwise(value)
    g = j.select("capture_id", "u", "way", both(along, C("position")).alias("ax"), both(C("position"), along).alias("az"), both(other, C("position")).alias("bx"), both(C("position"), other).alias("bz"), "width")
    r = lambda c: F.round(C(c) * 10).cast("long")
    a, b = F.struct(r("ax").alias("x"), r("az").alias("z")), F.struct(r("bx").alias("x"), r("bz").alias("z"))
    pair = Window.partitionBy("capture_id", F.least(a, b), F.greatest(a, b)).orderBy("u", F.desc("way"))
    g = g.where("width > 0").withColumn("n", F.row_number().over(pair)).where("n = 1")
    return g.select("capture_id", *[F.round(c, 3).alias(c) for c in ("ax", "az", "bx", "bz", "width")], F.when(C("width") >= p.door_min, "door").otherwise("wall").alias("kind"))


def overlap(a0, a1, b0, b1):
    return F.least(a1, b1) - F.greatest(a0, b0)


def double_walls(walls: DataFrame, low: float = 0.02, high: float = 0.08, share: float = 0.5) -> DataFrame:
    """Pairs of walls of an axis that run side by side a few centimetres apart. They meet by stretches of position."""
    step = high * 2
    a = walls.select("capture_id", "axis", C("wall_idx").alias("i"), C("position").alias("p"), C("start").alias("s"), C("end").alias("e"), F.floor(C("position") / step).alias("piece"))
    b = walls.select("capture_id", "axis", C("wall_idx").alias("j"), C("position").alias("q"), C("start").alias("t"), C("end").alias("f"), F.explode(F.sequence(F.floor((C("position") - high) / step), F.floor((C("position") + high) / step))).alias("piece"))
    d = F.abs(C("p") - C("q"))
    return a.join(b, ["capture_id", "axis", "piece"]).where((C("i") < C("j")) & (d >= low) & (d <= high) & (overlap(C("s"), C("e"), C("t"), C("f")) >= share)).select("capture_id", "axis", "i", "j", d.alias("distance"))


def match_walls(a: DataFrame, b: DataFrame, reach: float = 0.10, share: float = 0.5) -> DataFrame:
    """For each wall of a the nearest of b: same axis, within 10 cm, side by side for half a metre; then the difference less the axis's median."""
    left = a.select("capture_id", "axis", C("wall_idx").alias("i"), C("position").alias("p"), C("start").alias("s"), C("end").alias("e"), F.floor(C("position") / (2 * reach)).alias("piece"))
    right = b.select("capture_id", "axis", C("wall_idx").alias("j"), C("position").alias("q"), C("start").alias("t"), C("end").alias("f"), F.explode(F.sequence(F.floor((C("position") - reach) / (2 * reach)), F.floor((C("position") + reach) / (2 * reach)))).alias("piece"))
    m = left.join(right, ["capture_id", "axis", "piece"]).where((F.abs(C("p") - C("q")) <= reach) & (overlap(C("s"), C("e"), C("t"), C("f")) >= share))
    best = m.groupBy("capture_id", "axis", "i").agg(F.min_by(F.struct("j", (C("q") - C("p")).alias("diff")), F.struct(F.abs(C("q") - C("p")), C("j"))).alias("b")).select("capture_id", "axis", "i", "b.*")
    middle = best.groupBy("capture_id", "axis").agg(F.median("diff").alias("middle"))
    return best.join(middle, ["capture_id", "axis"]).select("capture_id", "axis", "i", "j", (C("diff") - C("middle")).alias("diff"))


def wall_lines(walls: DataFrame, digits: int = 1) -> DataFrame:
    """Distinct lines that walls stand on; walls that two rooms share are one."""
    return walls.select("capture_id", "axis", F.round("position", digits).alias("position")).distinct()


def wall_spread(walls: DataFrame, points: DataFrame, reach: float = 0.05, least: int = 100, min_length: float = 1.0) -> DataFrame:
    """Median over walls of 1 m and more of the spread of their points (those within 5 cm, if there are over ``least``)."""
    w = walls.where(C("length") >= min_length).select("capture_id", "wall_idx", "axis", "position", "start", "end", F.explode(F.sequence(F.floor((C("position") - reach) / reach), F.floor((C("position") + reach) / reach))).alias("piece"))
    # points that stand above each other are one place
    pts = _axes(points.groupBy("capture_id", "x", "z").agg(F.count("*").alias("k"))).withColumn("piece", F.floor(C("across") / reach))
    near = pts.join(keyed(w), ["capture_id", "axis", "piece"]).where((F.abs(C("across") - C("position")) <= reach) & (C("along") >= C("start")) & (C("along") <= C("end")))
    off, n = C("across") - C("position"), F.sum("k")
    mean = F.sum(off * C("k")) / n
    per = near.groupBy("capture_id", "wall_idx").agg(F.sqrt(F.greatest(F.sum(off * off * C("k")) / n - mean * mean, F.lit(0.0))).alias("spread"), n.alias("n")).where(C("n") > least)
    return per.groupBy("capture_id").agg(F.median("spread").alias("wall_spread"), F.count("*").alias("walls"))


def plan_summary(rooms: DataFrame, walls: DataFrame) -> DataFrame:
    w = walls.groupBy("capture_id").agg(F.count("*").alias("walls"), F.sum((C("length") >= 1).cast("int")).alias("long_walls"))
    r = rooms.groupBy("capture_id").agg(F.count("*").alias("rooms"), (F.max("floor_y") - F.min("floor_y")).alias("floor_spread"), F.sum("area").alias("footprint"))
    return r.join(w, "capture_id", "full").join(double_walls(walls).groupBy("capture_id").agg(F.count("*").alias("doubles")), "capture_id", "left").fillna(0, ["doubles", "walls", "rooms", "long_walls"])


def touched_rooms(walls: DataFrame, cells: DataFrame, side: float = 0.12, p: Params = DEFAULTS) -> DataFrame:
    """Rooms on either side of a wall: five points inside it, 12 cm across. Cells are those of the grid that begins at 0."""
    places = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: C("start") + n * (C("end") - C("start")) / 6)
    s = walls.select("capture_id", "wall_idx", "axis", "position", F.explode(places).alias("along"))
    s = s.withColumn("across", F.explode(F.array(C("position") - side, C("position") + side)))
    x, z = F.when(C("axis") == "x", C("across")).otherwise(C("along")), F.when(C("axis") == "x", C("along")).otherwise(C("across"))
    at = s.select("capture_id", "wall_idx", F.floor(z / p.grid).cast("int").alias("row"), F.floor(x / p.grid).cast("int").alias("col"))
    return in_rooms(at, dealt_charts(cells)).select("capture_id", "wall_idx", "room_id").distinct()


def door_rooms(gaps: DataFrame, cells: DataFrame, side: float = 0.12, p: Params = DEFAULTS) -> DataFrame:
    """Doors with the sorted rooms 12 cm to either side of their middle."""
    mx, mz = (C("ax") + C("bx")) / 2, (C("az") + C("bz")) / 2
    dx, dz = C("bx") - C("ax"), C("bz") - C("az")
    size = F.sqrt(dx * dx + dz * dz)
    d = gaps.where("kind = 'door' and width > 0").withColumn("s", F.explode(F.array(F.lit(-side), F.lit(side))))
    at = d.select("capture_id", "gap_idx", F.floor((mz + C("s") * dx / size) / p.grid).cast("int").alias("row"), F.floor((mx - C("s") * dz / size) / p.grid).cast("int").alias("col"))
    return in_rooms(at, dealt_charts(cells), "left").groupBy("capture_id", "gap_idx").agg(F.sort_array(F.collect_set("room_id")).alias("rooms"))


def adjacency(doors: DataFrame) -> DataFrame:
    """Edges a, b between the rooms of doors that have exactly two."""
    return doors.where(F.size("rooms") == 2).select("capture_id", F.get("rooms", F.lit(0)).alias("a"), F.get("rooms", F.lit(1)).alias("b"), C("gap_idx").alias("via"))


def surviving_openings(openings: DataFrame, renamed: DataFrame) -> DataFrame:
    """Openings of which any room is left, with the rooms' new ids."""
    e = openings.select("capture_id", "gap_idx", F.explode("rooms").alias("room_id")).join(renamed, ["capture_id", "room_id"])
    return e.groupBy("capture_id", "gap_idx").agg(F.sort_array(F.collect_set("new_id")).alias("rooms"))


def bounding_walls(walls: DataFrame, cells: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Walls that bound rooms: capture_id, room_id, wall_idx, axis, side ('low' or 'high'), position, points, overlap; the longest of each side, of equals the later wall.

    A wall is walked in steps of one cell over the stretch that it shares with the room's extent; a step touches the room on a side if one of the points 5, 10 and
    15 cm across is in it. It bounds the room where half of these steps or more touch on one side only, and at most a tenth of the room's
    cells lies more than 15 cm beyond it.
    """
    charts, cells = cells, cells_of(cells)
    extent = cells.groupBy("capture_id", "room_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("low", F.min), ("high", F.max))])
    by_row = C("axis") == "x"  # a wall of constant x runs along the rows
    low, high = (F.when(by_row, C(f"{n}_row")).otherwise(C(f"{n}_col")) for n in ("low", "high"))
    pairs = walls.select("capture_id", "wall_idx", "axis", "position", "points", "start", "end").join(keyed(extent), "capture_id")
    pairs = pairs.withColumn("lo", F.greatest(C("start"), low * p.grid)).withColumn("hi", F.least(C("end"), (high + 1) * p.grid)).where(C("hi") - C("lo") >= p.along_cell - 1e-9)
    # steps stand half a cell after the stretch begins
    count = F.greatest(F.ceil((C("hi") - C("lo") - p.along_cell / 2) / p.along_cell - 1e-9).cast("int"), F.lit(1))
    keys = ["capture_id", "room_id", "wall_idx", "axis", "position", "points"]
    pairs = pairs.select(*keys, "lo", count.alias("steps"))
    s = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), C("steps") - 1))).withColumn("i", F.explode(F.array(*[F.lit(i) for i in (-3, -2, -1, 1, 2, 3)])))
    along = F.floor((C("lo") + (C("k") + 0.5) * p.along_cell) / p.grid).cast("int")
    across = F.floor((C("position") + C("i") * p.grid) / p.grid).cast("int")
    s = s.select(*[C(c).alias("own") if c == "room_id" else C(c) for c in keys], "steps", "k", (C("i") > 0).alias("above"), F.when(by_row, along).otherwise(across).alias("row"), F.when(by_row, across).otherwise(along).alias("col"))
    steps = in_rooms(s, dealt_charts(charts)).where("own = room_id").groupBy(*keys, "steps", "k").agg(F.bool_or("above").alias("up"), F.bool_or(~C("above")).alias("down"))
    # the wall is the room's low side if the room is above it
    sides = steps.groupBy(*keys, "steps").agg(F.sum((C("up") & ~C("down")).cast("int")).alias("low"), F.sum((C("down") & ~C("up")).cast("int")).alias("high"))
    side = F.when(C("low") >= p.min_side_overlap * C("steps"), "low").when(C("high") >= p.min_side_overlap * C("steps"), "high")
    sides = sides.withColumn("side", side).where("side is not null")
    # a room's cells are counted by the lines that they stand on, across each axis
    lines = [cells.groupBy("capture_id", "room_id", F.lit(a).alias("axis"), C(c).alias("line")).agg(F.count("*").alias("n")) for a, c in (("x", "col"), ("z", "row"))]
    centre = (C("line") + 0.5) * p.grid
    beyond = F.when(C("side") == "low", centre < C("position") - p.side_reach).otherwise(centre > C("position") + p.side_reach)
    share = F.sum(F.when(beyond, C("n")).otherwise(0)) / F.sum("n")
    ok = keyed(sides).join(lines[0].unionByName(lines[1]), ["capture_id", "room_id", "axis"]).groupBy(*keys, "side", "low", "high").agg(share.alias("beyond")).where(C("beyond") <= p.max_beyond)
    length = F.when(C("side") == "low", C("low")).otherwise(C("high")) * p.along_cell
    best = ok.withColumn("overlap", length).groupBy("capture_id", "room_id", "axis", "side").agg(F.max_by(F.struct("wall_idx", "position", "points", "overlap"), F.struct("overlap", "wall_idx")).alias("b"))
    return best.select("capture_id", "room_id", "axis", "side", "b.*")


def measure_rooms(cells: DataFrame, bounds: DataFrame, drift: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Width (along x), length (along z) and floor area of rooms with their 95 % ranges, and the number of sides found.

    A missing side is the outermost cell's middle with a wide range. The area is that of the rectangle where the room fills four fifths of it, else that of
    its cells with a range for the missing corners.
    """
    from ..functions.geometry import wall_sigma

    rough = cells_of(cells).groupBy("capture_id", "room_id").agg((F.count("*") * p.grid**2).alias("area_rough"), *[((f(c) + 0.5) * p.grid).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("low", F.min), ("high", F.max))])
    b = bounds.withColumn("key", F.concat_ws("_", "axis", "side")).withColumn("sigma", wall_sigma(C("points"), p.surface_sigma, p.wall_reach))
    names = [f"{a}_{s}" for a in "xz" for s in ("low", "high")]
    known = b.groupBy("capture_id", "room_id").agg(*[F.max(F.when(C("key") == n, F.struct("position", "sigma"))).alias(n) for n in names], F.count("*").alias("sides"))
    r = rough.join(keyed(known), ["capture_id", "room_id"], "left").join(keyed(drift), "capture_id", "left")
    cell = {"x_low": "low_col", "x_high": "high_col", "z_low": "low_row", "z_high": "high_row"}
    at = lambda n: F.coalesce(C(f"{n}.position"), C(cell[n]))
    sg = lambda n: F.coalesce(C(f"{n}.sigma"), F.lit(p.missing_side_sigma))
    d = F.coalesce(C("drift_sigma"), F.lit(p.min_drift_sigma))
    span = lambda a: (at(f"{a}_high") - at(f"{a}_low"), F.sqrt(sg(f"{a}_low") ** 2 + sg(f"{a}_high") ** 2 + d * d))
    (w, sw), (length, sl) = span("x"), span("z")
    full = C("area_rough") >= p.rectangle_fill * w * length
    rect = F.hypot(length * sw, w * sl)
    area_sigma = F.when(full, rect).otherwise(F.hypot(rect, (w + length) * 2 * p.grid / 2))
    return r.select("capture_id", "room_id", F.coalesce("sides", F.lit(0)).alias("sides"), "area_rough", w.alias("width"), (2 * sw).alias("width_pm95"), length.alias("length"), (2 * sl).alias("length_pm95"), F.when(full, w * length).otherwise(C("area_rough")).alias("floor_area"), (2 * area_sigma).alias("area_pm95"), F.when(full, "rectangular").otherwise("not rectangular").alias("shape"), *[at(x).alias(x) for x in names], *[C(x).isNotNull().alias(f"{x}_found") for x in names])


def room_heights(points: DataFrame, cells: DataFrame, levels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Floor and ceiling of each room: floor_y, floor_points, ceiling_y, ceiling_seen, other_y, other_seen, note. ``points`` have row and col.

    The floor is the median of the points within 8 cm of the capture's, if there are 100. Points 1.8 m and more above it are counted by shelves of 2 cm, from
    the lowest of them on; the ten fullest (of equals the higher) are looked at in turn, and one within 10 cm of a level that was taken is part of that. A level
    is the median of the points within 3 cm of the shelf's middle, and is seen in the share of the room's cells that hold such a point. The first
    is the ceiling, if it is seen in a quarter of the room; the first further one that is seen in a tenth is another level of it.
    """
    room = ["capture_id", "room_id"]

    def by_room(rows: DataFrame, told: Column) -> DataFrame:
        """What is told of rooms, as one map a capture, written once: points meet it by capture, so they stay where they were dealt by capture, and are laid out again rather than written."""
        return keyed(written(rows.groupBy("capture_id").agg(F.map_from_entries(F.collect_list(F.struct("room_id", told.alias("v")))).alias("told")), "told"))

    inside = in_rooms(points.select("capture_id", "y", "row", "col"), cells)
    of = lambda: F.try_element_at("told", C("room_id"))
    near = F.when(F.abs(C("y") - C("rough")) <= 0.08, C("y"))
    floors = inside.join(keyed(levels.select("capture_id", C("floor_y").alias("rough"))), "capture_id").groupBy(*room, "rough").agg(F.median(near).alias("m"), F.count(near).alias("floor_points"))
    floors = written(floors.select(*room, "floor_points", F.when(C("floor_points") >= 100, C("m")).otherwise(C("rough")).alias("floor_y")), "floors")
    size = cells_of(cells).groupBy(*room).agg(F.count("*").alias("size"))
    high = inside.join(by_room(floors, C("floor_y")), "capture_id").where(C("y") >= of() + p.min_ceiling_gap).drop("told")
    # equal heights are counted first; the lowest of them and their number are told beside them
    own = Window.partitionBy(*room)
    heights = high.groupBy(*room, "y").agg(F.count("*").alias("k")).withColumns({"base": F.min("y").over(own), "high_points": F.sum("k").over(own)}).where("high_points >= 100")
    # a point on the bound of two shelves is of the upper one
    shelves = heights.groupBy(*room, "base", F.floor((C("y") - C("base")) / p.level_bin + 1e-9).cast("int").alias("shelf")).agg(F.sum("k").alias("n"))
    top = shelves.withColumn("k", F.row_number().over(Window.partitionBy(*room).orderBy(F.desc("n"), F.desc("shelf")))).where("k <= 10").withColumn("centre", C("base") + (C("shelf") + 0.5) * p.level_bin)
    tops = top.groupBy(*room).agg(F.collect_list(F.struct("k", "centre")).alias("tops"))
    at = high.join(by_room(tops, C("tops")), "capture_id").select(*room, "y", "row", "col", F.explode(F.filter(of(), lambda t: F.abs(C("y") - t["centre"]) <= 0.03)).alias("t")).select(*room, "y", "row", "col", "t.*")
    # a set of cells for each shelf; counted as distinct ones, each cell would have a median's buffer of its own
    cell = F.call_function("shiftleft", C("row").cast("long"), F.lit(32)) + C("col")
    seen = at.groupBy(*room, "k", "centre").agg(F.median("y").alias("level"), F.size(F.collect_set(cell)).alias("cells")).join(keyed(size), room)
    looked = seen.groupBy(*room).agg(F.sort_array(F.collect_list(F.struct("k", "centre", "level", (C("cells") / C("size")).alias("seen")))).alias("looked"))
    # at most ten shelves a room, one after another
    taken = F.aggregate("looked", F.slice("looked", 1, 1), lambda held, x: F.when(F.exists(held, lambda y: F.abs(x["centre"] - y["level"]) < p.level_apart), held).otherwise(F.concat(held, F.array(x))))
    levels_of = looked.withColumn("taken", taken)
    first = F.get("taken", F.lit(0))
    other = F.get(F.filter(F.slice("taken", 2, 9), lambda x: x["seen"] >= p.min_second_seen), F.lit(0))
    told = levels_of.select(*room, first["level"].alias("level"), first["seen"].alias("ceiling_seen"), other["level"].alias("other_y"), other["seen"].alias("other_seen"))
    enough = C("ceiling_seen") >= p.min_ceiling_seen
    note = F.when(C("ceiling_seen").isNull(), "ceiling not seen").when(~enough, F.concat(F.lit("ceiling seen over only "), F.round(C("ceiling_seen") * 100).cast("int").cast("string"), F.lit("% of the room; not reported")))
    return floors.join(keyed(told), room, "left").select(
        *room, "floor_y", "floor_points", F.when(enough, C("level")).alias("ceiling_y"), F.coalesce("ceiling_seen", F.lit(0.0)).alias("ceiling_seen"),
        F.when(enough, C("other_y")).alias("other_y"), F.when(enough, C("other_seen")).alias("other_seen"), note.alias("note"))


def ceiling_heights(heights: DataFrame, drift: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Ceiling over the floor with its 95 % range, wider where less than half of the ceiling was seen: capture_id, room_id, ceiling, ceiling_pm95, note."""
    extra = F.when(C("ceiling_seen") < 0.5, p.low_cover_sigma**2).otherwise(0.0)
    sigma = F.sqrt(2 * p.surface_sigma**2 + F.pow(F.coalesce("drift_sigma", F.lit(p.min_drift_sigma)), 2) + extra)
    h = heights.join(keyed(drift), "capture_id", "left").withColumn("ceiling", C("ceiling_y") - C("floor_y"))
    return h.select("capture_id", "room_id", "ceiling", F.when(C("ceiling").isNotNull(), 2 * sigma).alias("ceiling_pm95"), "note")


def drift_of_floors(heights: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """drift_sigma of each capture: half of how far the floors of its rooms lie apart, 3 mm at least; of those with 100 points."""
    known = F.when(C("floor_points") >= 100, C("floor_y"))
    return heights.groupBy("capture_id").agg(F.greatest(F.coalesce((F.max(known) - F.min(known)) / 2, F.lit(0.0)), F.lit(p.min_drift_sigma)).alias("drift_sigma"))
