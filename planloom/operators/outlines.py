"""Operators on room outlines, on places in plans, and on two plans of one home."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from ..storage import keyed
from .raster import cells_of, open_, square

C = F.col


def rectangle(rooms: DataFrame) -> DataFrame:
    """Four corners of a room from the positions of its sides: keys, k, x, z."""
    corners = [("x_low", "z_low"), ("x_high", "z_low"), ("x_high", "z_high"), ("x_low", "z_high")]
    c = F.posexplode(F.array(*[F.struct(C(x).alias("x"), C(z).alias("z")) for x, z in corners])).alias("k", "c")
    keys = [x for x in rooms.columns if x not in {"x_low", "x_high", "z_low", "z_high"}]
    return rooms.select(*keys, c).select(*keys, "k", "c.x", "c.z")


def edges(corners: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of closed outlines: axis of the line they stand on ('z' if they run along x), level, length."""
    w = Window.partitionBy(*keys).orderBy("k")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    e = corners.withColumns({"nx": nxt("x"), "nz": nxt("z")})
    flat = F.abs(C("nx") - C("x")) >= F.abs(C("nz") - C("z"))
    return e.select(*keys, "k", F.when(flat, "z").otherwise("x").alias("axis"), F.when(flat, (C("z") + C("nz")) / 2).otherwise((C("x") + C("nx")) / 2).alias("level"), F.hypot(C("nx") - C("x"), C("nz") - C("z")).alias("length"))


def merge_edges(edge: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of edges of one axis become one edge; the last run goes on in the first one of the same axis. Levels are means by length."""
    w = Window.partitionBy(*keys).orderBy("k")
    run = F.sum(F.coalesce((C("axis") != F.lag("axis").over(w)).cast("int"), F.lit(0))).over(w)
    e = edge.withColumn("run", run)
    every = Window.partitionBy(*keys)
    last, first_axis, last_axis = F.max("run").over(every), F.min_by("axis", "k").over(every), F.max_by("axis", "k").over(every)
    e = e.withColumns({"last": last, "wraps": (first_axis == last_axis) & (last > 0)})
    e = e.withColumn("run", F.when(C("wraps") & (C("run") == C("last")), 0).otherwise(C("run")))
    m = e.groupBy(*keys, "run", "axis").agg((F.sum(C("level") * C("length")) / F.sum("length")).alias("level"), F.sum("length").alias("length"))
    return m.withColumn("k", (F.row_number().over(Window.partitionBy(*keys).orderBy("run")) - 1).cast("int")).drop("run")


def snap_edges(edge: DataFrame, walls: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Edges moved to the nearest of the room's walls of their axis within 15 cm, with ``detected``; the others stay."""
    w = walls.select(*keys, "axis", "position", "wall_idx")
    j = edge.join(keyed(w), [*keys, "axis"], "left").withColumn("off", F.when(F.abs(C("position") - C("level")) <= p.align_tolerance, F.abs(C("position") - C("level"))))
    best = j.groupBy(*keys, "k", "axis", "level", "length").agg(F.min_by("position", F.when(C("off").isNotNull(), F.struct("off", "wall_idx"))).alias("at"))
    return best.select(*keys, "k", "axis", F.coalesce("at", "level").alias("level"), "length", C("at").isNotNull().alias("detected"))


def corners_of(edge: DataFrame, keys: list[str]) -> DataFrame:
    """Corners k between edges k and k + 1 (the last meets the first): x, z, and whether the wall that begins there was detected."""
    w = Window.partitionBy(*keys).orderBy("k")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    e = edge.withColumns({"next_level": nxt("level"), "next_detected": nxt("detected"), "n": F.count("*").over(every)}).where("n >= 4")
    return e.select(*keys, "k", F.when(C("axis") == "x", C("level")).otherwise(C("next_level")).alias("x"), F.when(C("axis") == "x", C("next_level")).otherwise(C("level")).alias("z"), C("next_detected").alias("detected"))


def _ring(row: np.ndarray, col: np.ndarray) -> list[tuple[int, int]]:
    """Corners of the outer boundary of cells, from the first cell's upper left one on: along the cells' borders with the room on the right (right, down, left, up)."""
    top, left, wide = int(row.min()), int(col.min()), int(np.ptp(col)) + 3
    # cells by one number, in a frame of one empty cell to each side
    own = set(((row - top + 1) * wide + col - left + 1).tolist())
    steps = (1, wide, -1, -wide)
    ahead = ((-wide, 0), (0, -1), (-1, -wide - 1), (-wide - 1, -wide))
    start = at = min(own)
    way, out = 0, [start]
    while True:
        at += steps[way]
        a, b = ahead[way]
        turn = 3 if at + a in own else 0 if at + b in own else 1
        if turn:
            way = (way + turn) % 4
            if at == start and way == 0:
                return [(x // wide + top - 1, x % wide + left - 1) for x in out]
            out.append(at)


def _simple(line: np.ndarray, tolerance: float) -> np.ndarray:
    """A line of corners without those that lie within ``tolerance`` of what is left."""
    keep = np.zeros(len(line), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        size = np.hypot(*d)
        rel = line[a + 1 : b] - line[a]
        off = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / size if size else np.hypot(rel[:, 0], rel[:, 1])
        if off.max() > tolerance:
            i = a + 1 + int(off.argmax())
            keep[i] = True
            stack += [(a, i), (i, b)]
    return line[keep]


def trace(cells: DataFrame, keys: list[str], tolerance: float = 3.0, grid: float = 0.05) -> DataFrame:
    """The outer boundary of each room's cells, as corners k, x, z, simplified to ``tolerance`` cells.

    A room's cells are bounded by its size; rooms are spread over the cluster, and many go through a task in one batch.
    """
    kinds = dict(cells.select(*keys).dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", k int, x double, z double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("cells")
            ends = held.offsets.to_numpy()
            row, col = (held.values.field(c).to_numpy().astype(np.int64) for c in ("row", "col"))
            outlines = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                ring = _ring(row[a:b], col[a:b])
                far = max(range(len(ring)), key=lambda i: (abs(ring[i][0] - ring[0][0]) + abs(ring[i][1] - ring[0][1]), -i))
                line = np.array([*ring, ring[0]], dtype=float)
                outlines.append(np.concatenate([_simple(line[: far + 1], tolerance)[:-1], _simple(line[far:], tolerance)[:-1]]))
            if not outlines:
                continue
            n = [len(x) for x in outlines]
            of, at = np.repeat(np.arange(len(n)), n), np.concatenate(outlines)
            k = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in keys), pa.array(k), pa.array(at[:, 1] * grid), pa.array(at[:, 0] * grid)], [*keys, "k", "x", "z"])

    rooms = cells.groupBy(*keys).agg(F.collect_list(F.struct("row", "col")).alias("cells"))
    return rooms.mapInArrow(run, schema)


def outline_walls(corners: DataFrame, keys: list[str], sigma: float = 0.005, loose: float = 0.05) -> DataFrame:
    """Walls of outlines with lengths and ranges: both ends are as sure as the wall was detected."""
    w = Window.partitionBy(*keys).orderBy("k")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    e = F.when(C("detected"), sigma).otherwise(loose)
    ends = corners.withColumns({"nx": nxt("x"), "nz": nxt("z")})
    return ends.select(*keys, "k", F.round(F.hypot(C("nx") - C("x"), C("nz") - C("z")), 3).alias("length"), F.round(2 * F.hypot(e, e), 3).alias("pm95"), "detected")


def rectangle_walls(rooms: DataFrame) -> DataFrame:
    """Walls of rectangular rooms as ``measure_rooms`` has them: those along x are as long and as sure as the width, the others as the length; whether a side was found is told."""
    keys = ["capture_id", "room_id"]
    side = lambda axis, found: F.struct(C(axis).alias("length"), C(f"{axis}_pm95").alias("pm95"), C(found).alias("detected"))
    sides = F.array(side("width", "z_low_found"), side("length", "x_high_found"), side("width", "z_high_found"), side("length", "x_low_found"))
    return rooms.select(*keys, F.posexplode(sides).alias("k", "s")).select(*keys, "k", F.round("s.length", 3).alias("length"), F.round("s.pm95", 3).alias("pm95"), "s.detected")


def room_walls(rooms: DataFrame, cells: DataFrame, walls: DataFrame, touched: DataFrame) -> DataFrame:
    """Outlines of rooms with their walls: capture_id, room_id, traced, k, x, z, length, pm95, detected.

    A rectangular room, and one of which the traced outline has fewer than four edges, has the rectangle of its sides; any other is traced from its cells without spikes
    thinner than 30 cm, and its edges lie on the walls that touch it. ``rooms`` comes from ``measure_rooms``, ``touched`` from ``touched_rooms``.
    """
    keys = ["capture_id", "room_id"]
    odd = rooms.where("shape <> 'rectangular'").select(*keys)
    # cells are laid out only of captures that have such rooms
    held = cells_of(cells.join(keyed(odd.select("capture_id").distinct()), "capture_id", "left_semi"))
    patches = held.join(keyed(odd), keys).withColumn("home", F.struct(*keys)).select(C("home").alias("capture_id"), "row", "col")
    kept = open_(patches, square(7)).select(C("capture_id.capture_id").alias("capture_id"), C("capture_id.room_id").alias("room_id"), "row", "col")
    own = walls.join(keyed(touched), ["capture_id", "wall_idx"]).select(*keys, "axis", "position", "wall_idx")
    corners = corners_of(snap_edges(merge_edges(edges(trace(kept, keys), keys), keys), own, keys), keys)
    traced = corners.join(keyed(outline_walls(corners, keys).drop("detected")), [*keys, "k"]).withColumn("traced", F.lit(True))
    rest = rooms.join(keyed(traced.select(*keys).distinct()), keys, "left_anti")
    flat = rectangle(rest.select(*keys, "x_low", "x_high", "z_low", "z_high")).join(keyed(rectangle_walls(rest)), [*keys, "k"]).withColumn("traced", F.lit(False))
    names = [*keys, "traced", "k", "x", "z", "length", "pm95", "detected"]
    return traced.select(*names).unionByName(flat.select(*names))


def outline_area_range(walls: DataFrame, areas: DataFrame, keys: list[str], loose: float = 0.05) -> DataFrame:
    """Range of a traced area: its undetected walls may be off, and a quarter of the rectangle's range."""
    length = walls.groupBy(*keys).agg(F.sum(F.when(~C("detected"), C("length")).otherwise(0.0)).alias("loose"))
    return length.join(areas, keys).select(*keys, F.round(2 * F.hypot(C("loose") * loose, C("area_pm95") / 4), 6).alias("pm95"))


def place_on_plan(places: DataFrame, corners: DataFrame, p: Params = DEFAULTS, reach: float = 0.3, wall_reach: float = 0.35, cell: float = 1.0) -> DataFrame:
    """Room and surface of places (id, x, y, z): the first room, by its number, that holds the place or lies within 30 cm; then floor or ceiling by
    height, else the nearest wall within 35 cm, else an unknown surface of the room. A place in no room has neither.

    Places meet rooms by the cells of a metre that a room's bounds, with 30 cm around them, touch; only those rooms' edges are looked at.
    """
    w = Window.partitionBy("capture_id", "room_id").orderBy("k")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    e = corners.select("capture_id", "room_id", "k", "ceiling", C("x").alias("ax"), C("z").alias("az"), nxt("x").alias("bx"), nxt("z").alias("bz"))
    box = corners.groupBy("capture_id", "room_id").agg(*[f(c).alias(n) for c in "xz" for f, n in ((F.min, f"low_{c}"), (F.max, f"high_{c}"))])
    span = lambda c: F.explode(F.sequence(F.floor((C(f"low_{c}") - reach) / cell), F.floor((C(f"high_{c}") + reach) / cell)))
    box = box.withColumn("cell_x", span("x")).withColumn("cell_z", span("z")).select("capture_id", "room_id", "cell_x", "cell_z")
    met = places.withColumns({"cell_x": F.floor(C("x") / cell), "cell_z": F.floor(C("z") / cell)}).join(keyed(box), ["capture_id", "cell_x", "cell_z"])
    j = met.join(keyed(e), ["capture_id", "room_id"])
    dx, dz = C("bx") - C("ax"), C("bz") - C("az")
    size = dx * dx + dz * dz
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((C("x") - C("ax")) * dx + (C("z") - C("az")) * dz) / F.when(size > 0, size)))
    # not by hypot: its last digit would decide between the two walls of a corner that is nearest
    off_x, off_z = C("x") - C("ax") - F.coalesce(t, F.lit(0.0)) * dx, C("z") - C("az") - F.coalesce(t, F.lit(0.0)) * dz
    far = F.sqrt(off_x * off_x + off_z * off_z)
    cut = ((C("az") > C("z")) != (C("bz") > C("z"))) & (C("x") < C("ax") + (C("z") - C("az")) / F.when(dz != 0, dz) * dx)
    per = j.withColumns({"far": far, "cut": F.coalesce(cut, F.lit(False)).cast("int")}).groupBy("capture_id", "id", "y", "room_id").agg((F.sum("cut") % 2 == 1).alias("inside"), F.min(F.struct("far", "k")).alias("near"), F.first("ceiling").alias("ceiling"))
    per = per.where(C("inside") | (C("near.far") <= reach))
    first = per.withColumn("n", F.row_number().over(Window.partitionBy("capture_id", "id").orderBy("room_id"))).where("n = 1")
    room = F.concat(F.lit("R"), C("room_id").cast("string"))
    kind = F.when(C("y") < 0.15, "floor").when(C("y") > C("ceiling") - 0.25, "ceiling").when(C("near.far") < wall_reach, "wall").otherwise("unknown")
    placed = first.withColumn("surface_type", kind)
    surface = F.when(C("surface_type") == "wall", F.concat(room, F.lit("-W"), (C("near.k") + 1).cast("string"))).otherwise(F.concat(room, F.lit("-"), C("surface_type")))
    told = placed.select("capture_id", "id", room.alias("room"), surface.alias("surface"), "surface_type")
    return places.select("capture_id", "id").join(keyed(told), ["capture_id", "id"], "left").withColumn("surface_type", F.coalesce("surface_type", F.lit("unknown")))


def room_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """IoU of the rooms of two plans that share cells (capture_id, room_id, row, col)."""
    size = lambda d, n: d.groupBy("capture_id", C("room_id").alias(n)).agg(F.count("*").alias(f"n_{n}"))
    both = a.withColumnRenamed("room_id", "a").join(b.withColumnRenamed("room_id", "b"), ["capture_id", "row", "col"]).groupBy("capture_id", "a", "b").agg(F.count("*").alias("n"))
    return both.join(size(a, "a"), ["capture_id", "a"]).join(size(b, "b"), ["capture_id", "b"]).select("capture_id", "a", "b", (C("n") / (C("n_a") + C("n_b") - C("n"))).alias("iou"))


def match_rooms(overlaps: DataFrame, least: float = 0.3) -> DataFrame:
    """Each room of a, in order, takes the free room of b with the greatest IoU of 0.3 and more. A capture's rooms are few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        rows = []
        for a, own in pdf.sort_values(["a", "iou", "b"], ascending=[True, False, True]).groupby("a", sort=True):
            for b, iou in zip(own["b"], own["iou"], strict=True):
                if iou >= least and b not in used:
                    used.add(b)
                    rows.append((pdf["capture_id"].iloc[0], a, b, iou))
                    break
        return pd.DataFrame(rows, columns=["capture_id", "a", "b", "iou"])

    return overlaps.groupBy("capture_id").applyInPandas(run, overlaps.select("capture_id", "a", "b", "iou").schema)


def only_in_one(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """Rooms of either plan without a match."""
    left = a.select("capture_id", C("room_id").alias("a")).distinct().join(matches, ["capture_id", "a"], "left_anti").select("capture_id", F.lit("a").alias("plan"), C("a").alias("room_id"))
    right = b.select("capture_id", C("room_id").alias("b")).distinct().join(matches, ["capture_id", "b"], "left_anti").select("capture_id", F.lit("b").alias("plan"), C("b").alias("room_id"))
    return left.unionByName(right)


def align_plans(a: DataFrame, b: DataFrame) -> DataFrame:
    """The quarter turns and the shift of b's cells that lay most of them on a's: capture_id, turns, dr, dc, n. Of equal counts the least turns, then shifts, count.

    For each turn the counts of all shifts are one correlation of two pictures, by Fourier transforms, whose size is that of one home; homes are spread over the cluster.
    """

    def picture(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, int, int]:
        r, c = int(rows.min()), int(cols.min())
        out = np.zeros((int(rows.max()) - r + 1, int(cols.max()) - c + 1))
        out[rows - r, cols - c] = 1
        return out, r, c

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["capture_id", "turns", "dr", "dc", "n"]
        if left.empty or right.empty:
            return pd.DataFrame({x: pd.Series(dtype="int64") for x in names})
        one, r0, c0 = picture(left["row"].to_numpy(), left["col"].to_numpy())
        row, col = right["row_b"].to_numpy(), right["col_b"].to_numpy()
        best = None
        for turns, (rows, cols) in enumerate(((row, col), (col, -row), (-row, -col), (-col, row))):
            two, r1, c1 = picture(rows, cols)
            shape = (one.shape[0] + two.shape[0] - 1, one.shape[1] + two.shape[1] - 1)
            n = np.rint(np.fft.irfft2(np.fft.rfft2(one, shape) * np.conj(np.fft.rfft2(two, shape)), shape)).astype(np.int64)
            for i, j in np.argwhere(n == n.max()).tolist():
                dr, dc = (i if i < one.shape[0] else i - shape[0]) + r0 - r1, (j if j < one.shape[1] else j - shape[1]) + c0 - c1
                found = (-int(n.max()), turns, dr, dc)
                best = found if best is None else min(best, found)
        return pd.DataFrame([(key[0], best[1], best[2], best[3], -best[0])], columns=names)

    named = b.select(C("capture_id").alias("home"), C("row").alias("row_b"), C("col").alias("col_b")).distinct()
    kinds = dict(a.select("capture_id").dtypes)
    return a.select("capture_id", "row", "col").distinct().groupBy("capture_id").cogroup(named.groupBy("home")).applyInPandas(run, f"capture_id {kinds['capture_id']}, turns int, dr long, dc long, n long")


def shared_content(items: DataFrame) -> DataFrame:
    """Unordered pairs of rooms that hold items of the same bytes, and how many contents they share: a, b, n.

    Copies within a room count once. Rooms meet by the digest of a content; a content of very many rooms is split by Spark as any skewed join, and its pairs are added up before they are shuffled.
    """
    held = items.select(F.sha1(C("content").cast("binary")).alias("sha1"), "room").where("content is not null").distinct()
    side = lambda n: held.select("sha1", C("room").alias(n))
    return side("a").join(side("b"), "sha1").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def complete_rooms(rooms: DataFrame, least: int = 3) -> DataFrame:
    """Rooms of which three sides and more are found."""
    return rooms.where(C("sides") >= least)
