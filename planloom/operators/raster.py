"""Operators on the plan's grid: sparse cells (capture_id, row, col), never a dense picture."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from ..storage import dealt, keyed, merged

CELL = ["capture_id", "row", "col"]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an ellipse-shaped kernel of odd size: those within its radius, measured half a cell wide."""
    r = size // 2
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r + r * 0.25]


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def _half_widths(kernel: list[tuple[int, int]]) -> dict[int, int]:
    """By row of the kernel how far it reaches to both sides; kernels here are convex and symmetric."""
    half: dict[int, int] = {}
    for i, j in kernel:
        half[i] = max(half.get(i, 0), j)
    if sorted(kernel) != sorted((i, j) for i, h in half.items() for j in range(-h, h + 1)):
        raise ValueError("a kernel's rows must reach as far to both sides, without holes")
    return half


def _runs(cells: DataFrame) -> DataFrame:
    """Cells without repeats, with the first and last column (low, high) of the run in their row that they are in."""
    by_row = Window.partitionBy("capture_id", "row").orderBy("col")
    told = cells.select(*CELL).distinct().withColumn("island", F.col("col") - F.row_number().over(by_row))
    own = Window.partitionBy("capture_id", "row", "island")
    return told.withColumns({"low": F.min("col").over(own), "high": F.max("col").over(own)}).drop("island")


def dilate(cells: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    """All cells that the kernel reaches from any cell. Runs of cells, not single ones, are sent to the rows that they reach, and merged there."""
    reach = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("h")) for i, h in _half_widths(kernel).items()])).alias("o")
    runs = _runs(cells).where("col = low").select("capture_id", "row", "low", "high", reach)
    laid = runs.select("capture_id", (F.col("row") + F.col("o.i")).alias("row"), (F.col("low") - F.col("o.h")).alias("low"), (F.col("high") + F.col("o.h")).alias("high"))
    w = Window.partitionBy("capture_id", "row").orderBy("low", "high")
    so_far = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = laid.withColumn("new", F.coalesce((F.col("low") > so_far + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    merged = joined.groupBy("capture_id", "row", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.select("capture_id", "row", F.explode(F.sequence("low", "high")).alias("col"))


def erode(cells: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    """Cells of which all that the kernel reaches are cells too: in each row of the kernel the run of cells there must be long enough to both sides."""
    wide = _runs(cells).select(*CELL, F.least(F.col("col") - F.col("low"), F.col("high") - F.col("col")).alias("reach"))
    by_col = Window.partitionBy("capture_id", "col").orderBy("row")
    good = F.lit(True)
    for i, h in _half_widths(kernel).items():
        good = good & F.coalesce(F.max("reach").over(by_col.rangeBetween(i, i)) >= h, F.lit(False))
    return wide.withColumn("good", good).where("good").select(*CELL)


def close(cells: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    return erode(dilate(cells, kernel), kernel)


def open_(cells: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(cells, kernel), kernel)


def floor_mask(points: DataFrame, floors: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """Cells with any point above the floor, or little below it."""
    return points.join(keyed(floors.select("capture_id", "floor_y")), "capture_id").where(F.col("y") >= F.col("floor_y") - tolerance).select(*CELL).distinct()


#: Walls whose cells are laid out by one task, and corners of outlines.
WALLS, CORNERS = 10_000, 20_000


def barrier(segments: DataFrame, extend: float = 0.15, p: Params = DEFAULTS) -> DataFrame:
    """Cells of walls along the axes (axis, position, start, end in the grid's metres), lengthened at both ends, two cells thick.

    A wall at a position covers the cell that holds it and the one before. Walls are dealt to tasks by capture before their cells are laid out.
    """
    return _laid(dealt(segments, WALLS, "capture_id"), extend, p).distinct()


def _laid(segments: DataFrame, extend: float, p: Params) -> DataFrame:
    """Cells of walls, of which some repeat."""
    at = F.floor(F.col("position") / p.grid).cast("int")
    along = F.explode(F.sequence(F.floor((F.col("start") - extend) / p.grid).cast("int"), F.floor((F.col("end") + extend) / p.grid).cast("int"))).alias("k")
    s = segments.select("capture_id", "axis", at.alias("at"), along).withColumn("across", F.explode(F.array(F.col("at") - 1, F.col("at"))))
    # a wall of constant x has its position in the column
    return s.select("capture_id", F.when(F.col("axis") == "x", F.col("k")).otherwise(F.col("across")).alias("row"), F.when(F.col("axis") == "x", F.col("across")).otherwise(F.col("k")).alias("col"))


def subtract(cells: DataFrame, others: DataFrame) -> DataFrame:
    return cells.join(merged(others), CELL, "left_anti")


def _label(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Components of cells by 4-neighbours: the number of each cell's first one, by union-find over neighbours."""
    index = {(int(r), int(c)): i for i, (r, c) in enumerate(zip(rows, cols, strict=True))}
    up = list(range(len(index)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for (r, c), i in index.items():
        for other in (index.get((r, c + 1)), index.get((r + 1, c))):
            if other is not None:
                a, b = root(i), root(other)
                up[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(up))])


def components(cells: DataFrame) -> DataFrame:
    """Cells with component_id: 1, 2 ... in each capture by the first cell in row order.

    A capture's cells are bounded by a home's size (some ten thousand), so each capture is labelled in one go; captures are spread over the cluster.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["row", "col"]).sort_values(["row", "col"])
        first = _label(pdf["row"].to_numpy(), pdf["col"].to_numpy())
        return pdf.assign(component_id=np.unique(first, return_inverse=True)[1] + 1)

    return cells.select(*CELL).groupBy("capture_id").applyInPandas(run, "capture_id long, row int, col int, component_id int")


def grow(free: DataFrame, seeds: DataFrame) -> DataFrame:
    """Free cells with the room_id of the nearest seed by steps through free 4-neighbours; of equally near ones the smaller id. Cells out of reach have none."""

    def run(key, cells: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if start.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("capture_id", "row", "col", "room_id")})
        open_cells = set() if cells.empty else set(zip(cells["row"], cells["col"], strict=True))
        best: dict[tuple[int, int], int] = {}
        for r, c, room in sorted(zip(start["seed_row"], start["seed_col"], start["seed_id"], strict=True), key=lambda x: -x[2]):
            best[(r, c)] = room
        edge = dict(best)
        while edge:
            step: dict[tuple[int, int], int] = {}
            for (r, c), room in edge.items():
                for cell in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if cell in open_cells and cell not in best:
                        step[cell] = min(room, step.get(cell, room))
            best.update(step)
            edge = step
        out = [(key[0], r, c, room) for (r, c), room in best.items()]
        return pd.DataFrame(out, columns=["capture_id", "row", "col", "room_id"])

    # other names, since seeds mostly come from the same cells
    named = seeds.select(F.col("capture_id").alias("home"), F.col("row").alias("seed_row"), F.col("col").alias("seed_col"), F.col("room_id").alias("seed_id"))
    return free.select(*CELL).groupBy("capture_id").cogroup(named.groupBy("home")).applyInPandas(run, "capture_id long, row int, col int, room_id int")


def _packed(values: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of values along an axis on which stretches without any are cut to ``gap``, and the axis's values: strays far off make no large picture."""
    own, which = np.unique(values, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(np.minimum(np.diff(own), gap))]).astype(np.int64)
    every = np.arange(at[-1] + 1)
    base = np.searchsorted(at, every, side="right") - 1
    return at[which], own[base] + every - at[base]


def _wide(mask: np.ndarray, kernel: list[tuple[int, int]], full: bool) -> np.ndarray:
    """A picture dilated by a kernel (any cell that it reaches counts), or eroded (``full``: all must); there is nothing beyond the picture."""
    tall, wide = mask.shape
    total = np.pad(np.cumsum(mask, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
    at, by_reach, out = np.arange(wide), {}, np.full(mask.shape, full)
    for i, h in _half_widths(kernel).items():
        if h not in by_reach:
            n = total[:, np.minimum(at + h + 1, wide)] - total[:, np.maximum(at - h, 0)]
            by_reach[h] = n == 2 * h + 1 if full else n > 0
        there = np.zeros_like(mask)
        there[max(0, -i) : tall - max(0, i)] = by_reach[h][max(0, i) : tall - max(0, -i)]
        out = out & there if full else out | there
    return out


def _numbered(mask: np.ndarray) -> np.ndarray:
    """A picture's components by 4-neighbours, numbered from 1 by their first cells: runs of cells are joined with those that they touch in the next row."""
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, low), high = np.nonzero(step == 1), np.nonzero(step == -1)[1] - 1
    wide = mask.shape[1]
    first = np.searchsorted(row * wide + high, (row + 1) * wide + low)
    n = np.searchsorted(row * wide + low, (row + 1) * wide + high, side="right") - first
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    below = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    for i, j in zip(np.repeat(np.arange(len(row)), n).tolist(), below.tolist(), strict=True):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    out = np.zeros(mask.shape, np.int32)
    if up:
        out[mask] = np.repeat(np.unique([root(i) for i in range(len(up))], return_inverse=True)[1] + 1, high - low + 1)
    return out


def _grown(free: np.ndarray, islands: np.ndarray) -> np.ndarray:
    """Islands grown over the free cells, a step of all at a time; of islands that reach a cell at once the smaller one gets it."""
    far = np.iinfo(np.int32).max
    held = np.pad(np.where(islands > 0, islands, far), 1, constant_values=far)
    inner = held[1:-1, 1:-1]
    while True:
        near = np.minimum(np.minimum(held[:-2, 1:-1], held[2:, 1:-1]), np.minimum(held[1:-1, :-2], held[1:-1, 2:]))
        new = free & (inner == far) & (near < far)
        if not new.any():
            return np.where(inner < far, inner, 0)
        inner[new] = near[new]


def _filled(mask: np.ndarray) -> np.ndarray:
    """A picture with what can't be reached from its border."""
    if min(mask.shape) < 3:
        return mask
    return (_numbered(~np.pad(mask, 1)) != 1)[1:-1, 1:-1]


def _claimed(rooms: list[tuple[int, np.ndarray, np.ndarray]], blocked: Callable[[np.ndarray, np.ndarray], np.ndarray], cell: float, min_area: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """room, row and col of one capture's rooms (number, rows and cols, by number), filled, without blocked cells and without rooms under ``min_area``; the first that claims a cell gets it."""
    parts = []
    for number, row, col in rooms:
        if (np.ptp(row) + 1) * (np.ptp(col) + 1) * cell**2 < min_area:
            continue  # even its bounds are too small
        (i, rows), (j, cols) = _packed(row, 2), _packed(col, 2)
        own = np.zeros((len(rows), len(cols)), bool)
        own[i, j] = True
        i, j = np.nonzero(_filled(own))
        row, col = rows[i], cols[j]
        kept = ~blocked(row, col)
        if kept.sum() * cell**2 >= min_area:
            parts.append((np.full(kept.sum(), number), row[kept], col[kept]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    number, row, col = (np.concatenate(x) for x in zip(*parts, strict=True))
    # a cell as one number, in order of rows and columns
    left, wide = int(col.min()), int(np.ptp(col)) + 1
    first = np.unique(row.astype(np.int64) * wide + (col - left), return_index=True)[1]
    return number[first], row[first], col[first]


ROOM_CELLS = pa.schema([("capture_id", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("room_id", pa.int32())])


def _room_cells(capture: int, number: np.ndarray, row: np.ndarray, col: np.ndarray) -> pa.Table:
    return pa.table([np.full(len(number), capture, np.int64), row.astype(np.int32), col.astype(np.int32), number.astype(np.int32)], schema=ROOM_CELLS)


def _known(row: np.ndarray, col: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether cells are among these."""
    own = np.sort(row.astype(np.int64) << 32 | col.astype(np.int64) & 0xFFFFFFFF)

    def among(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        asked = rows.astype(np.int64) << 32 | cols.astype(np.int64) & 0xFFFFFFFF
        if not len(own):
            return np.zeros(len(asked), bool)
        return own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked

    return among


def _by_home(cells: DataFrame) -> DataFrame:
    """Cells under other names, since those that they meet mostly come from the same ones."""
    return cells.select(F.col("capture_id").alias("home"), F.col("row").alias("home_row"), F.col("col").alias("home_col"))


def fill_rooms(rooms: DataFrame, blocked: DataFrame, p: Params = DEFAULTS, min_area: float = 1.5) -> DataFrame:
    """Rooms with their holes filled, but not on blocked cells; rooms under 1.5 m2 go; of rooms that claim a cell the first gets it.

    All rooms of a capture are filled in one go, each in a picture of its own bounds.
    """

    def run(key, own: pa.Table, others: pa.Table) -> pa.Table:
        number, row, col = (own[c].to_numpy() for c in ("room_id", "row", "col"))
        order = np.argsort(number, kind="stable")
        number, row, col = number[order], row[order], col[order]
        ends = np.flatnonzero(np.diff(number)) + 1
        parts = [(int(n[0]), r, c) for n, r, c in zip(*(np.split(x, ends) for x in (number, row, col)), strict=True) if len(n)]
        return _room_cells(key[0].as_py(), *_claimed(parts, _known(others["home_row"].to_numpy(), others["home_col"].to_numpy()), p.grid, min_area))

    return rooms.select(*CELL, "room_id").groupBy("capture_id").cogroup(_by_home(blocked).groupBy("home")).applyInArrow(run, "capture_id long, row int, col int, room_id int")


def find_rooms(floor: DataFrame, walls: DataFrame, holes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``find_charts`` as cells with room_id."""
    return cells_of(find_charts(floor, walls, holes, p))


def find_charts(floor: DataFrame, walls: DataFrame, holes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``charts`` of the rooms: the seen floor, parted at walls and at passages narrower than a door. Captures without rooms have none.

    Small holes of the floor are closed; walls, and the holes in them (gaps too narrow for a door), are barriers. Free floor is shrunk by 45 cm, so that every passage
    under 0.9 m closes and each room is an island, whether or not its doors and wall ends were found; islands grow back over the free floor and meet
    in their doorways. Holes inside a room are filled, rooms under 1.5 m2 go, and the others are numbered from 1.

    Cells and barriers of a home are brought together once, and all steps work on its picture, which its size bounds; homes are spread over the cluster.
    """
    closing, splitting = ellipse(int(round(p.floor_fill / p.grid)) | 1), ellipse(2 * int(round(p.door_split / p.grid)) + 1)
    reach = max(i for i, _ in closing)
    barriers = _laid(walls, 0.15, p).unionByName(_laid(holes, 0.0, p))

    def run(key, own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows or key[0].as_py() is None:
            return CHART.empty_table()
        (i, rows), (j, cols) = (_packed(own[c].to_numpy().astype(np.int64), 2 * reach + 2) for c in ("row", "col"))
        seen = np.zeros((len(rows) + 2 * reach, len(cols) + 2 * reach), bool)
        seen[i + reach, j + reach] = True
        closed = _wide(_wide(seen, closing, False), closing, True)[reach : reach + len(rows), reach : reach + len(cols)]
        blocked = _known(others["home_row"].to_numpy(), others["home_col"].to_numpy())
        i, j = np.nonzero(closed)
        free = closed.copy()
        free[i, j] = ~blocked(rows[i], cols[j])
        grown = _grown(free, _numbered(_wide(free, splitting, True)))
        parts = [(n, rows[i], cols[j]) for n in range(1, int(grown.max()) + 1) for i, j in [np.nonzero(grown == n)]]
        number, row, col = _claimed(parts, blocked, p.grid, p.min_room_area)
        return _charted(key[0], np.unique(number, return_inverse=True)[1] + 1, row, col) if len(number) else CHART.empty_table()

    return floor.select(*CELL).distinct().groupBy("capture_id").cogroup(_by_home(barriers).groupBy("home")).applyInArrow(run, CHARTS)


CHARTS = "capture_id long, top int, left int, wide int, rooms array<int>"
CHART = pa.schema([("capture_id", pa.int64()), *((c, pa.int32()) for c in ("top", "left", "wide")), ("rooms", pa.list_(pa.int32()))])
#: Cells of the charts that are one task's.
CHARTED = 4_000_000


def _charted(capture: pa.Scalar, room: np.ndarray, row: np.ndarray, col: np.ndarray) -> pa.Table:
    chart = np.zeros((np.ptp(row) + 1, np.ptp(col) + 1), np.int32)
    chart[row - row.min(), col - col.min()] = room
    return pa.table([pa.array([capture.as_py()], pa.int64()), *(pa.array([x], pa.int32()) for x in (int(row.min()), int(col.min()), chart.shape[1])), pa.array([chart.ravel()], pa.list_(pa.int32()))], schema=CHART)


def charts(cells: DataFrame) -> DataFrame:
    """Each capture's rooms as one array of room_id by row and column (0: none) over their bounds: capture_id, top, left, wide, rooms."""
    run = lambda own: _charted(own["capture_id"][0], *(own[c].to_numpy() for c in ("room_id", "row", "col")))
    return cells.select(*CELL, "room_id").groupBy("capture_id").applyInArrow(run, CHARTS)


def cells_of(rooms: DataFrame) -> DataFrame:
    """Cells with room_id of ``charts``; cells as they are."""
    if "rooms" not in rooms.columns:
        return rooms
    laid = rooms.select("capture_id", "top", "left", "wide", F.posexplode("rooms").alias("at", "room_id")).where("room_id > 0")
    return laid.select("capture_id", F.expr("cast(top + at div wide as int)").alias("row"), F.expr("cast(left + at % wide as int)").alias("col"), "room_id")


def dealt_charts(rooms: DataFrame) -> DataFrame:
    """``charts`` (of cells, if it is these) dealt to tasks by capture and their numbers of cells, for places that are few: what a task holds of them doesn't grow with the captures."""
    held = rooms if "rooms" in rooms.columns else charts(rooms)
    size = held.agg(F.sum(F.size("rooms"))).first()[0] or 0
    return held.repartition(max(rooms.sparkSession.sparkContext.defaultParallelism, -(-size // CHARTED)), "capture_id")


def in_rooms(places: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """Places (capture_id, row, col and others) with the room_id of their cell; those in no room go, or have none if ``how`` is "left". ``cells`` may be ``charts``.

    Places meet their home's chart by capture and look their cell up in it, so they are neither sorted nor dealt by cell.
    """
    chart = (cells if "rooms" in cells.columns else charts(cells)).select("capture_id", F.struct("top", "left", "wide", "rooms").alias("chart"))
    names = [c for c in places.columns if c != "room_id"]
    j = places.select(*names).join(keyed(chart), "capture_id", how)
    down, right = F.col("row") - F.col("chart.top"), F.col("col") - F.col("chart.left")
    room = F.when((down >= 0) & (right >= 0) & (right < F.col("chart.wide")), F.nullif(F.get("chart.rooms", (down * F.col("chart.wide") + right).cast("int")), F.lit(0)))
    told = j.select(*names, room.alias("room_id"))
    return told if how == "left" else told.where("room_id is not null")


def room_areas(cells: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return cells_of(cells).groupBy("capture_id", "room_id").agg((F.count("*") * p.grid**2).alias("area_rough"), F.avg("col").alias("mean_col"), F.avg("row").alias("mean_row"))


def polygon_area(corners: DataFrame, keys: list[str]) -> DataFrame:
    """Area of closed outlines x, z in order of k."""
    w = Window.partitionBy(*keys).orderBy("k")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    return corners.withColumns({"nx": nxt("x"), "nz": nxt("z")}).groupBy(*keys).agg((F.abs(F.sum(F.col("x") * F.col("nz") - F.col("nx") * F.col("z"))) / 2).alias("area"))


def polygon_cells(corners: DataFrame, keys: list[str], cell: float = 0.05) -> DataFrame:
    """Cells whose centre is inside a closed outline: an odd number of its edges lie to the right of it.

    Outlines are dealt to tasks. Of each row only the places where edges cross it are brought together; its cells are those between the last two of them, the two before, and so on.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    edges = dealt(corners, CORNERS, *keys).withColumns({"nx": nxt("x"), "nz": nxt("z"), "left": F.min("x").over(every)}).where("z <> nz")
    low, high = F.least("z", "nz"), F.greatest("z", "nz")
    rows = F.sequence(F.ceil(low / cell - 0.5).cast("int"), F.ceil(high / cell - 0.5).cast("int"))
    hit = edges.select(*keys, "x", "z", "nx", "nz", "left", F.explode(rows).alias("row"))
    at = (F.col("row") + 0.5) * cell
    hit = hit.where((at >= F.least("z", "nz")) & (at < F.greatest("z", "nz"))).withColumn("cross", F.col("x") + (at - F.col("z")) / (F.col("nz") - F.col("z")) * (F.col("nx") - F.col("x")))
    crossed = hit.groupBy(*keys, "row").agg(F.sort_array(F.collect_list("cross")).alias("at"), F.min("left").alias("left"))
    # with an odd number the row is inside from its first cell on
    ends = F.when(F.size("at") % 2 == 1, F.concat(F.array(F.floor(F.col("left") / cell) * cell), "at")).otherwise(F.col("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("ends") - 2, F.lit(2)), lambda i: F.struct(F.get("ends", i).alias("low"), F.get("ends", i + 1).alias("high")))
    spans = crossed.select(*keys, "row", ends.alias("ends")).select(*keys, "row", F.explode(pairs).alias("s")).select(*keys, "row", "s.*")
    cols = F.sequence((F.ceil(F.col("low") / cell - 0.5) - 1).cast("int"), F.ceil(F.col("high") / cell - 0.5).cast("int"))
    centre = (F.col("col") + 0.5) * cell
    return spans.select(*keys, "row", "low", "high", F.explode(cols).alias("col")).where((centre >= F.col("low")) & (centre < F.col("high"))).select(*keys, "row", "col")
