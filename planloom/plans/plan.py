"""Queries on plans: walls, gaps, rooms and their measures; on the homes of ``scene`` and on walls of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import points as pt
from ..operators import raster as rs
from ..operators import walls as wl
from ..storage import keyed, written
from . import scene
from .bind import query, rounded, table

C = F.col

# --- the homes, step by step -------------------------------------------------------------------------------------


def band_of(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """points, levels, wall band and its bounds."""
    levels = written(pt.horizontal_levels(p), "levels")
    bands = levels.select("capture_id", (C("floor_y") + 0.3).alias("low"), (C("ceiling_y") - 0.3).alias("high"))
    return p, levels, pt.wall_band(p, levels), bands


def _places(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Places of the homes' wall band, and its bounds."""
    _, _, band, bands = band_of(scene.points(spark, sf))
    return written(wl.columns(band, bands), "columns"), bands


def walls_of(spark: SparkSession, sf: str, p: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points, levels and walls of the homes, or of other points. Points are laid out again by all that reads them, and never written."""
    p, levels, band, bands = band_of(scene.points(spark, sf) if p is None else p)
    places = written(wl.columns(band, bands), "columns")
    # a few walls for each home, used by all that follows
    return p, levels, written(wl.find_walls(places, pt.wall_spikes(pt.strips(places)), bands), "walls")


@query("scene_levels", f"""WITH {scene.SCENE_SQL}, m AS (SELECT capture_id, min(y) AS low, median(y) AS middle FROM p GROUP BY 1), c AS (SELECT capture_id, middle, low + (floor((y-low)/0.02::DOUBLE)+0.5::DOUBLE)*0.02::DOUBLE AS centre, count(*) AS n FROM p JOIN m USING (capture_id) GROUP BY ALL)
SELECT capture_id, round(arg_max(centre, (n, -centre)) FILTER (centre < middle), 6) AS floor_y, round(arg_max(centre, (n, -centre)) FILTER (centre >= middle), 6) AS ceiling_y FROM c GROUP BY 1""")
def scene_levels(spark, sf):
    return rounded(pt.horizontal_levels(scene.points(spark, sf)))


_WALLS_FOUND = f"""WITH {scene.SCENE_SQL}, b AS (SELECT * FROM p WHERE y > 0.313::DOUBLE AND y < 2.2130000000000001::DOUBLE), a AS (SELECT capture_id, 'x' AS axis, x AS across, z AS along, y FROM b UNION ALL SELECT capture_id, 'z', z, x, y FROM b),
s AS (SELECT capture_id, axis, floor(round(across, 3)/0.02::DOUBLE)::BIGINT AS strip, count(*) AS n FROM a GROUP BY ALL), k AS (SELECT *, max(n) OVER (PARTITION BY capture_id, axis ORDER BY strip RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS most FROM s),
q AS (SELECT capture_id, axis, strip, (strip+0.5::DOUBLE)*0.02::DOUBLE AS centre FROM k WHERE n >= 500 AND n = most)"""


@query("scene_spikes", f"{_WALLS_FOUND} SELECT capture_id, axis, strip, round(centre, 6) AS centre FROM q")
def scene_spikes(spark, sf):
    return rounded(pt.wall_spikes(pt.strips(band_of(scene.points(spark, sf))[2])).select("capture_id", "axis", "strip", "centre"))


@query("wall_points_join", f"{_WALLS_FOUND} SELECT capture_id, axis, strip AS spike, count(*) AS n, round(median(across), 6) AS middle FROM q JOIN a USING (capture_id, axis) WHERE abs(across - centre) <= 0.03::DOUBLE GROUP BY ALL")
def wall_points_join(spark, sf):
    """Points within 3 cm of spikes."""
    places, _ = _places(spark, sf)
    near = wl.near_spikes(places, pt.wall_spikes(pt.strips(places)), 0.03)
    across = near.groupBy("capture_id", "axis", "spike", "across").agg(F.sum("k").alias("k"))
    return rounded(across.groupBy("capture_id", "axis", "spike").agg(F.sum("k").alias("n"), F.percentile("across", 0.5, C("k")).alias("middle")))


_RUNS = f"""{_WALLS_FOUND}, n AS (SELECT capture_id, axis, strip AS spike, centre, along, across, floor((y - 0.313::DOUBLE)/0.1::DOUBLE)::INT AS slice, floor(along/0.05::DOUBLE)::BIGINT AS cell FROM q JOIN a USING (capture_id, axis) WHERE abs(across - centre) <= 0.03::DOUBLE),
e AS (SELECT capture_id, axis, spike, cell, count(DISTINCT greatest(0, least(18, slice))) AS n FROM n GROUP BY ALL HAVING count(DISTINCT greatest(0, least(18, slice))) >= 9.5::DOUBLE),
g AS (SELECT *, CASE WHEN cell - lag(cell) OVER w > 7 OR lag(cell) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY capture_id, axis, spike ORDER BY cell)), u AS (SELECT *, sum(new) OVER (PARTITION BY capture_id, axis, spike ORDER BY cell ROWS UNBOUNDED PRECEDING) AS run FROM g),
f AS (SELECT capture_id, axis, spike, run, min(cell) AS first, max(cell) AS last FROM u GROUP BY ALL),
v AS (SELECT f.capture_id, f.axis, f.spike, f.run, f.first, f.last, count(DISTINCT slice) FILTER (slice BETWEEN 0 AND 18)/19.0::DOUBLE AS height_cover FROM f JOIN n ON f.capture_id = n.capture_id AND f.axis = n.axis AND f.spike = n.spike AND n.cell BETWEEN first AND last GROUP BY ALL),
r AS (SELECT * FROM v WHERE (last+1-first)*0.05::DOUBLE >= 0.4::DOUBLE - 1e-9 AND height_cover >= 0.6::DOUBLE)"""


@query("wall_runs", f"{_RUNS} SELECT capture_id, axis, spike, run::BIGINT AS run, first, last, round(height_cover, 6) AS height_cover FROM r")
def wall_runs(spark, sf):
    """Pieces of wall along spikes."""
    places, bands = _places(spark, sf)
    found = wl.runs(wl.near_spikes(places, pt.wall_spikes(pt.strips(places)), 0.03), bands)
    return rounded(found)


_FOUND = f"""{_RUNS}, m AS (SELECT r.capture_id, r.axis, r.spike, r.run, r.first, r.last, height_cover, median(across) AS position, count(*) AS points FROM r JOIN n ON r.capture_id = n.capture_id AND r.axis = n.axis AND r.spike = n.spike AND along >= first*0.05::DOUBLE AND along <= (last+1)*0.05::DOUBLE GROUP BY ALL),
t AS (SELECT m.*, across - position AS o FROM m JOIN a ON m.capture_id = a.capture_id AND m.axis = a.axis AND along >= first*0.05::DOUBLE AND along <= (last+1)*0.05::DOUBLE AND abs(across - position) <= 0.07::DOUBLE),
z AS (SELECT capture_id, axis, spike, run, first, last, height_cover, position, points, (count(*) FILTER (abs(o) <= 0.02::DOUBLE))/4.0::DOUBLE / greatest((count(*) FILTER (o BETWEEN -0.07::DOUBLE AND -0.04::DOUBLE))/3.0::DOUBLE, (count(*) FILTER (o BETWEEN 0.04::DOUBLE AND 0.07::DOUBLE))/3.0::DOUBLE, 1) AS prominence FROM t GROUP BY ALL),
walls AS (SELECT capture_id, (row_number() OVER (PARTITION BY capture_id ORDER BY axis, spike, run) - 1)::INT AS wall_idx, axis, round(position, 4) AS position, round(first*0.05::DOUBLE, 3) AS "start", round((last+1)*0.05::DOUBLE, 3) AS "end", round((last+1-first)*0.05::DOUBLE, 3) AS length, points, round(height_cover, 2) AS height_cover, round(prominence, 1) AS prominence FROM z WHERE prominence >= 1.5::DOUBLE)"""


@query("find_walls", f"{_FOUND} SELECT * FROM walls")
def find_walls(spark, sf):
    """All walls of each home."""
    return walls_of(spark, sf)[2]


def _home(spark, sf, points=None):
    """points with cells, levels, walls, gaps and room cells of the homes, on the grid that begins at 0."""
    *parts, charts = charted_home(spark, sf, points)
    return *parts, rs.cells_of(charts)


def charted_home(spark, sf, points=None):
    """The same with the rooms as charts, which are written in the cells' stead: one row a home."""
    p, levels, walls = walls_of(spark, sf, points)
    gaps = written(wl.find_gaps(walls), "gaps")
    p = p.withColumns({"row": F.floor(C("z") / 0.05).cast("int"), "col": F.floor(C("x") / 0.05).cast("int")})
    line = C("ax") == C("bx")
    shut = gaps.where("kind = 'wall'").select("capture_id", F.when(line, "x").otherwise("z").alias("axis"), F.when(line, C("ax")).otherwise(C("az")).alias("position"), F.when(line, F.least("az", "bz")).otherwise(F.least("ax", "bx")).alias("start"), F.when(line, F.greatest("az", "bz")).otherwise(F.greatest("ax", "bx")).alias("end"))
    return p, levels, walls, gaps, written(rs.find_charts(rs.floor_mask(p, levels), walls, shut), "rooms")


@query("scene_gaps", f"""{_FOUND}, eg AS (SELECT capture_id, wall_idx AS u, axis, position, "end" AS pos, 1 AS way FROM walls UNION ALL SELECT capture_id, wall_idx, axis, position, "start", -1 FROM walls),
jg AS (SELECT e.*, v.wall_idx AS v, CASE WHEN e.axis = v.axis AND abs(e.position - v.position) <= 0.15::DOUBLE THEN CASE WHEN way = 1 THEN v."start" ELSE v."end" END WHEN e.axis <> v.axis AND e.position >= v."start" - 0.15::DOUBLE AND e.position <= v."end" + 0.15::DOUBLE THEN v.position END AS target FROM eg e JOIN walls v ON e.capture_id = v.capture_id AND e.u <> v.wall_idx),
dg AS (SELECT *, way*(target - pos) AS width FROM jg), ng AS (SELECT * FROM dg WHERE width >= 0 AND width <= 1.2::DOUBLE QUALIFY row_number() OVER (PARTITION BY capture_id, u, way ORDER BY width, v) = 1),
gp AS (SELECT capture_id, u, way, CASE WHEN axis = 'x' THEN position ELSE pos END AS ax, CASE WHEN axis = 'x' THEN pos ELSE position END AS az, CASE WHEN axis = 'x' THEN position ELSE target END AS bx, CASE WHEN axis = 'x' THEN target ELSE position END AS bz, width FROM ng WHERE width > 0),
kp AS (SELECT *, [round(ax*10)::BIGINT, round(az*10)::BIGINT] AS a, [round(bx*10)::BIGINT, round(bz*10)::BIGINT] AS b FROM gp)
SELECT capture_id, round(ax, 3) AS ax, round(az, 3) AS az, round(bx, 3) AS bx, round(bz, 3) AS bz, round(width, 3) AS width, CASE WHEN width >= 0.6::DOUBLE THEN 'door' ELSE 'wall' END AS kind FROM kp QUALIFY row_number() OVER (PARTITION BY capture_id, least(a, b), greatest(a, b) ORDER BY u, way DESC) = 1""")
def scene_gaps(spark, sf):
    """Gaps between the homes' walls: a door in each, and where the inner wall's end is missing."""
    return wl.find_gaps(walls_of(spark, sf)[2])


@query("wall_prominence", f"{_FOUND} SELECT capture_id, axis, spike, run::BIGINT AS run, round(prominence, 6) AS prominence FROM z")
def wall_prominence(spark, sf):
    """How far runs stand out, those that don't included."""
    places, bands = _places(spark, sf)
    return rounded(wl.rated_runs(places, pt.wall_spikes(pt.strips(places)), bands).select("capture_id", "axis", "spike", "run", "prominence"))


def measured(home) -> tuple[DataFrame, DataFrame]:
    """Measured rooms and their heights, with the drift that their floors tell."""
    p, levels, walls, _, cells = home
    heights = written(wl.room_heights(p, cells, levels), "heights")
    return written(wl.measure_rooms(cells, wl.bounding_walls(walls, cells), wl.drift_of_floors(heights)), "measured"), heights


#: The homes' rooms as they were built, for DuckDB: the room of the first cell is the first.
TRUE_ROOMS = f"{scene.SCENE_SQL}, t AS (SELECT capture_id, unnest([1, 2]) AS room_id, unnest([wide*0.05::DOUBLE, 3.0::DOUBLE]) AS width, deep*0.05::DOUBLE AS length FROM h)"


@query("scene_rooms", f"WITH {TRUE_ROOMS} SELECT capture_id, room_id::INT AS room_id, 4::BIGINT AS sides, round(width, 4) AS width, round(length, 4) AS length, round(width*length, 4) AS floor_area, 'rectangular' AS shape FROM t")
def scene_rooms(spark, sf):
    """Rooms of the homes with sides, sizes and areas, as they were built."""
    rooms, _ = measured(charted_home(spark, sf))
    return rounded(rooms.select("capture_id", "room_id", "sides", "width", "length", "floor_area", "shape"), 4)


@query("measure_rooms")
def measure_rooms(spark, sf):
    """Rooms of the homes with all ranges and the positions of their sides."""
    return rounded(measured(charted_home(spark, sf))[0], 4)


@query("bounding_walls", f"WITH {TRUE_ROOMS}, s(axis, side) AS (VALUES ('x', 'low'), ('x', 'high'), ('z', 'low'), ('z', 'high')) SELECT t.capture_id, room_id::INT AS room_id, axis, side, round(CASE WHEN axis = 'x' THEN 0.005::DOUBLE + 0.05::DOUBLE*(CASE WHEN room_id = 1 THEN 0 ELSE wide END + CASE WHEN side = 'high' THEN CASE WHEN room_id = 1 THEN wide ELSE 60 END ELSE 0 END) ELSE 0.005::DOUBLE + CASE WHEN side = 'high' THEN length ELSE 0 END END, 4) AS position FROM t JOIN h ON h.capture_id = t.capture_id CROSS JOIN s")
def bounding_walls(spark, sf):
    """The walls that bound the homes' rooms, as they were built."""
    _, _, walls, _, cells = charted_home(spark, sf)
    return rounded(wl.bounding_walls(walls, cells).select("capture_id", "room_id", "axis", "side", "position"), 4)


@query("wall_rooms", f"WITH {TRUE_ROOMS} SELECT capture_id, room_id::INT AS room_id, CASE WHEN room_id = 1 THEN 5 ELSE 5 END::BIGINT AS n FROM t")
def wall_rooms(spark, sf):
    """How many walls touch each of the homes' rooms: four outer ones less that of the other room, and both pieces of the one between them."""
    _, _, walls, _, cells = charted_home(spark, sf)
    return wl.touched_rooms(walls, cells).groupBy("capture_id", "room_id").agg(F.count("*").alias("n"))


@query("point_room", f"WITH {scene.SCENE_SQL} SELECT p.capture_id, CASE WHEN x < wide*0.05::DOUBLE THEN 1 ELSE 2 END::INT AS room_id, count(*) AS n FROM p JOIN h USING (capture_id) WHERE y > 2.4::DOUBLE AND x > 0.3::DOUBLE AND abs(x - wide*0.05::DOUBLE) > 0.3::DOUBLE AND x < wide*0.05::DOUBLE + 2.7::DOUBLE AND z > 0.3::DOUBLE AND z < deep*0.05::DOUBLE - 0.3::DOUBLE GROUP BY ALL")
def point_room(spark, sf):
    """Ceiling points well inside the homes' rooms, by room."""
    p, _, _, _, cells = charted_home(spark, sf)
    h = scene.homes(spark, sf)
    w, d = C("wide") * 0.05, C("deep") * 0.05
    well = p.join(keyed(h), "capture_id").where((C("y") > 2.4) & (C("x") > 0.3) & (F.abs(C("x") - w) > 0.3) & (C("x") < w + 2.7) & (C("z") > 0.3) & (C("z") < d - 0.3))
    return rs.in_rooms(well, cells).groupBy("capture_id", "room_id").agg(F.count("*").alias("n"))


@query("scene_heights", f"WITH {TRUE_ROOMS} SELECT capture_id, room_id::INT AS room_id, 0.003::DOUBLE AS floor_y, 2.503::DOUBLE AS ceiling_y, NULL::DOUBLE AS other_y, NULL::VARCHAR AS note FROM t")
def scene_heights(spark, sf):
    """Floors and ceilings of the homes' rooms, as they were built."""
    p, levels, _, _, cells = charted_home(spark, sf)
    return rounded(wl.room_heights(p, cells, levels).select("capture_id", "room_id", "floor_y", "ceiling_y", "other_y", "note"))


@query("room_heights")
def room_heights(spark, sf):
    """Floors and ceilings of the homes' rooms, with how much of them was seen, and heights with their ranges."""
    p, levels, _, _, cells = charted_home(spark, sf)
    heights = written(wl.room_heights(p, cells, levels), "heights")
    tall = wl.ceiling_heights(heights, wl.drift_of_floors(heights)).drop("note")
    return rounded(heights.join(keyed(tall), ["capture_id", "room_id"]))


def numbered_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("gap_idx", F.row_number().over(Window.partitionBy("capture_id").orderBy("ax", "az", "bx", "bz")).cast("int"))


@query("door_rooms", f"WITH {scene.SCENE_SQL} SELECT capture_id, unnest(CASE WHEN capture_id % 4 = 1 THEN [1, 2] ELSE [1] END)::INT AS gap_idx, [1, 2]::INT[] AS rooms FROM h")
def door_rooms(spark, sf):
    """Rooms on both sides of the homes' doors, of which one is the missing end of a wall in some."""
    _, _, _, gaps, cells = charted_home(spark, sf)
    return wl.door_rooms(numbered_gaps(gaps), cells)


@query("scene_adjacency", f"WITH {scene.SCENE_SQL} SELECT capture_id, 1::INT AS a, 2::INT AS b, unnest(CASE WHEN capture_id % 4 = 1 THEN [1, 2] ELSE [1] END)::INT AS via FROM h")
def scene_adjacency(spark, sf):
    """Rooms that a door joins."""
    _, _, _, gaps, cells = charted_home(spark, sf)
    return wl.adjacency(wl.door_rooms(numbered_gaps(gaps), cells))


@query("wall_spread", f"{_FOUND}, sp AS (SELECT w.capture_id, wall_idx, stddev_pop(across - position) AS spread FROM walls w JOIN (SELECT capture_id, 'x' AS axis, x AS across, z AS along FROM p UNION ALL SELECT capture_id, 'z', z, x FROM p) a ON w.capture_id = a.capture_id AND w.axis = a.axis AND abs(across - position) <= 0.05::DOUBLE AND along BETWEEN \"start\" AND \"end\" WHERE length >= 1 GROUP BY ALL HAVING count(*) > 100) SELECT capture_id, round(median(spread), 6) AS wall_spread, count(*) AS walls FROM sp GROUP BY 1")
def wall_spread(spark, sf):
    p, _, walls = walls_of(spark, sf)
    return rounded(wl.wall_spread(walls, p))


# --- walls of the test tables -------------------------------------------------------------------------------------

_W = """w AS (SELECT c_custkey // 30 AS capture_id, (c_custkey % 30)::INT AS wall_idx, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'z' END AS axis, round((c_custkey * 37 % 23)/20.0::DOUBLE + (c_custkey % 3)*0.013::DOUBLE, 4) AS position, c_nationkey/8.0::DOUBLE AS "start", c_nationkey/8.0::DOUBLE + 0.5::DOUBLE + (c_custkey % 7)/2.0::DOUBLE AS "end", 0.5::DOUBLE + (c_custkey % 7)/2.0::DOUBLE AS length, 1000 + c_custkey % 50 AS points FROM customer)"""


def _walls(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    k = C("c_custkey")
    start, length = C("c_nationkey") / 8.0, 0.5 + (k % 7) / 2.0
    return c.select(F.floor(k / 30).cast("long").alias("capture_id"), (k % 30).cast("int").alias("wall_idx"), F.when(k % 2 == 0, "x").otherwise("z").alias("axis"), F.round((k * 37 % 23) / 20.0 + (k % 3) * 0.013, 4).alias("position"), start.alias("start"), (start + length).alias("end"), length.alias("length"), (1000 + k % 50).alias("points"))


@query("find_gaps", f"""WITH {_W}, e AS (SELECT capture_id, wall_idx AS u, axis, position, "end" AS pos, 1 AS way FROM w UNION ALL SELECT capture_id, wall_idx, axis, position, "start", -1 FROM w),
j AS (SELECT e.*, v.wall_idx AS v, CASE WHEN e.axis = v.axis AND abs(e.position - v.position) <= 0.15::DOUBLE THEN CASE WHEN way = 1 THEN v."start" ELSE v."end" END WHEN e.axis <> v.axis AND e.position >= v."start" - 0.15::DOUBLE AND e.position <= v."end" + 0.15::DOUBLE THEN v.position END AS target FROM e JOIN w v ON e.capture_id = v.capture_id AND e.u <> v.wall_idx),
d AS (SELECT *, way*(target - pos) AS width FROM j), n AS (SELECT * FROM d WHERE width >= 0 AND width <= 1.2::DOUBLE QUALIFY row_number() OVER (PARTITION BY capture_id, u, way ORDER BY width, v) = 1),
g AS (SELECT capture_id, u, way, CASE WHEN axis = 'x' THEN position ELSE pos END AS ax, CASE WHEN axis = 'x' THEN pos ELSE position END AS az, CASE WHEN axis = 'x' THEN position ELSE target END AS bx, CASE WHEN axis = 'x' THEN target ELSE position END AS bz, width FROM n WHERE width > 0),
k AS (SELECT *, [round(ax*10)::BIGINT, round(az*10)::BIGINT] AS a, [round(bx*10)::BIGINT, round(bz*10)::BIGINT] AS b FROM g)
SELECT capture_id, round(ax, 3) AS ax, round(az, 3) AS az, round(bx, 3) AS bx, round(bz, 3) AS bz, round(width, 3) AS width, CASE WHEN width >= 0.6::DOUBLE THEN 'door' ELSE 'wall' END AS kind FROM k QUALIFY row_number() OVER (PARTITION BY capture_id, least(a, b), greatest(a, b) ORDER BY u, way DESC) = 1""")
def find_gaps(spark, sf):
    return wl.find_gaps(_walls(spark, sf))


@query("double_walls", f"WITH {_W} SELECT a.capture_id, a.axis, a.wall_idx AS i, b.wall_idx AS j, round(abs(a.position - b.position), 6) AS distance FROM w a JOIN w b ON a.capture_id = b.capture_id AND a.axis = b.axis AND a.wall_idx < b.wall_idx WHERE abs(a.position - b.position) BETWEEN 0.02::DOUBLE AND 0.08::DOUBLE AND least(a.\"end\", b.\"end\") - greatest(a.\"start\", b.\"start\") >= 0.5::DOUBLE")
def double_walls(spark, sf):
    return rounded(wl.double_walls(_walls(spark, sf)))


_TWO = f"WITH {_W}, b AS (SELECT capture_id, (29 - wall_idx)::INT AS wall_idx, axis, position + ((wall_idx * 7 % 11) - 5)*0.0131::DOUBLE AS position, \"start\" + 0.1::DOUBLE AS \"start\", \"end\" FROM w)"


def _other(w: DataFrame) -> DataFrame:
    return w.select("capture_id", (29 - C("wall_idx")).cast("int").alias("wall_idx"), "axis", (C("position") + ((C("wall_idx") * 7 % 11) - 5) * 0.0131).alias("position"), (C("start") + 0.1).alias("start"), "end")


@query("wall_match", f"""{_TWO}, m AS (SELECT w.capture_id, w.axis, w.wall_idx AS i, b.wall_idx AS j, b.position - w.position AS diff FROM w JOIN b ON w.capture_id = b.capture_id AND w.axis = b.axis WHERE abs(w.position - b.position) <= 0.1::DOUBLE AND least(w."end", b."end") - greatest(w."start", b."start") >= 0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY w.capture_id, w.axis, w.wall_idx ORDER BY abs(diff), b.wall_idx) = 1)
SELECT capture_id, axis, i, j, round(diff - median(diff) OVER (PARTITION BY capture_id, axis), 6) + 0.0 AS diff FROM m""")
def wall_match(spark, sf):
    """Walls of two plans that match, with what is left of their differences."""
    w = _walls(spark, sf)
    return rounded(wl.match_walls(w, _other(w)))


@query("wall_lines", f"WITH {_W} SELECT DISTINCT capture_id, axis, round(position, 1) AS position FROM w")
def wall_lines(spark, sf):
    return wl.wall_lines(_walls(spark, sf))


_RC = "c AS (SELECT o_custkey // 100 AS capture_id, (o_orderkey % 40)::INT AS row, ((o_orderkey // 40 + o_custkey) % 40)::INT AS col FROM orders GROUP BY ALL)"


def _marks(spark, sf) -> DataFrame:
    """A capture of cells for each hundred customers."""
    o, k = C("o_orderkey"), C("o_custkey")
    return table(spark, sf, "orders").select(F.floor(k / 100).cast("long").alias("capture_id"), (o % 40).cast("int").alias("row"), ((F.floor(o / 40) + k) % 40).cast("int").alias("col")).distinct()


def _kernel(k) -> str:
    return ", ".join(f"({i}, {j})" for i, j in k)


_DIL = "SELECT DISTINCT capture_id, row + i AS row, col + j AS col FROM {src} CROSS JOIN k"
_ERO = "SELECT capture_id, row - i AS row, col - j AS col FROM {src} CROSS JOIN k GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM k)"


@query("morph_close", f"WITH {_RC}, k(i, j) AS (VALUES {_kernel(rs.ellipse(3))}), d AS ({_DIL.format(src='c')}) {_ERO.format(src='d')}")
def morph_close(spark, sf):
    return rs.close(_marks(spark, sf), rs.ellipse(3))


@query("morph_open", f"WITH {_RC}, k(i, j) AS (VALUES {_kernel(rs.square(3))}), d AS ({_ERO.format(src='c')}) {_DIL.format(src='d')}")
def morph_open(spark, sf):
    return rs.open_(_marks(spark, sf), rs.square(3))


@query("morph_erode", f"WITH {_RC}, k(i, j) AS (VALUES {_kernel(rs.ellipse(3))}) {_ERO.format(src='c')}")
def morph_erode(spark, sf):
    return rs.erode(_marks(spark, sf), rs.ellipse(3))


_COMP = f"""WITH RECURSIVE {_RC}, e AS MATERIALIZED (SELECT a.capture_id, a.row*1000+a.col AS x, b.row*1000+b.col AS y FROM c a JOIN c b ON a.capture_id = b.capture_id AND abs(a.row-b.row) + abs(a.col-b.col) = 1),
r AS (SELECT capture_id, row*1000+col AS x, row*1000+col AS y FROM c UNION SELECT r.capture_id, r.x, e.y FROM r JOIN e ON r.capture_id = e.capture_id AND r.y = e.x), m AS (SELECT capture_id, x, min(y) AS f FROM r GROUP BY ALL)"""


@query("connected_components", f"{_COMP} SELECT capture_id, (x // 1000)::INT AS row, (x % 1000)::INT AS col, dense_rank() OVER (PARTITION BY capture_id ORDER BY f)::INT AS component_id FROM m")
def connected_components(spark, sf):
    """Components of cells, numbered by their first cells."""
    return rs.components(_marks(spark, sf))


@query("geodesic_grow")
def geodesic_grow(spark, sf):
    """Free cells by their nearest seed."""
    m = _marks(spark, sf)
    seeds = m.where("row % 13 = 0 and col % 11 = 0").withColumn("room_id", (C("row") + C("col")).cast("int"))
    return rs.grow(m, seeds)


@query("room_cells")
def room_cells(spark, sf):
    """Rooms with their holes filled."""
    m = _marks(spark, sf)
    return rs.fill_rooms(rs.components(m).withColumnRenamed("component_id", "room_id"), m.where("row = 7").select("capture_id", "row", "col"), min_area=0.02)


@query("barrier_cells", f"WITH {_W}, s AS (SELECT capture_id, axis, floor(position/0.05::DOUBLE)::INT AS pos, unnest(range(floor((\"start\" - 0.15::DOUBLE)/0.05::DOUBLE)::INT, floor((\"end\" + 0.15::DOUBLE)/0.05::DOUBLE)::INT + 1)) AS k FROM w), t AS (SELECT capture_id, axis, k, unnest([pos - 1, pos]) AS a FROM s) SELECT DISTINCT capture_id, (CASE WHEN axis = 'x' THEN k ELSE a END)::INT AS row, (CASE WHEN axis = 'x' THEN a ELSE k END)::INT AS col FROM t")
def barrier_cells(spark, sf):
    return rs.barrier(_walls(spark, sf))


@query("floor_mask", f"WITH {_RC}, p AS (SELECT capture_id, row, col, (row*7 + col*3) % 11/20.0::DOUBLE AS y FROM c), f AS (SELECT capture_id, 0.2::DOUBLE AS floor_y FROM p GROUP BY 1) SELECT DISTINCT capture_id, row, col FROM p JOIN f USING (capture_id) WHERE y >= floor_y - 0.08::DOUBLE")
def floor_mask(spark, sf):
    p = _marks(spark, sf).withColumn("y", (C("row") * 7 + C("col") * 3) % 11 / 20.0)
    return rs.floor_mask(p, p.select("capture_id").distinct().withColumn("floor_y", F.lit(0.2)))


_OUT = "o AS (SELECT p_partkey AS room, unnest([0,1,2,3]) AS k, p_size/10.0::DOUBLE AS a, p_retailprice/997 AS b FROM part), c AS (SELECT room, k, CASE WHEN k IN (1, 2) THEN a + 0.31::DOUBLE ELSE 0.013::DOUBLE END AS x, CASE WHEN k >= 2 THEN b ELSE 0.027::DOUBLE END AS z FROM o)"


def _outlines(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").select(C("p_partkey").alias("room"), (C("p_size") / 10.0).alias("a"), (C("p_retailprice") / 997).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return p.select("room", "k", F.when(C("k").isin(1, 2), C("a") + 0.31).otherwise(0.013).alias("x"), F.when(C("k") >= 2, C("b")).otherwise(0.027).alias("z"))


@query("polygon_area", f"WITH {_OUT}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(z) OVER w, first_value(z) OVER w) AS nz FROM c WINDOW w AS (PARTITION BY room ORDER BY k)) SELECT room, round(abs(sum(x*nz - nx*z))/2, 6) AS area FROM n GROUP BY 1")
def polygon_area(spark, sf):
    return rounded(rs.polygon_area(_outlines(spark, sf), ["room"]))


@query("polygon_cells", f"WITH {_OUT}, b AS (SELECT room, max(x) AS x, max(z) AS z FROM c GROUP BY 1), r AS (SELECT room, x, z, unnest(range(0, ceil(z/0.05::DOUBLE)::INT + 1)) AS row FROM b), q AS (SELECT room, x, z, row, unnest(range(0, ceil(x/0.05::DOUBLE)::INT + 1)) AS col FROM r) SELECT room, row::INT AS row, col::INT AS col FROM q WHERE (col+0.5::DOUBLE)*0.05::DOUBLE > 0.013::DOUBLE AND (col+0.5::DOUBLE)*0.05::DOUBLE < x AND (row+0.5::DOUBLE)*0.05::DOUBLE > 0.027::DOUBLE AND (row+0.5::DOUBLE)*0.05::DOUBLE < z")
def polygon_cells(spark, sf):
    """Cells inside the outlines."""
    return rs.polygon_cells(_outlines(spark, sf), ["room"])
