"""Queries that aggregate points, frames and measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import evaluation as ev
from ..operators import frames as fr
from ..operators import points as pt
from ..params import Params
from ..storage import dealt
from . import scene
from .bind import FRAMES_SQL, POINTS_SQL, VECTORS_SQL, frames, points, query, rounded, table, vectors

C = F.col


def _voxels(keys: str) -> str:
    means = ", ".join(f"round(sum({c}*w)/sum(w), 6) AS {c}" for c in "xyzrgb")
    return f"SELECT {keys}, floor(x/0.02::DOUBLE)::BIGINT AS vx, floor(y/0.02::DOUBLE)::BIGINT AS vy, floor(z/0.02::DOUBLE)::BIGINT AS vz, {means}, sum(w) AS w FROM p WHERE w > 0 GROUP BY ALL"


@query("voxel_downsample", f"WITH {POINTS_SQL} {_voxels('capture_id')}")
def voxel_downsample(spark, sf):
    return rounded(pt.voxel_downsample(points(spark, sf)))


@query("fuse_chunks", f"WITH {POINTS_SQL} {_voxels('capture_id, chunk')}")
def fuse_chunks(spark, sf):
    """Voxels of each chunk of a capture."""
    return rounded(pt.voxel_downsample(points(spark, sf), ["capture_id", "chunk"]))


_LEVELS = """m AS (SELECT capture_id, min(y) AS low, median(y) AS middle FROM p GROUP BY 1), h AS (SELECT capture_id, low, middle, floor((y - low)/0.02::DOUBLE)::BIGINT AS bin, count(*) AS n FROM p JOIN m USING (capture_id) GROUP BY ALL),
c AS (SELECT *, low + (bin + 0.5::DOUBLE)*0.02::DOUBLE AS centre FROM h),
f AS (SELECT capture_id, centre AS fc, n AS fn FROM c WHERE centre < middle QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin) = 1),
t AS (SELECT capture_id, centre AS tc, n AS tn FROM c WHERE centre >= middle QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin) = 1)"""


@query("horizontal_levels", f"WITH {POINTS_SQL}, {_LEVELS} SELECT capture_id, round(fc, 6) AS floor_y, round(CASE WHEN tn >= 0.2::DOUBLE*fn AND tc - fc >= 1.8::DOUBLE THEN tc END, 6) AS ceiling_y FROM f LEFT JOIN t USING (capture_id)")
def horizontal_levels(spark, sf):
    return rounded(pt.horizontal_levels(points(spark, sf)))


_STRIPS = """k AS (SELECT capture_id, round(x, 3) AS x, round(z, 3) AS z, count(*) AS k FROM p GROUP BY ALL), a AS (SELECT i * {step}::DOUBLE AS angle FROM range({n}) r(i)),
t AS (SELECT capture_id, angle, k, cos(radians(angle))*x + sin(radians(angle))*z AS tx, cos(radians(angle))*z - sin(radians(angle))*x AS tz FROM k CROSS JOIN a),
s AS (SELECT capture_id, angle, axis, strip, sum(k) AS n FROM (SELECT capture_id, angle, k, 'x' AS axis, floor(tx/0.02::DOUBLE)::BIGINT AS strip FROM t UNION ALL SELECT capture_id, angle, k, 'z', floor(tz/0.02::DOUBLE)::BIGINT FROM t) GROUP BY ALL)"""


@query("spikiness", f"WITH {POINTS_SQL}, {_STRIPS.format(step=15, n=6)} SELECT capture_id, angle, round(sum(n*n)::DOUBLE / ((sum(n)/2.0::DOUBLE)*(sum(n)/2.0::DOUBLE)), 6) AS spikiness FROM s GROUP BY 1, 2")
def spikiness(spark, sf):
    p = dealt(points(spark, sf), pt.POINTS, "capture_id")
    return rounded(pt.spikiness(pt.strips(p, pt.angle_table(p, 0.0, 15.0, 6))))


@query("find_rotation", "SELECT s_suppkey AS capture_id, true AS found FROM supplier")
def find_rotation(spark, sf):
    """Whether a coarse and a fine search find the turn of each home, a different one for each, to a tenth of a degree."""
    turn = C("capture_id") * 37 % 1790 / 20.0
    x, z = g.rotate_about_vertical(C("x"), C("z"), -turn)
    turned = scene.points(spark, sf).where("y > 0.3 and y < 2.2").select("capture_id", x.alias("x"), "y", z.alias("z"))
    off = F.abs(F.pmod(C("angle") - turn + 45, F.lit(90.0)) - 45)
    return pt.find_rotation(turned).select("capture_id", (off <= 0.1).alias("found"))


@query("wall_spikes", f"""WITH {POINTS_SQL}, {_STRIPS.format(step=1, n=1)}, m AS (SELECT *, max(n) OVER (PARTITION BY capture_id, axis ORDER BY strip RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS most FROM s)
SELECT capture_id, axis, strip, n::BIGINT AS n, round((strip + 0.5::DOUBLE)*0.02::DOUBLE, 6) AS centre FROM m WHERE n >= 5 AND n = most""")
def wall_spikes(spark, sf):
    return rounded(pt.wall_spikes(pt.strips(dealt(points(spark, sf), pt.POINTS, "capture_id")), Params(min_peak_points=5)))


@query("floor_cells", f"WITH {POINTS_SQL} SELECT capture_id, chunk, floor(x/0.1::DOUBLE)::BIGINT AS fx, floor(z/0.1::DOUBLE)::BIGINT AS fz, round(avg(y), 6) AS y, count(*) AS n FROM p WHERE y < 0.3::DOUBLE GROUP BY ALL")
def floor_cells(spark, sf):
    return rounded(pt.floor_cells(points(spark, sf).where("y < 0.3"), ["capture_id", "chunk"]))


@query("height_offset", f"""WITH {POINTS_SQL}, c AS (SELECT capture_id, chunk, floor(x/0.1::DOUBLE)::BIGINT AS fx, floor(z/0.1::DOUBLE)::BIGINT AS fz, avg(y) AS y FROM p WHERE y < 1.3::DOUBLE GROUP BY ALL),
b AS (SELECT a.capture_id, b.chunk, a.y - b.y AS d FROM c a JOIN c b USING (capture_id, fx, fz) WHERE a.chunk = 0 AND b.chunk > 0)
SELECT capture_id, chunk, count(*) AS n_cells, CASE WHEN count(*) >= 50 THEN round(median(d), 6) + 0.0 END AS "offset" FROM b GROUP BY ALL""")
def height_offset(spark, sf):
    """Heights of chunks against the plan of the first, where they share enough floor."""
    cells = pt.floor_cells(points(spark, sf).where("y < 1.3"), ["capture_id", "chunk"])
    return rounded(pt.height_offset(cells.where("chunk = 0"), cells.where("chunk > 0")))


_CELLS = "o AS (SELECT capture_id, min(x) - 0.2::DOUBLE AS ox, min(z) - 0.2::DOUBLE AS oz FROM p GROUP BY 1), c AS (SELECT p.*, trunc((z-oz)/0.05::DOUBLE)::INT AS row, trunc((x-ox)/0.05::DOUBLE)::INT AS col FROM p JOIN o USING (capture_id))"


@query("topdown_colour", f"WITH {POINTS_SQL}, {_CELLS} SELECT capture_id, row, col, r, g, b FROM c QUALIFY row_number() OVER (PARTITION BY capture_id, row, col ORDER BY y DESC, ord DESC, line DESC) = 1")
def topdown_colour(spark, sf):
    return pt.top_colour(pt.with_cells(points(spark, sf)))


@query("topdown_density", f"WITH {POINTS_SQL}, {_CELLS}, n AS (SELECT capture_id, row, col, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT capture_id, quantile_cont(n, 0.95) AS top FROM n GROUP BY 1) SELECT capture_id, row, col, round(least(1, n/top), 6) AS density FROM n JOIN t USING (capture_id)")
def topdown_density(spark, sf):
    return rounded(pt.density(pt.with_cells(points(spark, sf))))


@query("room_areas", f"WITH {POINTS_SQL}, {_CELLS}, d AS (SELECT DISTINCT capture_id, chunk, row, col FROM c) SELECT capture_id, chunk AS room_id, round(count(*)*0.0025::DOUBLE, 6) AS area_rough, round(avg(col), 6) AS mean_col, round(avg(row), 6) AS mean_row FROM d GROUP BY ALL")
def room_areas(spark, sf):
    """Area and centre of rooms from their cells."""
    from ..operators import raster as rs

    cells = pt.with_cells(points(spark, sf)).select("capture_id", C("chunk").alias("room_id"), "row", "col").distinct()
    return rounded(rs.room_areas(cells))


@query("drift_sigma", "SELECT c_nationkey AS capture_id, CASE WHEN count(*) FILTER (n >= 3) > 1 THEN greatest(0.003::DOUBLE, (max(floor_y) FILTER (n >= 3) - min(floor_y) FILTER (n >= 3))/2) ELSE 0.003::DOUBLE END AS drift_sigma FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal)/1e5, 6) AS floor_y FROM customer GROUP BY ALL) GROUP BY 1")
def drift_sigma(spark, sf):
    """Half the spread of the floors of a capture's rooms that have enough points."""
    rooms = table(spark, sf, "customer").groupBy(C("c_nationkey").alias("capture_id"), "c_mktsegment").agg(F.count("*").alias("floor_points"), F.round(F.avg("c_acctbal") / 1e5, 6).alias("floor_y"))
    return ev.drift_sigma(rooms, least=3)


_RATIO = "r AS (SELECT l_suppkey AS piece, l_shipdate::DATE AS frame, l_extendedprice / (l_quantity*997) AS ratio FROM lineitem)"


def _ratios(spark, sf):
    return table(spark, sf, "lineitem").select(C("l_suppkey").alias("piece"), C("l_shipdate").cast("date").alias("frame"), (C("l_extendedprice") / (C("l_quantity") * 997)).alias("ratio"))


@query("scale_median_of_medians", f"WITH {_RATIO}, m AS (SELECT piece, frame, median(ratio) AS m, count(*) AS n FROM r GROUP BY ALL) SELECT piece, CASE WHEN sum(n) >= 20 THEN round(median(m)/1.35::DOUBLE, 6) END AS scale FROM m GROUP BY 1")
def scale_median_of_medians(spark, sf):
    """Metres per unit of a piece: the median of its frames' median ratios."""
    return rounded(ev.piece_scale(_ratios(spark, sf)))


@query("ratio_spread", f"WITH {_RATIO} SELECT piece, round(stddev_pop(ratio)/avg(ratio), 6) AS spread FROM r GROUP BY 1")
def ratio_spread(spark, sf):
    return rounded(_ratios(spark, sf).groupBy("piece").agg((F.stddev_pop("ratio") / F.avg("ratio")).alias("spread")))


@query("depth_error", f"WITH {_RATIO}, s AS (SELECT piece, median(ratio) AS scale FROM r GROUP BY 1), m AS (SELECT piece, frame, median(ratio) AS m FROM r GROUP BY ALL), d AS (SELECT piece, stddev_pop(m) AS wobble FROM m GROUP BY 1), e AS (SELECT piece, avg(abs(ratio-1)) AS raw, avg(abs(ratio/scale-1)) AS scaled FROM r JOIN s USING (piece) GROUP BY 1) SELECT piece, round(raw, 6) AS raw, round(scaled, 6) AS scaled, round(scale, 6) AS scale, round(wobble, 6) AS wobble FROM e JOIN s USING (piece) JOIN d USING (piece)")
def depth_error(spark, sf):
    """Relative depth errors before and after one scale, and how much frames differ."""
    return rounded(ev.depth_error(_ratios(spark, sf)))


@query("sharpest_per_window", f"WITH {FRAMES_SQL}, n AS (SELECT capture_id, count(*) AS n FROM f GROUP BY 1), w AS (SELECT f.*, ((frame+1)*5-1)//n AS w FROM f JOIN n USING (capture_id)) SELECT capture_id, w AS \"window\", frame FROM w QUALIFY row_number() OVER (PARTITION BY capture_id, w ORDER BY score DESC, frame) = 1")
def sharpest_per_window(spark, sf):
    return fr.sharpest(frames(spark, sf), 5)


@query("chunk_tumbling", f"WITH {FRAMES_SQL}, c AS (SELECT capture_id, floor((ts - min(ts) OVER (PARTITION BY capture_id))/20.0::DOUBLE)::BIGINT AS chunk, frame FROM f) SELECT capture_id, chunk, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM c GROUP BY ALL")
def chunk_tumbling(spark, sf):
    return fr.chunks(frames(spark, sf)).groupBy("capture_id", "chunk").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("stay_ntile", f"WITH {FRAMES_SQL} SELECT capture_id, frame, ntile(8) OVER (PARTITION BY capture_id ORDER BY frame) AS part FROM f")
def stay_ntile(spark, sf):
    """A stay's frames in eight parts."""
    return frames(spark, sf).select("capture_id", "frame", F.ntile(8).over(Window.partitionBy("capture_id").orderBy("frame")).cast("long").alias("part"))


_STAYS = f"WITH {FRAMES_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > 3600 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY capture_id ORDER BY ts, frame)), s AS (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY ts, frame ROWS UNBOUNDED PRECEDING) AS stay FROM g)"


@query("longest_stay", f"{_STAYS}, l AS (SELECT capture_id, stay::BIGINT AS stay, count(*) AS n, min(ts) AS \"begin\", max(ts) AS \"end\" FROM s GROUP BY ALL) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, stay) = 1")
def longest_stay(spark, sf):
    return fr.longest_stay(frames(spark, sf), 3600)


_CROSS = f"WITH {FRAMES_SQL}, r AS (SELECT capture_id, frame, score, CASE WHEN kind <> 'view' THEN kind END AS room FROM f), b AS (SELECT *, last_value(room IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r), x AS (SELECT * FROM b WHERE room IS NOT NULL AND before IS NOT NULL AND room <> before)"


def _rooms(spark, sf):
    return frames(spark, sf).select("capture_id", "frame", "score", F.when(C("kind") != "view", C("kind")).alias("room"))


@query("room_crossings", f"{_CROSS} SELECT capture_id, frame, room, before FROM x")
def room_crossings(spark, sf):
    return fr.crossings(_rooms(spark, sf)).select("capture_id", "frame", "room", "before")


@query("crossing_best", f"{_CROSS}, m AS (SELECT capture_id, frame AS pos, least(room, before) AS a, greatest(room, before) AS b FROM x) SELECT m.capture_id, a, b, r.frame FROM m JOIN r ON r.capture_id = m.capture_id AND r.frame >= pos - 3 AND r.frame < pos + 3 QUALIFY row_number() OVER (PARTITION BY m.capture_id, a, b ORDER BY r.score DESC, r.frame) = 1")
def crossing_best(spark, sf):
    r = _rooms(spark, sf)
    return fr.best_crossing(fr.crossings(r), r, 3)


@query("linspace_pick", f"WITH {FRAMES_SQL}, n AS (SELECT capture_id, count(*) AS n FROM f GROUP BY 1), k AS (SELECT DISTINCT capture_id, (i*(n-1))//4 AS frame FROM n CROSS JOIN range(5) t(i)) SELECT capture_id, frame, event_id FROM f JOIN k USING (capture_id, frame)")
def linspace_pick(spark, sf):
    return fr.even_picks(frames(spark, sf), 5).select("capture_id", "frame", "event_id")


@query("path_error", f"WITH {FRAMES_SQL}, {VECTORS_SQL}, p AS (SELECT label, vec_id, e1, e2, e3, sqrt((e1-e4)*(e1-e4)+(e2-e5)*(e2-e5)+(e3-e6)*(e3-e6)) AS err FROM v), d AS (SELECT *, sqrt(power(e1-lag(e1) OVER w,2)+power(e2-lag(e2) OVER w,2)+power(e3-lag(e3) OVER w,2)) AS step FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, round(sum(step), 6) AS length, round(sqrt(avg(err*err)), 6) AS rms, round(max(err), 6) AS worst, round(100*sqrt(avg(err*err))/sum(step), 6) AS percent FROM d GROUP BY 1")
def path_error(spark, sf):
    """Length of a path, and the root mean square and greatest error of another against it."""
    v = vectors(spark, sf).select(C("label"), C("vec_id").alias("frame"), C("e1").alias("x"), C("e2").alias("y"), C("e3").alias("z"), C("e4").alias("xx"), C("e5").alias("yy"), C("e6").alias("zz"))
    return rounded(ev.path_error(v, ["label"]))


@query("largest_per_group", "SELECT n_regionkey, n_nationkey, n FROM (SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, n_nationkey) = 1")
def largest_per_group(spark, sf):
    """The largest piece of each group, the first of equals."""
    n = table(spark, sf, "customer").groupBy(C("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(table(spark, sf, "nation"), "n_nationkey")
    return ev.largest(n, ["n_regionkey"], "n", "n_nationkey").select("n_regionkey", "n_nationkey", "n")


@query("pieces_min_frames", f"WITH {FRAMES_SQL} SELECT capture_id, kind AS piece, count(*) AS n, min(frame) AS first_frame FROM f GROUP BY ALL HAVING count(*) >= 8")
def pieces_min_frames(spark, sf):
    return ev.long_pieces(frames(spark, sf).withColumnRenamed("kind", "piece"), 8)


@query("depth_budget", f"WITH {FRAMES_SQL}, p AS (SELECT capture_id, kind AS piece, count(*) AS n FROM f GROUP BY ALL) SELECT capture_id, piece, greatest(3, least(20, round_even(240.0::DOUBLE * n / sum(n) OVER (PARTITION BY capture_id), 0)::BIGINT)) AS budget FROM p")
def depth_budget(spark, sf):
    """Depth frames of each piece by its share of all frames, 3 to 20."""
    n = frames(spark, sf).groupBy("capture_id", C("kind").alias("piece")).agg(F.count("*").alias("n"))
    return ev.depth_budget(n).select("capture_id", "piece", "budget")


@query("union_chunks", f"WITH {POINTS_SQL} SELECT capture_id, count(*) AS n, round(sum(x), 3) AS x FROM (SELECT * FROM p WHERE chunk = 0 UNION ALL SELECT * FROM p WHERE chunk = 2) GROUP BY 1")
def union_chunks(spark, sf):
    p = points(spark, sf)
    return p.where("chunk = 0").unionByName(p.where("chunk = 2")).groupBy("capture_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"))


@query("property_totals", "SELECT s_nationkey AS capture_id, count(*) AS n_rooms, count(area) AS measured, round(sum(area), 4) AS total, round(sqrt(sum(pm*pm)), 6) AS pm95, CASE WHEN count(area) < count(*) THEN 'sum over ' || count(area) || ' of ' || count(*) || ' rooms' END AS note FROM (SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN s_acctbal/100 END AS area, CASE WHEN s_acctbal > 0 THEN s_acctbal/10000 END AS pm FROM supplier) GROUP BY 1")
def property_totals(spark, sf):
    """Sum of the rooms' areas with the root of their squared ranges; says how many are measured where not all are."""
    s = table(spark, sf, "supplier")
    rooms = s.select(C("s_nationkey").alias("capture_id"), F.when(C("s_acctbal") > 0, C("s_acctbal") / 100).alias("area"), F.when(C("s_acctbal") > 0, C("s_acctbal") / 10000).alias("pm95"))
    t = ev.property_totals(rooms)
    return t.select("capture_id", "n_rooms", "measured", F.round("total", 4).alias("total"), F.round("pm95", 6).alias("pm95"), "note")


@query("renumber_ids", "SELECT c_nationkey AS capture_id, c_custkey AS old_id, 'R' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS new_id FROM customer")
def renumber_ids(spark, sf):
    c = table(spark, sf, "customer").select(C("c_nationkey").alias("capture_id"), C("c_custkey").alias("old_id"))
    return ev.renumber(c, ["capture_id"], ["old_id"], "R", "new_id")
