"""Queries on damage, rules, scope and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import damage as dm
from ..operators import evaluation as ev
from .bind import VECTORS_SQL, query, rounded, table, vectors
from .projections import BOXES_SQL, _boxes

C = F.col


@query("box_iou", f"WITH {BOXES_SQL}, i AS (SELECT a.label, a.vec_id AS a_id, b.vec_id AS b_id, greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0) AS i, (a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0) AS s FROM b a JOIN b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, a_id, b_id, round(i/(s-i), 6) AS iou FROM i WHERE i > 0 AND i/(s-i) >= 0.2::DOUBLE")
def box_iou(spark, sf):
    """Overlapping boxes of a picture (here: forty vectors)."""
    return rounded(dm.box_overlaps(_boxes(spark, sf), ["label"], "vec_id").where("iou >= 0.2"))


@query("box_nms", f"""WITH RECURSIVE {BOXES_SQL}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS i, (x1 - x0)*(y1 - y0) AS area FROM b),
g AS (SELECT DISTINCT label, 0::BIGINT AS i, []::STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, area DOUBLE)[] AS kept FROM o
  UNION ALL SELECT g.label, o.i, CASE WHEN len(list_filter(g.kept, lambda k: greatest(least(k.x1, o.x1) - greatest(k.x0, o.x0), 0)*greatest(least(k.y1, o.y1) - greatest(k.y0, o.y0), 0) >= 0.5::DOUBLE*(k.area + o.area - greatest(least(k.x1, o.x1) - greatest(k.x0, o.x0), 0)*greatest(least(k.y1, o.y1) - greatest(k.y0, o.y0), 0)) AND k.area + o.area > 0)) = 0
    THEN list_append(g.kept, {{'id': o.vec_id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'area': o.area}}) ELSE g.kept END FROM g JOIN o ON o.label = g.label AND o.i = g.i + 1),
f AS (SELECT label, unnest(kept).id AS vec_id FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY i DESC) = 1)
SELECT o.label, o.vec_id, o.x0, o.y0, o.x1, o.y1, o.score FROM o JOIN f USING (label, vec_id)""")
def box_nms(spark, sf):
    return dm.suppress(_boxes(spark, sf), ["label"])


_DAMAGE_SQL = """d AS (SELECT p_partkey AS damage_id, p_size % 3 AS capture_id, (['water stain','mould','crack','hole','peeling paint'])[p_partkey % 5 + 1] AS class, 'R' || p_size % 4 AS room,
 CASE p_partkey % 3 WHEN 0 THEN 'R' || p_size % 4 || '-floor' WHEN 1 THEN 'R' || p_size % 4 || '-ceiling' ELSE 'R' || p_size % 4 || '-W1' END AS surface, (['floor','ceiling','wall'])[p_partkey % 3 + 1] AS surface_type,
 CASE WHEN p_partkey % 11 > 0 THEN p_size / 20.0::DOUBLE END AS width_m, p_retailprice / 1000 AS height_m, (p_size % 10) / 10.0::DOUBLE AS height_above_floor FROM part)"""


def _damage(spark, sf):
    p = table(spark, sf, "part")
    room = F.concat(F.lit("R"), (C("p_size") % 4).cast("string"))
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    return p.select(
        C("p_partkey").alias("damage_id"), (C("p_size") % 3).alias("capture_id"), pick(["water stain", "mould", "crack", "hole", "peeling paint"], C("p_partkey") % 5).alias("class"), room.alias("room"),
        F.concat(room, pick(["-floor", "-ceiling", "-W1"], C("p_partkey") % 3)).alias("surface"), pick(["floor", "ceiling", "wall"], C("p_partkey") % 3).alias("surface_type"),
        F.when(C("p_partkey") % 11 > 0, C("p_size") / 20.0).alias("width_m"), (C("p_retailprice") / 1000).alias("height_m"), ((C("p_size") % 10) / 10.0).alias("height_above_floor"),
    )


@query("concealed_flags", f"""WITH {_DAMAGE_SQL} SELECT damage_id, 'C1' AS rule, 'water stain on a ceiling' AS condition, 'possible leak above the ceiling (plumbing, roof or a wet room upstairs)' AS flag, surface FROM d WHERE class = 'water stain' AND surface_type = 'ceiling'
UNION ALL SELECT damage_id, 'C2', 'water stain or mould on a wall within 0.3 m of the floor', 'possible pipe leak or rising damp behind the wall', surface FROM d WHERE class IN ('water stain', 'mould') AND surface_type = 'wall' AND height_above_floor < 0.3::DOUBLE
UNION ALL SELECT damage_id, 'C3', 'mould anywhere', 'hidden moisture likely behind or around the surface', surface FROM d WHERE class = 'mould'
UNION ALL SELECT damage_id, 'C4', 'crack longer than 1 m', 'possible structural movement; needs a structural inspection', surface FROM d WHERE class = 'crack' AND width_m IS NOT NULL AND height_m IS NOT NULL AND greatest(width_m, height_m) > 1.0::DOUBLE""")
def concealed_flags(spark, sf):
    return dm.concealed_flags(_damage(spark, sf))


_AREAS_SQL = """r AS (SELECT DISTINCT p_size % 3 AS capture_id, 'R' || p_size % 4 AS room, 10.0::DOUBLE + p_size % 4 AS floor_area, CASE WHEN p_size % 4 <> 2 THEN 2.5::DOUBLE END AS ceiling FROM part),
a AS (SELECT capture_id, room || '-W1' AS surface, (3.0::DOUBLE + capture_id) * ceiling AS area FROM r UNION ALL SELECT capture_id, room || '-floor', floor_area FROM r UNION ALL SELECT capture_id, room || '-ceiling', floor_area FROM r)"""


def _areas(spark, sf):
    p = table(spark, sf, "part")
    four = C("p_size") % 4
    rooms = p.select((C("p_size") % 3).alias("capture_id"), F.concat(F.lit("R"), four.cast("string")).alias("room"), (10.0 + four).alias("floor_area"), F.when(four != 2, 2.5).alias("ceiling")).distinct()
    walls = rooms.select("capture_id", "room", F.concat("room", F.lit("-W1")).alias("wall"), (3.0 + C("capture_id")).alias("length"))
    return dm.surface_areas(rooms, walls)


@query("surface_areas", f"WITH {_AREAS_SQL} SELECT capture_id, surface, round(area, 6) AS area FROM a")
def surface_areas(spark, sf):
    return rounded(_areas(spark, sf))


@query("repair_scope", f"""WITH {_DAMAGE_SQL}, {_AREAS_SQL}, s(class, action) AS (VALUES ('water stain', 'Stain-block primer and repaint'), ('mould', 'Mould treatment, stain-block and repaint'), ('peeling paint', 'Scrape, prime and repaint'), ('crack', 'Rake out, fill and repaint crack'), ('hole', 'Patch hole and repaint'))
SELECT damage_id, surface, action, round(CASE WHEN class IN ('water stain', 'peeling paint') THEN coalesce(area, width_m*height_m) WHEN class = 'mould' THEN (width_m+0.6::DOUBLE)*(height_m+0.6::DOUBLE) WHEN class = 'crack' THEN CASE WHEN width_m IS NOT NULL THEN greatest(width_m, height_m) END ELSE 1.0::DOUBLE END, 6) AS quantity, CASE class WHEN 'crack' THEN 'm' WHEN 'hole' THEN 'each' ELSE 'm2' END AS unit
FROM d JOIN s USING (class) LEFT JOIN a USING (capture_id, surface)""")
def repair_scope(spark, sf):
    areas = _areas(spark, sf).withColumnRenamed("area", "surface_area")
    return rounded(dm.repair_scope(dm.measured(_damage(spark, sf)), areas, dm.scope_table(spark)))


@query("damage_items", f"WITH {_DAMAGE_SQL} SELECT damage_id, round(width_m*0.3::DOUBLE, 6) AS width_pm95, round(height_m*0.3::DOUBLE, 6) AS height_pm95, round(width_m*height_m, 6) AS area, round(0.6::DOUBLE*width_m*height_m, 6) AS area_pm95, round(CASE WHEN width_m IS NOT NULL THEN greatest(width_m, height_m) END, 6) AS length FROM d")
def damage_items(spark, sf):
    return rounded(dm.measured(_damage(spark, sf)).select("damage_id", "width_pm95", "height_pm95", "area", "area_pm95", "length"))


@query("damage_merge", f"WITH {VECTORS_SQL}, d AS (SELECT vec_id AS det_id, vec_id // 60 AS capture_id, 'crack' AS class, 'S' || label AS surface, abs(e8) AS score, CASE WHEN vec_id % 3 > 0 THEN abs(e9) END AS width_m, abs(e10) AS height_m FROM v) SELECT capture_id, class, surface, round(max(score), 6) AS score, count(*) AS sightings, round(median(width_m), 6) AS width_m, round(median(height_m), 6) AS height_m, arg_max(det_id, (score, -det_id)) AS det_id FROM d GROUP BY ALL")
def damage_merge(spark, sf):
    """Sightings without centres, which merge by class and surface."""
    none = F.lit(None).cast("double")
    v = vectors(spark, sf).select(F.floor(C("vec_id") / 60).cast("long").alias("capture_id"), C("vec_id").alias("det_id"), F.lit("crack").alias("class"), F.concat(F.lit("S"), C("label").cast("string")).alias("surface"), F.abs("e8").alias("score"), F.when(C("vec_id") % 3 > 0, F.abs("e9")).alias("width_m"), F.abs("e10").alias("height_m"), none.alias("cx"), none.alias("cy"), none.alias("cz"))
    return rounded(dm.merge_sightings(v))


@query("damage_merge_centres", f"""WITH RECURSIVE {VECTORS_SQL}, d AS MATERIALIZED (SELECT vec_id AS det_id, vec_id // 60 AS capture_id, 'crack' AS class, 'S' || label AS surface, abs(e8) AS score, abs(e9) AS width_m, abs(e10) AS height_m, e1*3 AS cx, e2*3 AS cy, e3*3 AS cz, row_number() OVER (PARTITION BY vec_id // 60, label ORDER BY abs(e8) DESC, vec_id) AS i FROM v),
g AS (SELECT DISTINCT capture_id, surface, 0::BIGINT AS i, []::STRUCT(x DOUBLE, y DOUBLE, z DOUBLE)[] AS leaders, NULL::BIGINT AS own FROM d
  UNION ALL SELECT capture_id, surface, i, CASE WHEN near IS NULL THEN list_append(leaders, {{'x': cx, 'y': cy, 'z': cz}}) ELSE leaders END, coalesce(near, len(leaders) + 1)::BIGINT FROM (
    SELECT d.capture_id, d.surface, d.i, g.leaders, d.cx, d.cy, d.cz, list_filter(range(1, len(g.leaders) + 1), lambda n: sqrt(power(g.leaders[n].x - d.cx, 2) + power(g.leaders[n].y - d.cy, 2) + power(g.leaders[n].z - d.cz, 2)) < 0.5::DOUBLE)[1] AS near FROM g JOIN d ON d.capture_id = g.capture_id AND d.surface = g.surface AND d.i = g.i + 1))
SELECT d.capture_id, class, d.surface, round(max(score), 6) AS score, count(*) AS sightings, round(median(width_m), 6) AS width_m, round(median(height_m), 6) AS height_m, arg_max(det_id, (score, -det_id)) AS det_id FROM d JOIN g ON g.capture_id = d.capture_id AND g.surface = d.surface AND g.i = d.i GROUP BY d.capture_id, class, d.surface, g.own""")
def damage_merge_centres(spark, sf):
    """Sightings with centres, which merge where these are near."""
    v = vectors(spark, sf).select(F.floor(C("vec_id") / 60).cast("long").alias("capture_id"), C("vec_id").alias("det_id"), F.lit("crack").alias("class"), F.concat(F.lit("S"), C("label").cast("string")).alias("surface"), F.abs("e8").alias("score"), F.abs("e9").alias("width_m"), F.abs("e10").alias("height_m"), (C("e1") * 3).alias("cx"), (C("e2") * 3).alias("cy"), (C("e3") * 3).alias("cz"))
    return rounded(dm.merge_sightings(v))


@query("damage_picture", f"WITH {VECTORS_SQL} SELECT vec_id // 60 AS capture_id, vec_id AS det_id, 'mould' AS class, round(abs(e8), 6) AS score, 'R' || label AS room, 'R' || label || '-unknown' AS surface, 'unknown' AS surface_type, NULL::DOUBLE AS width_m, NULL::DOUBLE AS height_m FROM v")
def damage_picture(spark, sf):
    v = vectors(spark, sf).select(F.floor(C("vec_id") / 60).cast("long").alias("capture_id"), C("vec_id").alias("det_id"), F.lit("mould").alias("class"), F.abs("e8").alias("score"), F.concat(F.lit("R"), C("label").cast("string")).alias("room"))
    return rounded(dm.without_depth(v))


_LOCATE_SQL = """p AS (SELECT event_id // 256 AS frame, ((event_id // 16) % 16)::INT AS row, (event_id % 16)::INT AS col, abs(value % 10)/2 + 0.1::DOUBLE AS depth, (event_id % 4)::INT AS conf, value % 7 AS x, value % 3 AS y, value % 5 AS z FROM events),
d AS (SELECT event_id // 256 AS frame, user_id % 5 AS capture_id, event_id AS det_id, (event_id % 6)::DOUBLE AS x0, (event_id % 5)::DOUBLE AS y0, (event_id % 6)::DOUBLE + 8 AS x1, (event_id % 5)::DOUBLE + 7 AS y1, 200.0::DOUBLE AS focal FROM events WHERE event_id % 16 = 0 OR value > 1)"""


@query("damage_locate", f"""WITH {_LOCATE_SQL}, m AS (SELECT capture_id, det_id, x0, y0, x1, y1, focal, count(*) AS n, median(x) AS cx, median(y) AS cy, median(z) AS cz, median(depth) AS t FROM d JOIN p USING (frame) WHERE conf >= 2 AND depth > 0.2::DOUBLE AND col BETWEEN x0 AND x1 AND row BETWEEN y0 AND y1 GROUP BY ALL HAVING count(*) >= 5)
SELECT capture_id, det_id, n, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, round((x1-x0)*t/focal, 6) AS width_m, round((y1-y0)*t/focal, 6) AS height_m, round(cy - capture_id*0.1::DOUBLE, 6) + 0.0 AS height_above_floor FROM m""")
def damage_locate(spark, sf):
    """Detections placed by the pixels inside their boxes."""
    e = table(spark, sf, "events")
    i = C("event_id")
    frame = F.floor(i / 256).cast("long").alias("frame")
    px = e.select(frame, (F.floor(i / 16) % 16).cast("int").alias("row"), (i % 16).cast("int").alias("col"), (F.abs(C("value") % 10) / 2 + 0.1).alias("depth"), (i % 4).cast("int").alias("conf"), (C("value") % 7).alias("x"), (C("value") % 3).alias("y"), (C("value") % 5).alias("z"))
    x0, y0 = (i % 6).cast("double"), (i % 5).cast("double")
    det = e.where((i % 16 == 0) | (C("value") > 1)).select(frame, (C("user_id") % 5).alias("capture_id"), i.alias("det_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 8).alias("x1"), (y0 + 7).alias("y1"), F.lit(200.0).alias("focal"))
    floors = det.select("capture_id").distinct().withColumn("floor_y", C("capture_id") * 0.1)
    return rounded(dm.locate(det, px, floors))


@query("detector_report", f"WITH {VECTORS_SQL} SELECT vec_id, round(abs(e8), 6) AS score, CASE WHEN abs(e8) >= 0.3::DOUBLE THEN 'reported' ELSE 'listed' END AS status FROM v WHERE abs(e8) >= 0.1::DOUBLE")
def detector_report(spark, sf):
    return rounded(dm.detector_report(vectors(spark, sf).select("vec_id", F.abs("e8").alias("score"))))


@query("quality_gate", "SELECT s_suppkey, CASE WHEN s_suppkey % 12 < 2 THEN 'fewer than two photos' WHEN s_suppkey % 11 = 0 THEN 'no room found' WHEN s_suppkey % 5 < 3 THEN 'fewer than three sides seen' WHEN abs(s_acctbal)/50000 > 0.1::DOUBLE THEN 'depth ratios differ too much' END AS reason FROM supplier")
def quality_gate(spark, sf):
    s = table(spark, sf, "supplier")
    k = C("s_suppkey")
    return dm.quality_gate(s.select("s_suppkey", (k % 12).alias("photos"), (k % 11 != 0).alias("found"), (k % 5).alias("sides"), (F.abs("s_acctbal") / 50000).alias("spread"))).select("s_suppkey", "reason")


@query("wall_sigma", "SELECT p_partkey, round(sqrt(0.005::DOUBLE*0.005::DOUBLE + power(0.03::DOUBLE/sqrt(3::DOUBLE)/sqrt(p_size::DOUBLE), 2)), 9) AS sigma FROM part")
def wall_sigma(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(g.wall_sigma(C("p_size")), 9).alias("sigma"))


@query("widen_ranges", "SELECT o_orderkey, round(o_totalprice/1e4, 6) AS value, round(sqrt(power(o_totalprice/1e6,2) + power(2*0.1::DOUBLE*abs(o_totalprice/1e4),2)), 6) AS pm95, round(sqrt(power(o_totalprice/1e6,2) + power(4*0.15::DOUBLE*abs(o_totalprice/1e4),2)), 6) AS area_pm95 FROM orders")
def widen_ranges(spark, sf):
    """Ranges with the scale error of the video and photo tiers."""
    v, pm = C("o_totalprice") / 1e4, C("o_totalprice") / 1e6
    return rounded(table(spark, sf, "orders").select("o_orderkey", v.alias("value"), g.widen(v, pm, 0.10).alias("pm95"), g.widen(v, pm, 0.15, 2).alias("area_pm95")))


_PAIRS = "(SELECT a.c_custkey AS room_a, a.c_custkey + 1 AS room_b, a.c_acctbal/100 AS width_a, b.c_acctbal/100 AS width_b, a.c_custkey/7.0::DOUBLE AS length_a, CASE WHEN a.c_custkey % 3 > 0 THEN a.c_custkey/7.0::DOUBLE + (a.c_custkey % 4)*0.005::DOUBLE END AS length_b, 2.5::DOUBLE AS ceiling_a, 2.5::DOUBLE + (a.c_custkey % 6)*0.003::DOUBLE AS ceiling_b, 10.0::DOUBLE AS area_a, 11.0::DOUBLE AS area_b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)"


@query("repeatability_gate", f"""WITH p AS {_PAIRS}, r AS (SELECT room_a, room_b, 'width' AS dimension, width_a AS a, length_b AS b FROM p UNION ALL SELECT room_a, room_b, 'length', length_a, width_b FROM p UNION ALL SELECT room_a, room_b, 'ceiling_height', ceiling_a, ceiling_b FROM p UNION ALL SELECT room_a, room_b, 'floor_area', area_a, area_b FROM p)
SELECT room_a, room_b, dimension, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(b-a, 6) + 0.0 AS diff, round(100*abs(b-a)/nullif(abs(a+b)/2, 0), 5) AS pct, CASE WHEN a IS NULL OR b IS NULL THEN 'n/a' WHEN dimension = 'floor_area' THEN 'reported' WHEN abs(a-b) <= 0.01::DOUBLE OR abs(a-b) <= 0.005::DOUBLE*abs(a+b)/2 THEN 'pass' ELSE 'fail' END AS ok FROM r""")
def repeatability_gate(spark, sf):
    """Dimensions of two captures of a room against the gate, the second a quarter turn off."""
    c = table(spark, sf, "customer")
    k = C("c_custkey")
    nxt = c.select((k - 1).alias("c_custkey"), (C("c_acctbal") / 100).alias("width_b"))
    length = k / F.lit(7.0)
    p = c.select("c_custkey", k.alias("room_a"), (k + 1).alias("room_b"), (C("c_acctbal") / 100).alias("width_a"), length.alias("length_a"), F.when(k % 3 > 0, length + (k % 4) * 0.005).alias("length_b"), F.lit(2.5).alias("ceiling_a"), (F.lit(2.5) + (k % 6) * 0.003).alias("ceiling_b"), F.lit(10.0).alias("area_a"), F.lit(11.0).alias("area_b")).join(nxt, "c_custkey")
    r = ev.repeatability(p, turns=1)
    return r.select("room_a", "room_b", "dimension", *[(F.round(x, 6) + F.lit(0.0)).alias(x) for x in ("a", "b", "diff")], F.round("pct", 5).alias("pct"), "ok")
