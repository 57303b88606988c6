"""Queries on whole documents: damage in the homes' documents, and documents of videos and of photo folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import damage as dm
from ..operators import results as rs
from ..operators import tiers as tr
from ..storage import written
from . import plan as pl
from . import scene
from .bind import query, table

C = F.col

# --- damage of the homes ----------------------------------------------------------------------------------------------

#: Sightings of damage in the homes: class, x (of room 2: from the inner wall), y over the floor, z, room, width, height, score, frame; pairs of the same class, room and place are one damage.
SEEN = (
    ("water stain", 1.0, 2.45, 1.0, 1, 0.40, 0.30, 0.82, 1),
    ("water stain", 1.1, 2.45, 1.0, 1, 0.60, 0.30, 0.61, 2),
    ("mould", 0.02, 0.2, 0.5, 1, 0.30, 0.20, 0.74, 3),
    ("crack", 0.6, 0.05, 0.6, 2, 1.20, 0.10, 0.55, 4),
    ("crack", 1.8, 0.05, 2.4, 2, 0.50, 0.10, 0.50, 5),
    ("peeling paint", 1.5, 1.2, 1.4, 2, 0.50, 0.40, 0.45, 6),
    ("hole", -3.0, 1.0, 1.0, 1, 0.10, 0.10, 0.40, 7),
)
#: Metres from the camera, and the focal length in pixels.
FAR, FOCAL = 2.0, 200.0


def _seen(spark, sf) -> DataFrame:
    """The sightings of each home, with their true places."""
    kinds = "class string, sx double, y double, sz double, room int, w double, h double, score double, frame int"
    h = scene.homes(spark, sf).crossJoin(F.broadcast(spark.createDataFrame(list(SEEN), kinds)))  # a fixed few rows a home
    return h.select("capture_id", "class", (C("sx") + F.when(C("room") == 2, C("wide") * 0.05).otherwise(0.0)).alias("x"), (C("y") + 0.003).alias("y"), C("sz").alias("z"), "w", "h", "score", "frame")


def _pictures(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Detections in the homes' pictures, of which one is hidden by a better one and one has no sure pixels, and the pixels in their boxes."""
    s = _seen(spark, sf)
    number = (C("capture_id") * 100 + C("frame")).cast("long")
    x0, y0 = F.lit(20.0), F.lit(30.0)
    box = [x0.alias("x0"), y0.alias("y0"), (x0 + C("w") * FOCAL / FAR).alias("x1"), (y0 + C("h") * FOCAL / FAR).alias("y1")]
    said = F.concat(F.lit("frame "), C("frame").cast("string"))
    own = s.select("capture_id", number.alias("frame"), (number * 10).alias("det_id"), "class", "score", said.alias("seen_in"), *box, F.lit(FOCAL).alias("focal"))
    hidden = own.where("det_id % 1000 = 10").select("capture_id", "frame", (C("det_id") + 1).alias("det_id"), F.lit("mould").alias("class"), F.lit(0.4).alias("score"), "seen_in", (C("x0") + 2).alias("x0"), "y0", (C("x1") + 2).alias("x1"), "y1", "focal")
    unsure = own.where("det_id % 1000 = 30").select("capture_id", "frame", (C("det_id") + 2).alias("det_id"), F.lit("hole").alias("class"), F.lit(0.9).alias("score"), "seen_in", F.lit(150.0).alias("x0"), F.lit(150.0).alias("y0"), F.lit(170.0).alias("x1"), F.lit(170.0).alias("y1"), "focal")
    near = lambda i, d: (i - 4) * d
    px = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).select(
        number.alias("frame"), (F.lit(31) + F.floor(C("i") / 3)).cast("int").alias("row"), (F.lit(21) + C("i") % 3).cast("int").alias("col"), F.lit(FAR).alias("depth"), F.when(C("i") == 8, 1).otherwise(2).alias("conf"),
        (C("x") + near(C("i"), 0.001)).alias("x"), (C("y") + near(C("i"), 0.001)).alias("y"), (C("z") + near(C("i"), 0.001)).alias("z"))
    return own.unionByName(hidden).unionByName(unsure), px


_SEEN_SQL = ", ".join(f"('{c}', {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE, {r}, {w}::DOUBLE, {h}::DOUBLE, {s}::DOUBLE, {f})" for c, x, y, z, r, w, h, s, f in SEEN)
#: The homes' damages as they were put there: the two stains are one.
_DAMAGE_SQL = f"""WITH {scene.SCENE_SQL}, d(n, class, room, surface, kind, frame, sightings, up, score, w, h) AS (VALUES
(1, 'water stain', 'R1', 'R1-ceiling', 'ceiling', 1, 2, 2.45::DOUBLE, 0.82::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE), (2, 'mould', 'R1', 'R1-W4', 'wall', 3, 1, 0.2::DOUBLE, 0.74::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE),
(3, 'crack', 'R2', 'R2-floor', 'floor', 4, 1, 0.05::DOUBLE, 0.55::DOUBLE, 1.2::DOUBLE, 0.1::DOUBLE), (4, 'crack', 'R2', 'R2-floor', 'floor', 5, 1, 0.05::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE),
(5, 'peeling paint', 'R2', 'R2-unknown', 'unknown', 6, 1, 1.2::DOUBLE, 0.45::DOUBLE, 0.5::DOUBLE, 0.4::DOUBLE), (6, 'hole', NULL, NULL, 'unknown', 7, 1, 1.0::DOUBLE, 0.4::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE)),
f(n, rule, condition, flag) AS (VALUES (1, 'C1', 'water stain on a ceiling', 'possible leak above the ceiling (plumbing, roof or a wet room upstairs)'), (2, 'C2', 'water stain or mould on a wall within 0.3 m of the floor', 'possible pipe leak or rising damp behind the wall'),
(2, 'C3', 'mould anywhere', 'hidden moisture likely behind or around the surface'), (3, 'C4', 'crack longer than 1 m', 'possible structural movement; needs a structural inspection')),
s(n, action, unit, q) AS (VALUES (1, 'Stain-block primer and repaint', 'm2', NULL), (2, 'Mould treatment, stain-block and repaint', 'm2', 0.72::DOUBLE), (3, 'Rake out, fill and repaint crack', 'm', 1.2::DOUBLE), (4, 'Rake out, fill and repaint crack', 'm', 0.5::DOUBLE), (5, 'Scrape, prime and repaint', 'm2', 0.2::DOUBLE), (6, 'Patch hole and repaint', 'each', 1.0::DOUBLE)),
i AS (SELECT capture_id::VARCHAR AS capture_id, 'damage' AS kind, 'D' || n AS id, concat_ws('|', class, coalesce(room, '-'), coalesce(surface, '-'), d.kind, 'frame ' || frame, sightings, up::VARCHAR) AS detail, score AS value, NULL::DOUBLE AS pm95 FROM h CROSS JOIN d
UNION ALL SELECT capture_id::VARCHAR, 'damage width', 'D' || n, NULL, w, round(w*0.3::DOUBLE, 3) FROM h CROSS JOIN d UNION ALL SELECT capture_id::VARCHAR, 'damage height', 'D' || n, NULL, d.h, round(d.h*0.3::DOUBLE, 3) FROM h CROSS JOIN d
UNION ALL SELECT capture_id::VARCHAR, 'damage area', 'D' || n, NULL, round(w*d.h, 3), round(w*d.h*0.6::DOUBLE, 3) FROM h CROSS JOIN d
UNION ALL SELECT capture_id::VARCHAR, 'flag', 'D' || n || ' ' || rule, concat_ws('|', condition, flag, surface), NULL, NULL FROM h CROSS JOIN f JOIN d USING (n)
UNION ALL SELECT capture_id::VARCHAR, 'scope', 'S' || n, concat_ws('|', 'D' || n, coalesce(surface, '-'), action, unit), round(coalesce(q, round(round(wide*0.05::DOUBLE, 3)*round(deep*0.05::DOUBLE, 3), 3)), 2), NULL FROM h CROSS JOIN s JOIN d USING (n))"""


@query("damage_document", f"{_DAMAGE_SQL} SELECT * FROM i")
def damage_document(spark, sf):
    """Damage, flags and line items of the homes' documents: found in pictures, placed, merged, numbered, and read back."""
    from .results import home_document

    docs, _ = home_document(spark, sf)
    items = rs.document_items(docs).where(C("kind").startswith("damage") | C("kind").isin("flag", "scope"))
    return items.withColumns({c: F.round(c, 3) for c in ("value", "pm95")})


def home_damage(spark, sf, corners: DataFrame, areas: DataFrame, heights: DataFrame) -> dict[str, DataFrame]:
    """The tables of damage of the homes."""
    boxes, px = _pictures(spark, sf)
    floors = heights.groupBy("capture_id").agg(F.median("floor_y").alias("floor_y"))
    seen = written(dm.sightings(boxes, px, floors, corners, 1000, 1000), "sightings")
    return dm.damage_lists(seen, areas)


# --- videos and photos ------------------------------------------------------------------------------------------------


def _rooms(spark, sf) -> DataFrame:
    """Measured rooms: two for each supplier, keyed s_suppkey and room_id."""
    k = C("s_suppkey")
    s = table(spark, sf, "supplier").select(k, F.explode(F.array(F.lit(1), F.lit(2))).alias("room_id"))
    w, d = 3.0 + k % 7 * 0.1 + C("room_id") * 0.2, 2.0 + k % 5 * 0.2
    m = lambda v, pm, note=None: g.measure(v, pm, note)
    wall = lambda v, found: F.struct(F.lit("").alias("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("start"), F.array(F.lit(1.0), F.lit(0.0)).alias("end"), m(v, F.lit(0.014)).alias("length"), found.alias("detected"))
    sides = F.when((k + C("room_id")) % 5 == 0, 2).otherwise(4 - k % 2)
    return s.select(
        k, "room_id", sides.alias("sides"), F.lit("rectangular").alias("shape"), F.array(*[F.array(F.lit(float(i)), F.lit(float(i * i))) for i in range(4)]).alias("outline"), m(w, F.lit(0.02)).alias("width"), m(d, F.lit(0.03)).alias("length"), m(w * d, F.lit(0.1)).alias("floor_area"),
        m(F.when(k % 3 > 0, 2.5), F.when(k % 3 > 0, 0.02), F.when(k % 3 == 0, "ceiling not seen")).alias("ceiling_height"), F.array(*[wall(w if i % 2 == 0 else d, F.lit(i > 0)) for i in range(4)]).alias("walls"),
    )


_ROOMS_SQL = """r0 AS (SELECT s_suppkey AS k, unnest([1, 2]) AS room_id FROM supplier), r AS (SELECT k, room_id, CASE WHEN (k + room_id) % 5 = 0 THEN 2 ELSE 4 - k % 2 END AS sides, round(3.0::DOUBLE + k % 7 * 0.1::DOUBLE + room_id*0.2::DOUBLE, 3) AS w, round(2.0::DOUBLE + k % 5 * 0.2::DOUBLE, 3) AS d,
  round((3.0::DOUBLE + k % 7 * 0.1::DOUBLE + room_id*0.2::DOUBLE)*(2.0::DOUBLE + k % 5 * 0.2::DOUBLE), 3) AS a, CASE WHEN k % 3 > 0 THEN 2.5::DOUBLE END AS c FROM r0)"""


def _sizes_sql(sigma: float) -> str:
    """SQL of the measures of rooms n (capture_id, id, k, w, d, a, c) with widened ranges."""
    wide = lambda v, pm, power=1: f"round(sqrt(power({pm}::DOUBLE, 2) + power({2 * power * sigma}::DOUBLE*{v}, 2)), 3)"
    one = lambda kind, v, pm, power=1, note="NULL": f"SELECT capture_id, '{kind}' AS kind, id, {note} AS detail, {v} AS value, {wide(v, pm, power)} AS pm95 FROM n"
    walls = f"SELECT capture_id, 'wall', id || '-W' || (side + 1), CASE WHEN side > 0 THEN 'true' ELSE 'false' END, CASE WHEN side % 2 = 0 THEN w ELSE d END, CASE WHEN side % 2 = 0 THEN {wide('w', 0.014)} ELSE {wide('d', 0.014)} END FROM n CROSS JOIN range(4) t(side)"
    note = "CASE WHEN k % 3 = 0 THEN 'ceiling not seen' END"
    return " UNION ALL ".join([one("width", "w", 0.02), one("length", "d", 0.03), one("floor_area", "a", 0.1, 2), one("ceiling_height", "c", 0.02, note=note), walls])


def _total_sql(sigma: float) -> str:
    return f"round(sum(a), 3), round(sqrt(sum(power(round(sqrt(0.01::DOUBLE + power({4 * sigma}::DOUBLE*a, 2)), 3), 2))), 3)"


_GENERAL = f"(3, '{rs.SCALE_SAID % 10}'), (4, '{rs.RANGES_SAID}')"


@query("video_document", f"""WITH {_ROOMS_SQL}, g AS (SELECT s_suppkey AS k, s_suppkey // 3 AS cap, s_suppkey % 3 + 1 AS segment, s_suppkey % 11 = 0 AS skipped FROM supplier),
n AS (SELECT cap::VARCHAR AS capture_id, segment, room_id, r.k, w, d, a, c, row_number() OVER (PARTITION BY cap ORDER BY segment, room_id) AS i FROM r JOIN g USING (k) WHERE sides >= 3 AND NOT skipped), m AS (SELECT *, 'R' || i AS id FROM n), v AS (SELECT cap::VARCHAR AS capture_id, count(*) FILTER (NOT skipped) AS used, count(*) AS n_all FROM g GROUP BY 1 HAVING used > 0),
o AS (SELECT m.capture_id, m.segment, string_agg(m.id, '+' ORDER BY m.room_id) AS rooms, count(*) AS touched, row_number() OVER (PARTITION BY m.capture_id ORDER BY m.segment) AS i FROM m GROUP BY m.capture_id, m.segment)
SELECT capture_id, 'room' AS kind, id, 'Room ' || i || ' (segment ' || segment || ')|rectangular|' || segment || '|-|4' AS detail, NULL::DOUBLE AS value, NULL::DOUBLE AS pm95 FROM m
UNION ALL SELECT * FROM ({_sizes_sql(0.10).replace('FROM n', 'FROM m')}) z
UNION ALL SELECT capture_id, 'opening', 'O' || i, 'door|' || rooms, 0.85::DOUBLE, round(sqrt(power(0.041::DOUBLE, 2) + power(0.2::DOUBLE*0.85::DOUBLE, 2)), 3) FROM o UNION ALL SELECT capture_id, 'adjacent', 'O' || i, rooms, NULL, NULL FROM o WHERE touched = 2
UNION ALL SELECT v.capture_id, 'total', count(m.id)::VARCHAR, NULL, coalesce(round(sum(a), 3), 0), coalesce(round(sqrt(sum(power(round(sqrt(0.01::DOUBLE + power(0.4::DOUBLE*a, 2)), 3), 2))), 3), 0) FROM v LEFT JOIN m USING (capture_id) GROUP BY v.capture_id
UNION ALL SELECT capture_id, 'warning', i::VARCHAR, said, NULL, NULL FROM (SELECT capture_id, 1 AS i, 'Video: rooms are measured separately in ' || used || ' of ' || n_all || ' video segments and are NOT stitched into one plan; the same real room may be listed once per segment that saw it, so the total floor area can double count.' AS said FROM v
  UNION ALL SELECT capture_id, i, said FROM v CROSS JOIN (VALUES (2, '{rs.VIDEO_SAID[1] % 3}'), {_GENERAL}) t(i, said)) w""")
def video_document(spark, sf):
    """Documents of videos of three segments, of which some can't be used: complete rooms and their doors, numbered through, with widened ranges."""
    k = C("s_suppkey")
    at = lambda df: df.withColumns({"capture_id": F.floor(k / 3).cast("long"), "segment": (k % 3 + 1).cast("int")})
    s = at(table(spark, sf, "supplier"))
    segments = s.select("capture_id", "segment", F.when(k % 11 == 0, "too few spots to give it a size").alias("skipped"))
    doors = s.select("capture_id", "segment", F.lit(1).alias("gap_idx"), F.array(F.lit(0.0), F.lit(1.0)).alias("start"), F.array(F.lit(0.0), F.lit(1.85)).alias("end"), g.measure(F.lit(0.85), F.lit(0.041)).alias("width"), F.array(F.lit(1), F.lit(2)).alias("rooms"))
    doors = doors.unionByName(doors.withColumns({"gap_idx": F.lit(2), "rooms": F.array(F.lit(7))}))  # the second one is a door of rooms that weren't kept
    docs = tr.video_documents(segments, at(_rooms(spark, sf)).drop("s_suppkey"), doors)
    return rs.document_items(docs).withColumns({c: F.round(c, 3) for c in ("value", "pm95")})


_PHOTOS_SQL = f"""{_ROOMS_SQL}, f AS (SELECT s_suppkey AS k, s_suppkey // 4 AS cap, 'room' || s_suppkey AS name, s_suppkey % 6 AS photos, s_suppkey % 13 * 0.01::DOUBLE AS spread FROM supplier),
b AS (SELECT k, sides, w, d, a, c FROM r WHERE room_id = 2 AND k % 7 > 0),
q AS (SELECT f.cap::VARCHAR AS capture_id, f.k, name, photos, 'R' || row_number() OVER (PARTITION BY cap ORDER BY name) AS id, row_number() OVER (PARTITION BY cap ORDER BY name) AS i, w, d, a, c,
  CASE WHEN photos < 2 THEN 'fewer than 2 photos' WHEN b.k IS NULL THEN 'no room outline found in the reconstruction' WHEN sides < 3 THEN 'walls found on only ' || sides || ' of 4 sides' WHEN spread > 0.1::DOUBLE THEN 'photos disagree on size by ' || round(100*spread)::INT || '%' END AS reason FROM f LEFT JOIN b ON b.k = f.k),
n AS (SELECT * FROM q WHERE reason IS NULL)"""


def _photo_docs(spark, sf) -> DataFrame:
    k = C("s_suppkey")
    s = table(spark, sf, "supplier").withColumns({"capture_id": F.floor(k / 4).cast("long"), "name": F.concat(F.lit("room"), k.cast("string"))})
    folders = s.select("capture_id", "name", (k % 6).alias("photos"), (k % 13 * 0.01).alias("spread"))
    rooms = _rooms(spark, sf).where(k % 7 > 0).withColumns({"capture_id": F.floor(k / 4).cast("long"), "name": F.concat(F.lit("room"), k.cast("string")), "rough": C("floor_area.value")}).drop("s_suppkey")
    door = F.concat(F.lit("door"), k.cast("string"), F.lit(".jpg"))
    photos = s.select("capture_id", "name", door.alias("photo"), F.concat(F.lit("door between "), F.floor(k / 2).cast("string")).alias("content"))
    photos = photos.unionByName(s.select("capture_id", "name", F.lit("room.jpg").alias("photo"), F.concat(F.lit("room "), k.cast("string")).alias("content")))
    return tr.photo_documents(folders, rooms, photos)


@query("photo_document", f"""WITH {_PHOTOS_SQL}
SELECT capture_id, 'room' AS kind, id, name || CASE WHEN reason IS NULL THEN '|rectangular|-|' ELSE '|not measured|-|' END || photos || CASE WHEN reason IS NULL THEN '|4' ELSE '|0' END AS detail, NULL::DOUBLE AS value, NULL::DOUBLE AS pm95 FROM q
UNION ALL SELECT * FROM ({_sizes_sql(0.15)}) z
UNION ALL SELECT capture_id, unnest(['width', 'length', 'floor_area', 'ceiling_height']), id, 'not measured: ' || reason, NULL, NULL FROM q WHERE reason IS NOT NULL
UNION ALL SELECT q.capture_id, 'adjacent', 'shared photo door' || a.k || '.jpg', q.id || '+' || p.id, NULL, NULL FROM q JOIN f a ON a.k = q.k JOIN q p ON p.capture_id = q.capture_id AND p.k = q.k + 1 WHERE q.k % 2 = 0 AND q.i < p.i
UNION ALL SELECT q.capture_id, 'adjacent', 'shared photo door' || p.k || '.jpg', p.id || '+' || q.id, NULL, NULL FROM q JOIN q p ON p.capture_id = q.capture_id AND p.k = q.k + 1 WHERE q.k % 2 = 0 AND q.i > p.i
UNION ALL SELECT capture_id, 'total', count(*)::VARCHAR, CASE WHEN count(*) FILTER (reason IS NULL) < count(*) THEN 'sum over ' || count(*) FILTER (reason IS NULL) || ' of ' || count(*) || ' rooms (the rest not measured)' END, round(sum(a) FILTER (reason IS NULL), 3), round(sqrt(sum(power(round(sqrt(0.01::DOUBLE + power(0.6::DOUBLE*a, 2)), 3), 2)) FILTER (reason IS NULL)), 3) FROM q GROUP BY capture_id
UNION ALL SELECT DISTINCT capture_id, 'warning', '1', '{rs.PHOTO_SAID.replace("'", "''")}', NULL, NULL FROM q
UNION ALL SELECT capture_id, 'warning', (row_number() OVER (PARTITION BY capture_id ORDER BY i) + 1)::VARCHAR, id || ' (' || name || '): not measured: ' || reason || '.', NULL, NULL FROM q WHERE reason IS NOT NULL""")
def photo_document(spark, sf):
    """Documents of folders of photos: rooms that pass the gate with widened ranges, the others with the reason, and rooms that share a doorway's photo."""
    return rs.document_items(_photo_docs(spark, sf)).withColumns({c: F.round(c, 3) for c in ("value", "pm95")})
