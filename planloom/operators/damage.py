"""Operators on detections: boxes, suppression, merging, rules and repair scope."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import DEFAULTS, Params
from ..storage import dealt, keyed, written

BOX = ("x0", "y0", "x1", "y1")
#: Detections that one task suppresses or merges.
DETECTIONS = 100_000

#: Fixed values of the contract: rule, its condition, and what it hints at.
RULES = (
    ("C1", "water stain on a ceiling", "possible leak above the ceiling (plumbing, roof or a wet room upstairs)"),
    ("C2", "water stain or mould on a wall within 0.3 m of the floor", "possible pipe leak or rising damp behind the wall"),
    ("C3", "mould anywhere", "hidden moisture likely behind or around the surface"),
    ("C4", "crack longer than 1 m", "possible structural movement; needs a structural inspection"),
)

#: Fixed values of the contract: repair action and basis of its quantity, by class of damage.
SCOPE = (
    ("water stain", "Stain-block primer and repaint", "surface"),
    ("mould", "Mould treatment, stain-block and repaint", "damage+margin"),
    ("peeling paint", "Scrape, prime and repaint", "surface"),
    ("crack", "Rake out, fill and repaint crack", "length"),
    ("hole", "Patch hole and repaint", "count"),
)


def clip_boxes(boxes: DataFrame, width: float, height: float, p: Params = DEFAULTS) -> DataFrame:
    """Boxes cut to the picture, without those that are empty or cover over half of it."""
    b = boxes.withColumns({"x0": F.greatest("x0", F.lit(0.0)), "y0": F.greatest("y0", F.lit(0.0)), "x1": F.least("x1", F.lit(float(width))), "y1": F.least("y1", F.lit(float(height)))})
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return b.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (area <= p.max_box_share * width * height))


def box_overlaps(boxes: DataFrame, keys: list[str], ident: str, cell: float = 100.0) -> DataFrame:
    """Pairs of boxes of a picture that overlap, with their IoU. Boxes meet by the cells of a coarse grid that they touch."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    laid = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    side = lambda s: laid.select(*keys, "cx", "cy", F.col(ident).alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in BOX])
    j = side("a").join(keyed(side("b")), [*keys, "cx", "cy"]).where("a_id < b_id")
    # a pair counts in the first cell that both touch
    first = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    value = g.iou(tuple(F.col(f"a_{c}") for c in BOX), tuple(F.col(f"b_{c}") for c in BOX))
    return j.where(first).select(*keys, "a_id", "b_id", value.alias("iou")).where("iou > 0")


def suppress(boxes: DataFrame, keys: list[str], ident: str = "vec_id", p: Params = DEFAULTS) -> DataFrame:
    """Greedy suppression in each picture, whatever the classes: by falling score (then id), a box stays if it overlaps no kept one by half.

    A picture's boxes are few and are handled together; pictures are dealt to tasks by their number, and many go through a task in one batch.
    """
    own = [ident, *BOX, "score"]
    schema = boxes.select(*keys, *own).schema

    def kept(b: np.ndarray) -> list[int]:
        out: list[int] = []
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        for i in range(len(b)):
            k = np.array(out, dtype=int)
            w = np.clip(np.minimum(b[i, 2], b[k, 2]) - np.maximum(b[i, 0], b[k, 0]), 0, None)
            h = np.clip(np.minimum(b[i, 3], b[k, 3]) - np.maximum(b[i, 1], b[k, 1]), 0, None)
            union = area[i] + area[k] - w * h
            if not len(k) or not (np.where(union > 0, w * h / np.where(union > 0, union, 1), 0) >= p.nms_iou).any():
                out.append(i)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = _lists(batch)
            b = np.stack([values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in BOX], axis=1)
            # a box alone stays
            at = [np.arange(i, j) if j - i == 1 else i + np.array(kept(b[i:j]), dtype=np.int64) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            if at:
                n, at = [len(x) for x in at], pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([*_repeated(batch, keys, n), *(values.field(c).take(at) for c in own)], schema.names)

    return _ranked(dealt(boxes.select(*schema.names), DETECTIONS, *keys), keys, ident, own).mapInArrow(run, schema)


def _ranked(rows: DataFrame, keys: list[str], ident: str, own: list[str]) -> DataFrame:
    """A row for each group with the list of its rows by falling score, then id; unknown ones come last."""
    first = [F.coalesce(F.isnan(F.col("score").cast("double")), F.lit(False)) | F.col("score").isNull(), -F.col("score").cast("double"), F.col(ident).isNull(), F.col(ident)]
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(first)], F.struct(*own).alias("own"))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["own"]).alias("own"))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray]:
    """Where the groups' lists end, and their rows."""
    held = batch.column("own")
    ends = held.offsets.to_numpy()
    return ends - ends[0], held.flatten()


def _repeated(batch: pa.RecordBatch, keys: list[str], n: list[int]) -> list[pa.Array]:
    """The groups' keys, so many times each."""
    of = pa.array(np.repeat(np.arange(len(n)), n))
    return [batch.column(c).take(of) for c in keys]


def merge_sightings(detections: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Detections of one damage become one row: capture_id, class, surface, score, sightings, width_m, height_m, det_id (of the best).

    By falling score, a detection joins the first group of its class and surface whose leader is within half a metre of it, or where either has no centre.
    Sizes are medians of the known ones. A surface's detections are few and are handled together; surfaces are dealt to tasks by their number, and many go through a task in one batch.
    """
    kind = dict(detections.dtypes)["capture_id"]
    schema = f"capture_id {kind}, class string, surface string, score double, sightings long, width_m double, height_m double, det_id long"
    keys, own = ["capture_id", "class", "surface"], ["det_id", "score", "cx", "cy", "cz", "width_m", "height_m"]

    def groups_of(centre: np.ndarray) -> list[list[int]]:
        leaders: list[np.ndarray] = []
        groups: list[list[int]] = []
        for i in range(len(centre)):
            for n, lead in enumerate(leaders):
                if np.isnan(lead).any() or np.isnan(centre[i]).any() or np.linalg.norm(lead - centre[i]) < p.merge_distance:
                    groups[n].append(i)
                    break
            else:
                leaders.append(centre[i])
                groups.append([i])
        return groups

    def median(x: np.ndarray) -> float:
        x = x[~np.isnan(x)]
        return float(np.median(x)) if len(x) > 1 else float(x[0]) if len(x) else np.nan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = _lists(batch)
            score, wide, high, *centre = (values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("score", "width_m", "height_m", "cx", "cy", "cz"))
            centre = np.stack(centre, axis=1)
            n, groups = [], []
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                found = [i + np.array(x) for x in groups_of(centre[i:j])]
                n.append(len(found))
                groups += found
            if groups:
                best = np.array([x[0] for x in groups])
                sizes = [pa.array([median(v[x]) for x in groups], pa.float64(), from_pandas=True) for v in (wide, high)]
                said = [pa.array(score[best], from_pandas=True), pa.array([len(x) for x in groups], pa.int64()), *sizes, values.field("det_id").take(pa.array(best)).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays([*_repeated(batch, keys, n), *said], [*keys, "score", "sightings", "width_m", "height_m", "det_id"])

    return _ranked(dealt(detections.select(*keys, *own), DETECTIONS, *keys), keys, "det_id", own).mapInArrow(run, schema)


def scope_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCOPE), "class string, action string, basis string")


def surface_areas(rooms: DataFrame, walls: DataFrame) -> DataFrame:
    """surface, area: walls by length and their room's ceiling (null without one), floors and ceilings by floor area."""
    w = walls.join(keyed(rooms.select("capture_id", "room", "ceiling")), ["capture_id", "room"]).select("capture_id", F.col("wall").alias("surface"), (F.col("length") * F.col("ceiling")).alias("area"))
    flat = rooms.select("capture_id", F.explode(F.array(F.concat("room", F.lit("-floor")), F.concat("room", F.lit("-ceiling")))).alias("surface"), F.col("floor_area").alias("area"))
    return w.unionByName(flat)


def measured(damage: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Sizes with their ranges: length is the longer side, the area's relative range is twice a side's."""
    w, h = F.col("width_m"), F.col("height_m")
    rel = 2 * p.size_sigma
    return damage.withColumns({"width_pm95": rel * w, "height_pm95": rel * h, "area": w * h, "area_pm95": 2 * rel * w * h, "length": F.when(w.isNotNull() & h.isNotNull(), F.greatest(w, h))})


def concealed_flags(damage: DataFrame) -> DataFrame:
    """Rules that hint at damage out of sight, all that fire: damage_id, rule, condition, flag, surface. Sizes and heights that aren't known fire none."""
    c = F.col
    fires = {
        "C1": (c("class") == "water stain") & (c("surface_type") == "ceiling"),
        "C2": c("class").isin("water stain", "mould") & (c("surface_type") == "wall") & (c("height_above_floor") < 0.3),
        "C3": c("class") == "mould",
        "C4": (c("class") == "crack") & c("width_m").isNotNull() & c("height_m").isNotNull() & (F.greatest("width_m", "height_m") > 1.0),
    }
    said = [F.when(fires[rule], F.struct(F.lit(rule).alias("rule"), F.lit(condition).alias("condition"), F.lit(flag).alias("flag"))) for rule, condition, flag in RULES]
    fired = F.filter(F.array(*said), lambda x: x.isNotNull())
    return damage.select("damage_id", "surface", F.explode(fired).alias("f")).select("damage_id", "f.rule", "f.condition", "f.flag", "surface")


def repair_scope(damage: DataFrame, areas: DataFrame, scope: DataFrame) -> DataFrame:
    """damage_id, surface, action, quantity, unit: by the surface's area (else the damage's), its area with a margin of 30 cm, its length, or each.

    Where sizes aren't known, quantities are null; documents round them to two digits.
    """
    j = damage.join(F.broadcast(scope), "class").join(keyed(areas), ["capture_id", "surface"], "left")
    known = (F.col("width_m") > 0) & (F.col("height_m") > 0)
    quantity = F.when(F.col("basis") == "surface", F.when(F.col("surface_area") > 0, F.col("surface_area")).otherwise(F.when(known, F.col("area"))))
    quantity = quantity.when(F.col("basis") == "damage+margin", F.when(known, (F.col("width_m") + 0.6) * (F.col("height_m") + 0.6))).when(F.col("basis") == "length", F.when(F.col("width_m").isNotNull() & F.col("height_m").isNotNull(), F.greatest("width_m", "height_m"))).otherwise(1.0)
    unit = F.when(F.col("basis") == "length", "m").when(F.col("basis") == "count", "each").otherwise("m2")
    return j.select("damage_id", "surface", "action", quantity.alias("quantity"), unit.alias("unit"))


def locate(detections: DataFrame, pixels: DataFrame, floors: DataFrame, min_pixels: int = 5, min_depth: float = 0.2) -> DataFrame:
    """Detections with their place: medians of the sure pixels inside their box, size from box and distance, height over the floor.

    Boxes and pixels meet by picture and by the cells of a coarse grid that a box covers; a detection with fewer than ``min_pixels`` sure pixels gets none.
    """
    cell = 16
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int")))
    laid = detections.withColumn("cell_x", span("x0", "x1")).withColumn("cell_y", span("y0", "y1"))
    sure = pixels.where((F.col("conf") >= 2) & (F.col("depth") > min_depth)).withColumns({"cell_x": F.floor(F.col("col") / cell).cast("int"), "cell_y": F.floor(F.col("row") / cell).cast("int")})
    j = keyed(laid).join(sure, ["frame", "cell_x", "cell_y"]).where((F.col("col") >= F.col("x0")) & (F.col("col") <= F.col("x1")) & (F.col("row") >= F.col("y0")) & (F.col("row") <= F.col("y1")))
    m = j.groupBy("capture_id", "det_id", *BOX, "focal").agg(F.count("*").alias("n"), *[F.median(a).alias(f"c{a}") for a in "xyz"], F.median("depth").alias("distance")).where(F.col("n") >= min_pixels)
    size = lambda a, b: (F.col(b) - F.col(a)) * F.col("distance") / F.col("focal")
    return m.join(keyed(floors), "capture_id", "left").select("capture_id", "det_id", "n", "cx", "cy", "cz", size("x0", "x1").alias("width_m"), size("y0", "y1").alias("height_m"), (F.col("cy") - F.col("floor_y")).alias("height_above_floor"))


def without_depth(detections: DataFrame) -> DataFrame:
    """Detections of pictures without depth: the room is known, the surface isn't."""
    none = F.lit(None).cast("double")
    return detections.select("capture_id", "det_id", "class", "score", "room", F.concat("room", F.lit("-unknown")).alias("surface"), F.lit("unknown").alias("surface_type"), none.alias("width_m"), none.alias("height_m"))


def sightings(boxes: DataFrame, pixels: DataFrame, floors: DataFrame, corners: DataFrame, width: float, height: float, p: Params = DEFAULTS) -> DataFrame:
    """Detections in pictures with depth, placed on the plan: capture_id, det_id, class, score, seen_in, room, surface, surface_type, cx, cy, cz, width_m, height_m, height_above_floor.

    ``boxes`` have capture_id, frame, det_id, class, score, seen_in, x0 to y1, focal. They are cut to the picture, suppressed where they overlap, placed by their
    sure pixels (see ``locate``; those with too few are dropped) and laid on rooms (``corners``, see ``place_on_plan``) by their height over the floor.
    """
    from .outlines import place_on_plan

    cut = clip_boxes(boxes, width, height, p)
    kept = suppress(cut, ["capture_id", "frame"], "det_id", p).select("capture_id", "det_id")
    kept = cut.join(keyed(kept), ["capture_id", "det_id"], "left_semi")
    placed = locate(kept.select("capture_id", "frame", "det_id", *BOX, "focal"), pixels, floors)
    places = placed.select("capture_id", F.col("det_id").alias("id"), F.col("cx").alias("x"), F.col("height_above_floor").alias("y"), F.col("cz").alias("z"))
    on_plan = place_on_plan(places, corners, p).withColumnRenamed("id", "det_id")
    own = ["capture_id", "det_id"]
    return kept.select(*own, "class", "score", "seen_in").join(keyed(placed), own).join(keyed(on_plan), own).select(*own, "class", "score", "seen_in", "room", "surface", "surface_type", "cx", "cy", "cz", "width_m", "height_m", "height_above_floor")


def picture_sightings(detections: DataFrame) -> DataFrame:
    """Detections of pictures without depth in the form of ``sightings``: neither place nor size."""
    none = F.lit(None).cast("double")
    own = without_depth(detections).join(keyed(detections.select("capture_id", "det_id", "seen_in")), ["capture_id", "det_id"])
    return own.select("capture_id", "det_id", "class", "score", "seen_in", "room", "surface", "surface_type", none.alias("cx"), none.alias("cy"), none.alias("cz"), "width_m", "height_m", none.alias("height_above_floor"))


def damage_lists(seen: DataFrame, areas: DataFrame, p: Params = DEFAULTS) -> dict[str, DataFrame]:
    """What a document says of damage: the tables damage, concealed_damage_flags and scope, which refer to each other by ids.

    Sightings of one damage are merged; damages are numbered by falling score, D1 and on in each capture, and their line items S1 and on alike. ``areas`` are
    capture_id, surface, area.
    """
    best = seen.select("capture_id", "det_id", "room", "surface_type", "height_above_floor", "seen_in")
    merged = merge_sightings(seen, p).join(keyed(best), ["capture_id", "det_id"])
    number = F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("score"), "det_id")).cast("string")
    d = written(measured(merged.withColumn("number", number), p), "damages")
    name = lambda prefix: F.concat(F.lit(prefix), F.col("number"))
    known = (F.col("width_m") > 0) & (F.col("height_m") > 0)
    size = lambda c: g.measure(F.col(c), F.col(f"{c.removesuffix('_m')}_pm95"))
    listed = d.select(
        "capture_id", name("D").alias("id"), "class", F.round("score", 2).alias("score"), "room", "surface", "surface_type", "seen_in", F.col("sightings").cast("int").alias("sightings"), size("width_m").alias("width"), size("height_m").alias("height"),
        g.measure(F.when(known, F.col("area")), F.when(known, F.col("area_pm95"))).alias("area"), F.round("height_above_floor", 2).alias("height_above_floor"),
    )
    named = d.withColumn("damage_id", F.struct("capture_id", name("D").alias("id"), name("S").alias("item")))
    flags = concealed_flags(named).select("damage_id.capture_id", F.col("damage_id.id").alias("damage"), "rule", "condition", "flag", "surface")
    scope = repair_scope(named, areas.select("capture_id", "surface", F.col("area").alias("surface_area")), scope_table(seen.sparkSession))
    scope = scope.select("damage_id.capture_id", F.col("damage_id.item").alias("id"), "surface", F.col("damage_id.id").alias("damage"), "action", "quantity", "unit")
    return {"damage": listed, "concealed_damage_flags": flags, "scope": scope}


def detector_report(scores: DataFrame, listed: float = 0.10, reported: float = 0.30) -> DataFrame:
    return scores.where(F.col("score") >= listed).withColumn("status", F.when(F.col("score") >= reported, "reported").otherwise("listed"))


def quality_gate(rooms: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Why a room of photos isn't measured: the first reason that holds, null if none does."""
    reason = F.when(F.col("photos") < 2, "fewer than two photos").when(~F.col("found"), "no room found").when(F.col("sides") < p.min_sides, "fewer than three sides seen").when(F.col("spread") > p.max_ratio_spread, "depth ratios differ too much")
    return rooms.withColumn("reason", reason)

