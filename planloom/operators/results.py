"""The result document: nested rows, their contract, warnings, and reading documents back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import keyed

C = F.col


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
POINT, NAMES = T.ArrayType(_D), T.ArrayType(_S)
MEASURE = _struct(value=_D, pm95=_D, note=_S)
WALL = _struct(id=_S, start=POINT, end=POINT, length=MEASURE, detected=T.BooleanType())
ROOM = _struct(id=_S, name=_S, segment=_I, photos=_I, outline=T.ArrayType(POINT), shape=_S, width=MEASURE, length=MEASURE, floor_area=MEASURE, ceiling_height=MEASURE, walls=T.ArrayType(WALL))
OPENING = _struct(id=_S, type=_S, start=POINT, end=POINT, width=MEASURE, rooms=NAMES)
ADJACENT = _struct(rooms=NAMES, via=_S)
DAMAGE = _struct(**{"id": _S, "class": _S, "score": _D, "room": _S, "surface": _S, "surface_type": _S, "seen_in": _S, "sightings": _I, "width": MEASURE, "height": MEASURE, "area": MEASURE, "height_above_floor": _D})
FLAG = _struct(damage=_S, rule=_S, condition=_S, flag=_S, surface=_S)
SCOPE_ITEM = _struct(id=_S, surface=_S, damage=_S, action=_S, quantity=_D, unit=_S)
CAPTURE = _struct(id=_S, tier=_S, source=_S, frames=_I, frames_used=_I, processing_seconds=_D, plan_rotation_deg=_D, drift_sigma_m=_D)
DOCUMENT = _struct(
    schema_version=_S, capture=CAPTURE, units=_S, rooms=T.ArrayType(ROOM), openings=T.ArrayType(OPENING), adjacency=T.ArrayType(ADJACENT), property=_struct(room_count=_I, total_floor_area=MEASURE),
    damage=T.ArrayType(DAMAGE), concealed_damage_flags=T.ArrayType(FLAG), scope=T.ArrayType(SCOPE_ITEM), warnings=NAMES,
)
#: Fields that are left out where they aren't known; the contract wants the others, null or not.
OPTIONAL = ("segment", "photos", "outline", "note", "source", "frames", "frames_used", "plan_rotation_deg", "drift_sigma_m", "height_above_floor")
#: Lists of a document and their items. Numbered ids stand by their numbers.
LISTS = {"rooms": ROOM, "openings": OPENING, "adjacency": ADJACENT, "damage": DAMAGE, "concealed_damage_flags": FLAG, "scope": SCOPE_ITEM}


def _as(df: DataFrame, kind: T.StructType) -> F.Column:
    """A row as an item: columns by name, null where the table has none."""
    return F.struct(*[(C(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


def _listed(df: DataFrame, kind: T.StructType, name: str) -> DataFrame:
    ident = next((c for c in ("id", "damage", "via") if c in df.columns), None)
    order = [F.regexp_extract(C(ident), r"(\d+)", 1).try_cast("long").alias("o")] + ([C("rule").alias("r")] if "rule" in df.columns else []) if ident else []
    items = df.select("capture_id", *order, _as(df, kind).alias("item"))
    packed = F.sort_array(F.collect_list(F.struct(*[c for c in items.columns if c != "capture_id"])))
    return items.groupBy("capture_id").agg(F.transform(packed, lambda x: x["item"]).alias(name))


def documents(captures: DataFrame, warnings: DataFrame | None = None, **lists: DataFrame) -> DataFrame:
    """One document a capture, by the contract: capture_id, document (JSON).

    ``captures`` has capture_id, tier and what is known of the capture; ``warnings`` capture_id, ordinal, warning; ``lists`` are tables of the items of LISTS, with capture_id.
    What a capture has none of is an empty list. The total area is the sum of the rooms' known ones, with a note where some aren't known; it is null where none of them is.
    """
    unknown = set(lists) - set(LISTS)
    if unknown:
        raise ValueError(f"a document has no {sorted(unknown)}")
    if "scope" in lists:
        lists["scope"] = lists["scope"].withColumn("quantity", F.round("quantity", 2))
    capture = captures.withColumns({"id": C("capture_id").cast("string"), "processing_seconds": C("processing_seconds") if "processing_seconds" in captures.columns else F.lit(0.0)})
    j = capture.select("capture_id", _as(capture, CAPTURE).alias("capture"))
    for name, kind in LISTS.items():
        empty = F.array().cast(T.ArrayType(kind))
        j = j.join(keyed(_listed(lists[name], kind, name)), "capture_id", "left").withColumn(name, F.coalesce(name, empty)) if name in lists else j.withColumn(name, empty)
    if warnings is None:
        j = j.withColumn("warnings", F.array().cast(NAMES))
    else:
        said = warnings.groupBy("capture_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "warning"))), lambda x: x["warning"]).alias("warnings"))
        j = j.join(keyed(said), "capture_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast(NAMES)))
    area = lambda f: F.aggregate("rooms", F.lit(0.0), lambda t, r: t + F.coalesce(f(r["floor_area"]), F.lit(0.0)))
    n, known = F.size("rooms"), F.size(F.filter("rooms", lambda r: r["floor_area"]["value"].isNotNull()))
    some = lambda x: F.when((n == 0) | (known > 0), F.round(x, 3))
    note = F.when(known < n, F.concat(F.lit("sum over "), known.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" rooms (the rest not measured)")))
    total = F.struct(some(area(lambda m: m["value"])).alias("value"), some(F.sqrt(area(lambda m: m["pm95"] * m["pm95"]))).alias("pm95"), note.alias("note"))
    j = j.withColumn("property", F.struct(F.size("rooms").alias("room_count"), total.alias("total_floor_area"))).withColumns({"schema_version": F.lit("1.0"), "units": F.lit("metres")})
    text = F.to_json(F.struct(*[f.name for f in DOCUMENT.fields]), {"ignoreNullFields": "false"})
    # a quote inside a text is escaped, so this meets fields only
    return j.select("capture_id", F.regexp_replace(text, f',"({"|".join(OPTIONAL)})":null', "").alias("document"))


def explode_documents(docs: DataFrame) -> DataFrame:
    """Rooms of documents: capture_id, tier, room, shape, width, width_pm95, length, floor_area, ceiling_height, sides (walls that were detected)."""
    d = docs.select(F.from_json("document", DOCUMENT).alias("d"))
    r = d.select(C("d.capture.id").alias("capture_id"), C("d.capture.tier").alias("tier"), F.explode("d.rooms").alias("r"))
    return r.select("capture_id", "tier", C("r.id").alias("room"), C("r.shape").alias("shape"), C("r.width.value").alias("width"), C("r.width.pm95").alias("width_pm95"), C("r.length.value").alias("length"), C("r.floor_area.value").alias("floor_area"), C("r.ceiling_height.value").alias("ceiling_height"), F.size(F.filter("r.walls", lambda w: w["detected"])).alias("sides"))


def document_items(docs: DataFrame) -> DataFrame:
    """All that documents say, a row an item: capture_id, kind, id, detail, value, pm95."""
    d = docs.select(F.from_json("document", DOCUMENT).alias("d")).select(C("d.capture.id").alias("capture_id"), "d.*")
    joined = lambda *parts: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("-")) for x in parts])
    none = F.lit(None).cast("double")

    def items(name: str, *rows) -> DataFrame:
        one = d.select("capture_id", F.posexplode(name).alias("at", "r"))
        told = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), ident.alias("id"), detail.cast("string").alias("detail"), value.cast("double").alias("value"), pm95.cast("double").alias("pm95")) for kind, ident, detail, value, pm95 in rows]))
        return one.select("capture_id", told.alias("x")).select("capture_id", "x.*")

    r = C("r")
    size = lambda c: (c, r["id"], r[c]["note"], r[c]["value"], r[c]["pm95"])
    rooms = items("rooms", ("room", r["id"], joined(r["name"], r["shape"], r["segment"], r["photos"], F.size(r["walls"])), none, none), *[size(c) for c in ("width", "length", "floor_area", "ceiling_height")])
    walls = d.select("capture_id", F.explode("rooms").alias("room")).select("capture_id", F.explode("room.walls").alias("w")).select("capture_id", F.lit("wall").alias("kind"), "w.id", C("w.detected").cast("string").alias("detail"), "w.length.value", "w.length.pm95")
    openings = items("openings", ("opening", r["id"], joined(r["type"], F.concat_ws("+", r["rooms"])), r["width"]["value"], r["width"]["pm95"]))
    adjacent = items("adjacency", ("adjacent", r["via"], F.concat_ws("+", r["rooms"]), none, none))
    damage = items("damage", ("damage", r["id"], joined(r["class"], r["room"], r["surface"], r["surface_type"], r["seen_in"], r["sightings"], r["height_above_floor"]), r["score"], none), *[(f"damage {c}", r["id"], r[c]["note"], r[c]["value"], r[c]["pm95"]) for c in ("width", "height", "area")])
    flags = items("concealed_damage_flags", ("flag", F.concat(r["damage"], F.lit(" "), r["rule"]), joined(r["condition"], r["flag"], r["surface"]), none, none))
    scope = items("scope", ("scope", r["id"], joined(r["damage"], r["surface"], r["action"], r["unit"]), r["quantity"], none))
    said = items("warnings", ("warning", (C("at") + 1).cast("string"), r, none, none))
    total = d.select("capture_id", F.lit("total").alias("kind"), C("property.room_count").cast("string").alias("id"), C("property.total_floor_area.note").alias("detail"), "property.total_floor_area.value", "property.total_floor_area.pm95")
    out = rooms
    for other in (walls, openings, adjacent, damage, flags, scope, said, total):
        out = out.unionByName(other)
    return out


def violations(rooms: DataFrame, captures: DataFrame, openings: DataFrame | None = None, adjacency: DataFrame | None = None) -> DataFrame:
    """Rows that break the contract: capture_id, item, rule. ``write_documents`` stops where there are any."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    broken_range = lambda c: C(f"{c}.value").isNotNull() & F.coalesce(C(f"{c}.pm95") < 0, F.lit(True))

    def told(df: DataFrame, item: str, rules: list) -> DataFrame:
        broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
        return df.select("capture_id", C(item).alias("item"), F.explode(broken).alias("rule"))

    own = [
        ("room id", no(C("id").rlike(r"^R\d+$"))), ("shape", no(C("shape").isin("rectangular", "not rectangular", "not measured"))),
        *[(f"{c} range", broken_range(c)) for c in ("width", "length", "floor_area", "ceiling_height")], ("negative area", F.coalesce(C("floor_area.value") < 0, F.lit(False))),
    ]
    if "walls" in rooms.columns:
        own.append(("wall", F.exists(F.coalesce("walls", F.array().cast(rooms.schema["walls"].dataType)), lambda w: no(w["id"].rlike(r"^R\d+-W\d+$")) | w["detected"].isNull() | w["length"]["value"].isNull() | no(F.size(w["start"]) == 2) | no(F.size(w["end"]) == 2))))
    if "outline" in rooms.columns:
        own.append(("outline", F.coalesce(F.size("outline") < 3, F.lit(False)) & C("outline").isNotNull()))
    out = told(rooms, "id", own)
    out = out.unionByName(captures.where(no(C("tier").isin("lidar", "video", "photo"))).select("capture_id", F.lit("capture").alias("item"), F.lit("tier").alias("rule")))
    if openings is not None:
        out = out.unionByName(told(openings, "id", [("opening id", no(C("id").rlike(r"^O\d+$"))), ("opening type", no(C("type").isin("door", "opening", "window"))), ("width range", broken_range("width"))]))
    if adjacency is not None:
        out = out.unionByName(told(adjacency, "via", [("two rooms", no(F.size("rooms") == 2))]))
    return out


def write_documents(docs: DataFrame, broken: DataFrame, path: str) -> None:
    """Writes one JSON document a line, unless ``broken`` (see ``violations``) has rows."""
    first = broken.limit(5).collect()
    if first:
        raise ValueError(f"documents break the contract: {[tuple(r) for r in first]}")
    docs.select(C("document").alias("value")).write.text(path)


def write_debug(path: str, **tables: DataFrame) -> None:
    """Writes the steps of a plan (layout, drift, segments ...) as JSON lines, a folder for each table, by capture."""
    for name, df in tables.items():
        df.write.partitionBy("capture_id").json(f"{path}/{name}")


def segment_panels(rooms: DataFrame, openings: DataFrame) -> DataFrame:
    """Panels of a plan of several segments: capture_id, segment, rooms, openings (those that touch any of its rooms), sorted ids."""
    r = rooms.where("segment is not null").select("capture_id", "segment", "id")
    touched = openings.select("capture_id", C("id").alias("opening"), F.explode("rooms").alias("id"))
    j = r.join(keyed(touched), ["capture_id", "id"], "left")
    return j.groupBy("capture_id", "segment").agg(F.sort_array(F.collect_set("id")).alias("rooms"), F.sort_array(F.collect_set("opening")).alias("openings"))


#: Sentences of the contract that hold for a whole document.
RANGES_SAID = "Ranges assume a 5 mm sensor bias per surface plus measured scatter and drift; they have not yet been checked against tape measurements."
SCALE_SAID = "Sizes come from an AI depth model; every range includes a %d%% (1 sigma) size uncertainty."
VIDEO_SAID = (
    "Video: rooms are measured separately in %d of %d video segments and are NOT stitched into one plan; the same real room may be listed once per segment that saw it, so the total floor area can double count.",
    "Only rooms with walls found on at least %d of 4 sides are reported.",
)
PHOTO_SAID = (
    "Photo tier: rooms are reconstructed from their photos with VGGT and given a size with an AI depth model; a room's numbers are reported only if it passes a quality check, otherwise it is "
    "listed as not measured. Rooms are not placed relative to each other; plan.png is a schematic."
)


def said_first(captures: DataFrame, *sentences) -> DataFrame:
    """Warnings of whole documents, before those of rooms: capture_id, ordinal, warning. Sentences are texts or columns of ``captures``."""
    n = len(sentences)
    rows = F.array(*[F.struct(F.lit(i - n).alias("ordinal"), (F.lit(x) if isinstance(x, str) else x).alias("warning")) for i, x in enumerate(sentences)])
    return captures.select("capture_id", F.explode(rows).alias("w")).select("capture_id", "w.*")


def warnings(rooms: DataFrame) -> DataFrame:
    """What readers of a plan should know of each room, in order of rooms: capture_id, ordinal, warning.

    ``rooms`` has capture_id, id, shape, area, missing (names of sides without a wall), ceiling, note.
    """
    n = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    merged = F.when(C("area") > 15, " It may be two spaces merged (no wall or door found between them).").otherwise("")
    rules = [
        (C("shape") == "not rectangular", F.concat("id", F.lit(" is not rectangular; its outline is traced from the seen floor and snapped to walls where found."), merged)),
        (F.size("missing") > 0, F.concat("id", F.lit(": no wall found on side(s) "), F.concat_ws(", ", "missing"), F.lit("; those sides use the edge of the seen floor."))),
        (C("ceiling").isNull(), F.concat("id", F.lit(": "), F.coalesce("note", F.lit("ceiling not measured")), F.lit("."))),
    ]
    rows = F.filter(F.array(*[F.when(when, F.struct((n * 10 + i).alias("ordinal"), said.alias("warning"))) for i, (when, said) in enumerate(rules)]), lambda x: x.isNotNull())
    return rooms.select("capture_id", F.explode(rows).alias("w")).select("capture_id", "w.*")


def tiers(files: DataFrame) -> DataFrame:
    """Tier of each folder from its files (folder, path): depth pictures with their odometry, a folder with a video, or rooms of photos.

    The first that fits counts; null means that none does. A folder of photos has sub-folders that each hold an image; what else lies in them doesn't count.
    """
    p = F.lower("path")
    video, image = p.rlike(r"\.(mp4|mov|m4v)$"), p.rlike(r"\.(jpg|jpeg|png|heic)$")
    parts = F.split("path", "/")
    nested = F.size(parts) > 1
    sub = files.groupBy("folder", F.when(nested, F.get(parts, F.lit(0))).alias("sub")).agg(
        F.bool_or(C("path") == "odometry.csv").alias("odometry"), F.bool_or(video & ~nested).alias("video"), F.bool_or(image & (F.size(parts) == 2)).alias("image"))
    m = sub.groupBy("folder").agg(
        F.bool_or(F.coalesce(C("sub") == "depth", F.lit(False))).alias("depth"), F.bool_or("odometry").alias("odometry"), F.bool_or("video").alias("video"),
        F.bool_and(F.when(C("sub").isNotNull(), C("image"))).alias("photos"),
    )
    tier = F.when(C("depth") & C("odometry"), "lidar").when(C("video"), "video").when(F.coalesce("photos", F.lit(False)), "photo")
    return m.select("folder", tier.alias("tier"))
