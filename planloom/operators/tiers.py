"""Documents of captures without depth: rooms measured segment by segment of a video, or folder by folder of photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..params import DEFAULTS, Params
from . import results as rs

C = F.col
#: Relative error (one sigma) of the scale of videos and of photos.
VIDEO_SIGMA, PHOTO_SIGMA = 0.10, 0.15


def _widened(measure: Column, sigma: float, power: int = 1) -> Column:
    """A measure with the scale's error in its range; what isn't measured stays so."""
    return F.struct(measure["value"].alias("value"), F.round(g.widen(measure["value"], measure["pm95"], sigma, power), 3).alias("pm95"), measure["note"].alias("note"))


def widen_rooms(rooms: DataFrame, sigma: float) -> DataFrame:
    """Rooms with the scale's error in all ranges: of lengths once, of areas twice, of each wall's length."""
    walls = F.transform("walls", lambda w: w.withField("length", _widened(w["length"], sigma)))
    return rooms.withColumns({**{c: _widened(C(c), sigma) for c in ("width", "length", "ceiling_height")}, "floor_area": _widened(C("floor_area"), sigma, 2), "walls": walls})


def _named_walls() -> Column:
    """Walls with their ids by the room's new id and their place."""
    return F.transform("walls", lambda w, i: w.withField("id", F.concat(C("id"), F.lit("-W"), (i + 1).cast("string"))))


def video_rooms(rooms: DataFrame, sigma: float = VIDEO_SIGMA, p: Params = DEFAULTS) -> DataFrame:
    """The complete rooms of all segments, numbered through, with widened ranges: the items of a document and room_id, the number that the segment gave.

    ``rooms`` are capture_id, segment, room_id, sides and the measures of a document's room. A room with fewer than three sides found would be a guess and is left out.
    """
    kept = rooms.where(C("sides") >= p.min_sides)
    number = F.row_number().over(Window.partitionBy("capture_id").orderBy("segment", "room_id")).cast("string")
    named = kept.withColumn("number", number).withColumns({"id": F.concat(F.lit("R"), C("number")), "name": F.concat(F.lit("Room "), C("number"), F.lit(" (segment "), C("segment").cast("string"), F.lit(")"))})
    return widen_rooms(named.withColumn("walls", _named_walls()), sigma).drop("number", "sides")


def video_openings(openings: DataFrame, kept: DataFrame, sigma: float = VIDEO_SIGMA) -> tuple[DataFrame, DataFrame]:
    """The openings that touch a kept room, numbered through, with the rooms' new ids, and the pairs of rooms that one joins.

    ``openings`` are capture_id, segment, gap_idx, start, end, width (a measure), rooms (room ids of the segment); ``kept`` comes from ``video_rooms``.
    """
    key = ["capture_id", "segment", "gap_idx"]
    ids = kept.select("capture_id", "segment", "room_id", "id")
    touched = openings.select(*key, F.posexplode("rooms").alias("at", "room_id")).join(ids, ["capture_id", "segment", "room_id"])
    names = touched.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("names"))
    number = F.row_number().over(Window.partitionBy("capture_id").orderBy("segment", "gap_idx")).cast("string")
    j = openings.join(names, key).withColumn("id", F.concat(F.lit("O"), number)).withColumn("width", _widened(C("width"), sigma))
    named = j.select("capture_id", "id", F.lit("door").alias("type"), "start", "end", "width", C("names").alias("rooms"))
    return named, named.where(F.size("rooms") == 2).select("capture_id", "rooms", C("id").alias("via"))


def video_documents(segments: DataFrame, rooms: DataFrame, openings: DataFrame, sigma: float = VIDEO_SIGMA, p: Params = DEFAULTS, **lists: DataFrame) -> DataFrame:
    """One document for each video: capture_id, document.

    ``segments`` (capture_id, segment, skipped: why a segment couldn't be used, else null) has all segments of all videos; a video of which no segment can be used gets no document. Rooms of
    different segments aren't placed relative to each other; the same room may be listed by each segment that saw it. ``lists`` are the tables of ``damage_lists``.
    """
    kept = rs_rooms(video_rooms(rooms.join(segments.where("skipped is null").select("capture_id", "segment"), ["capture_id", "segment"], "left_semi"), sigma, p))
    named, joined = video_openings(openings, kept, sigma)
    counts = segments.groupBy("capture_id").agg(F.count(F.when(C("skipped").isNull(), 1)).alias("used"), F.count("*").alias("all")).where("used > 0")
    captures = counts.withColumn("tier", F.lit("video"))
    said = rs.said_first(captures, F.format_string(rs.VIDEO_SAID[0], "used", "all"), rs.VIDEO_SAID[1] % p.min_sides, rs.SCALE_SAID % round(100 * sigma), rs.RANGES_SAID)
    return rs.documents(captures, said, rooms=kept.drop("room_id"), openings=named, adjacency=joined, **lists)


def rs_rooms(rooms: DataFrame) -> DataFrame:
    """Only what a document's room has, and room_id."""
    return rooms.select("capture_id", "room_id", *[c for c in rs.ROOM.fieldNames() if c in rooms.columns])


#: Reasons why a folder of photos isn't measured.
NO_PHOTOS, NO_ROOM, FEW_SIDES, NO_MATCH = "fewer than 2 photos", "no room outline found in the reconstruction", "walls found on only %d of 4 sides", "photos disagree on size by %.0f%%"


def photo_rooms(folders: DataFrame, rooms: DataFrame, sigma: float = PHOTO_SIGMA, p: Params = DEFAULTS) -> DataFrame:
    """A room for each folder of photos, measured if it passes the gate, else with the reason: the items of a document and reason.

    ``folders`` are capture_id, name, photos, spread (of the photos' depth ratios); ``rooms`` capture_id, name, room_id, rough (area), sides and the measures of a document's room: what the
    folder's reconstruction gave, of which the largest counts. Folders are numbered by their names.
    """
    own = [c for c in rooms.columns if c not in ("capture_id", "name", "room_id", "rough", "sides")]
    best = rooms.groupBy("capture_id", "name").agg(F.max_by(F.struct("sides", *own), F.struct(C("rough"), -C("room_id"))).alias("r"))
    j = folders.join(best, ["capture_id", "name"], "left")
    number = F.row_number().over(Window.partitionBy("capture_id").orderBy("name")).cast("string")
    sides = C("r.sides")
    reason = (
        F.when(C("photos") < 2, NO_PHOTOS).when(C("r").isNull(), NO_ROOM).when(sides < p.min_sides, F.format_string(FEW_SIDES, sides.cast("int")))
        .when(C("spread") > p.max_ratio_spread, F.format_string(NO_MATCH, 100 * C("spread").cast("double")))
    )
    j = j.withColumn("id", F.concat(F.lit("R"), number)).withColumn("reason", reason)
    good, note = C("reason").isNull(), F.concat(F.lit("not measured: "), C("reason"))
    blank = lambda c: F.when(good, C(f"r.{c}")).otherwise(F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("pm95"), note.alias("note")))
    measures = ("width", "length", "floor_area", "ceiling_height")
    walls = F.when(good, C("r.walls")).otherwise(F.array().cast(T.ArrayType(rs.WALL)))
    listed = j.select("capture_id", "id", "name", C("photos").cast("int").alias("photos"), "reason", F.when(good, C("r.outline")).alias("outline"), F.when(good, C("r.shape")).otherwise("not measured").alias("shape"), *[blank(c).alias(c) for c in measures], walls.alias("walls"))
    return widen_rooms(listed.withColumn("walls", _named_walls()), sigma)


def photo_links(photos: DataFrame, named: DataFrame) -> DataFrame:
    """Rooms whose folders hold a photo of the same content, as a doorway's is: capture_id, rooms, via; a row for each such pair of photos.

    ``photos`` are capture_id, name (of the folder), photo, content. Copies in one folder join nothing. Contents meet by their digests, and a row is made only for pairs of folders.
    """
    held = photos.select("capture_id", "name", "photo", F.sha1("content").alias("hash")).join(named.select("capture_id", "name", "id"), ["capture_id", "name"])
    n = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    one = held.groupBy("capture_id", "hash", n.alias("n")).agg(F.min("photo").alias("photo"))
    side = lambda x: one.select("capture_id", "hash", C("n").alias(f"n{x}"), C("photo").alias(f"photo{x}"))
    j = side("a").join(side("b"), ["capture_id", "hash"]).where("na < nb")
    room = lambda c: F.concat(F.lit("R"), C(c).cast("string"))
    return j.select("capture_id", F.array(room("na"), room("nb")).alias("rooms"), F.concat(F.lit("shared photo "), "photoa").alias("via"))


def photo_documents(folders: DataFrame, rooms: DataFrame, photos: DataFrame, sigma: float = PHOTO_SIGMA, p: Params = DEFAULTS, **lists: DataFrame) -> DataFrame:
    """One document for each capture of photo folders: capture_id, document.

    Rooms that fail the gate are listed with the reason; the total is over the measured ones and says so. What joins rooms are photos that their folders share.
    """
    own = photo_rooms(folders, rooms, sigma, p)
    captures = folders.select("capture_id").distinct().withColumn("tier", F.lit("photo"))
    number = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    why = own.where("reason is not null").select("capture_id", number.alias("ordinal"), F.concat("id", F.lit(" ("), "name", F.lit("): not measured: "), "reason", F.lit(".")).alias("warning"))
    said = rs.said_first(captures, rs.PHOTO_SAID).unionByName(why)
    return rs.documents(captures, said, rooms=own.drop("reason"), adjacency=photo_links(photos, own), **lists)
