"""Cameras, damage and documents against what they were made from."""

import json

import numpy as np
import pandas as pd

from planloom.functions import geometry as g
from planloom.operators import checks as ck
from planloom.operators import damage as dm
from planloom.operators import results as rs
from planloom.operators import tiers as tr
from pyspark.sql import functions as F


def quaternion(axis, degrees):
    axis = np.array(axis, float) / np.linalg.norm(axis)
    return [*(np.sin(np.radians(degrees) / 2) * axis), np.cos(np.radians(degrees) / 2)]


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def umeyama(a, b):
    ma, mb = a.mean(0), b.mean(0)
    u, d, vt = np.linalg.svd((b - mb).T @ (a - ma) / len(a))
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r = u @ flip @ vt
    s = (d * np.diag(flip)).sum() / (a - ma).var(axis=0).sum()
    return s, r, mb - s * r @ ma


def test_cameras_with_noise_equal_numpy(spark):
    r = np.random.default_rng(1)
    n = 30
    true = np.cumsum(r.normal(size=(n, 3)) * 0.2, axis=0)
    tq = [quaternion(r.normal(size=3), r.uniform(0, 180)) for _ in range(n)]
    turn = matrix(quaternion([1, 2, 3], 70))
    seen = ((true + r.normal(size=(n, 3)) * 0.02) - [1, 2, 3]) @ turn / 2.5
    q = [quaternion(r.normal(size=3), r.uniform(0, 180)) for _ in range(n)]
    cols = ["frame", *[f"p{c}" for c in "xyz"], *[f"q{c}" for c in "xyzw"], *[f"tp{c}" for c in "xyz"], *[f"tq{c}" for c in "xyzw"]]
    df = spark.createDataFrame(pd.DataFrame([[i, *seen[i], *q[i], *true[i], *tq[i]] for i in range(n)], columns=cols).assign(g=1))
    got = ck.camera_check(df, ["g"]).first()
    s, rot, t = umeyama(seen, true)
    err = np.linalg.norm(s * seen @ rot.T + t - true, axis=1)
    path = np.linalg.norm(np.diff(true, axis=0), axis=1).sum()
    view = [np.degrees(np.arccos(np.clip((rot @ matrix(a)[:, 2]) @ matrix(b)[:, 2], -1, 1))) for a, b in zip(q, tq, strict=True)]
    rel = lambda qs, i: matrix(qs[i - 1]).T @ matrix(qs[i])
    turns = [np.degrees(np.arccos(np.clip((np.trace(rel(tq, i).T @ rel(q, i)) - 1) / 2, -1, 1))) for i in range(1, n)]
    want = [n, path, np.sqrt((err**2).mean()), err.max(), 100 * np.sqrt((err**2).mean()) / path, s, np.mean(view), max(view), np.mean(turns), max(turns)]
    assert np.allclose(list(got)[1:], want, rtol=1e-6)
    few = df.where("frame < 2")
    assert ck.camera_check(few, ["g"]).collect() == []
    note = ck.piece_check(few, spark.createDataFrame([(1, 2.0)], "g long, scale double"), spark.createDataFrame([(1, 0.0, 1.0, 0.0)], "g long, x double, y double, z double"), ["g"]).first()
    assert (note.placed, note.scale_error, note.note) == (2, None, "too few spots to scale")


def test_turns_between_orientations(spark):
    row = [*quaternion([1, 0, 0], 1e-6), *quaternion([1, 0, 0], 3e-6)]
    df = spark.createDataFrame([tuple(map(float, row))], "ax double, ay double, az double, aw double, bx double, by double, bz double, bw double")
    a, b = (tuple(F.col(f"{n}{c}") for c in "xyzw") for n in "ab")
    minus = tuple(-x for x in b)
    got = df.select(g.turn_between(a, b).alias("t"), g.turn_between(a, minus).alias("m"), g.turn_between(a, tuple(x * 0 for x in b)).alias("none")).first()
    assert abs(got.t - 2e-6) < 1e-12 and abs(got.m - 2e-6) < 1e-12 and got.none is None


SEEN = "capture_id string, det_id long, class string, score double, seen_in string, room string, surface string, surface_type string, cx double, cy double, cz double, width_m double, height_m double, height_above_floor double"


def test_damage_is_merged_and_numbered(spark):
    rows = [
        ("a", 1, "crack", 0.5, "frame 1", "R1", "R1-W2", "wall", 0.0, 1.0, 0.0, 0.2, 1.4, 1.0), ("a", 2, "crack", 0.9, "frame 2", "R1", "R1-W2", "wall", 0.3, 1.0, 0.0, 0.4, None, 1.0), ("a", 3, "crack", 0.8, "frame 3", "R1", "R1-W2", "wall", 2.0, 1.0, 0.0, None, None, 1.0),
        ("a", 4, "mould", 0.9, "frame 4", None, None, "unknown", None, None, None, None, None, None), ("a", 5, "mould", 0.3, "photo", None, None, "unknown", None, None, None, 0.5, 0.5, None), ("b", 6, "hole", 0.4, "p", "R9", "R9-unknown", "unknown", None, None, None, None, None, None),
    ]
    areas = spark.createDataFrame([("a", "R1-W2", 6.0)], "capture_id string, surface string, area double")
    got = {k: sorted((tuple(x) for x in v.collect()), key=str) for k, v in dm.damage_lists(spark.createDataFrame(rows, SEEN), areas).items()}
    assert [(d[0], d[1], d[2], d[3], d[8]) for d in got["damage"]] == [("a", "D1", "crack", 0.9, 2), ("a", "D2", "mould", 0.9, 2), ("a", "D3", "crack", 0.8, 1), ("b", "D1", "hole", 0.4, 1)]
    one = got["damage"][0]
    assert tuple(one[9]) == (0.3, 0.09, None) and tuple(one[10]) == (1.4, 0.42, None)
    assert [(f[1], f[2]) for f in got["concealed_damage_flags"]] == [("D1", "C4"), ("D2", "C3")]
    assert [(s[1], s[3], s[5], s[6]) for s in got["scope"]] == [("S1", "D1", 1.4, "m"), ("S2", "D2", (0.5 + 0.6) ** 2, "m2"), ("S3", "D3", None, "m"), ("S1", "D1", 1.0, "each")]
    empty = dm.damage_lists(spark.createDataFrame([], SEEN), areas)
    assert all(v.count() == 0 for v in empty.values())


MEASURE = "struct<value:double,pm95:double,note:string>"
ROOMS = f"capture_id long, segment int, room_id int, sides int, shape string, outline array<array<double>>, width {MEASURE}, length {MEASURE}, floor_area {MEASURE}, ceiling_height {MEASURE}, walls array<struct<id:string,start:array<double>,end:array<double>,length:{MEASURE},detected:boolean>>"


def test_video_documents(spark):
    m = lambda v: (v, 0.0, None)
    room = lambda c, s, r, sides, w: (c, s, r, sides, "rectangular", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]], m(w), m(2.0), m(2 * w), (None, None, "ceiling not seen"), [("x", [0.0, 0.0], [w, 0.0], m(w), True)])
    rooms = spark.createDataFrame([room(1, 2, 4, 3, 5.0), room(1, 2, 1, 2, 9.0), room(1, 1, 2, 4, 3.0), room(1, 3, 1, 4, 7.0), room(2, 1, 1, 1, 3.0)], ROOMS)
    segments = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "tilted"), (2, 1, None), (3, 1, "tilted")], "capture_id long, segment int, skipped string")
    openings = spark.createDataFrame([(1, 2, 1, [0.0, 0.0], [0.0, 1.0], m(1.0), [1, 4]), (1, 2, 2, [0.0, 0.0], [0.0, 1.0], m(1.0), [1]), (1, 1, 5, [0.0, 0.0], [0.0, 1.0], m(1.0), [2, 2])], f"capture_id long, segment int, gap_idx int, start array<double>, end array<double>, width {MEASURE}, rooms array<int>")
    docs = {r.capture_id: json.loads(r.document) for r in tr.video_documents(segments, rooms, openings).collect()}
    assert set(docs) == {1, 2}  # of the third video nothing could be used
    one = docs[1]
    assert [(r["id"], r["name"], r["segment"], r["walls"][0]["id"], r["width"]["value"]) for r in one["rooms"]] == [("R1", "Room 1 (segment 1)", 1, "R1-W1", 3.0), ("R2", "Room 2 (segment 2)", 2, "R2-W1", 5.0)]
    assert one["rooms"][1]["width"]["pm95"] == 1.0 and one["rooms"][1]["floor_area"]["pm95"] == 4.0 and one["rooms"][1]["walls"][0]["length"]["pm95"] == 1.0 and one["rooms"][1]["ceiling_height"] == {"value": None, "pm95": None, "note": "ceiling not seen"}
    assert [(o["id"], o["rooms"], o["width"]["pm95"]) for o in one["openings"]] == [("O1", ["R1", "R1"], 0.2), ("O2", ["R2"], 0.2)]
    assert one["property"] == {"room_count": 2, "total_floor_area": {"value": 16.0, "pm95": round(float(np.hypot(2.4, 4.0)), 3)}}
    assert one["warnings"][0].startswith("Video: rooms are measured separately in 2 of 3 video segments") and one["warnings"][2:] == [rs.SCALE_SAID % 10, rs.RANGES_SAID]
    assert docs[2]["rooms"] == [] and docs[2]["property"]["total_floor_area"]["value"] == 0.0


def test_photo_documents(spark):
    m = lambda v: (v, 0.0, None)
    room = lambda n, r, rough, sides: (1, n, r, rough, sides, "rectangular", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]], m(rough / 2), m(2.0), m(rough), m(2.5), [("x", [0.0, 0.0], [1.0, 0.0], m(1.0), True)])
    rooms = spark.createDataFrame([room("bath", 1, 4.0, 4), room("bath", 2, 8.0, 3), room("hall", 1, 6.0, 2), room("kitchen", 1, 6.0, 4), room("attic", 1, 6.0, 4)], ROOMS.replace("segment int, room_id int, sides int", "name string, room_id int, rough double, sides int"))
    folders = spark.createDataFrame([(1, "kitchen", 5, 0.134), (1, "bath", 2, 0.1), (1, "hall", 9, 0.5), (1, "cellar", 3, None), (1, "attic", 1, 0.0)], "capture_id long, name string, photos int, spread double")
    photos = spark.createDataFrame([(1, "bath", "b.jpg", b"x"), (1, "hall", "h.jpg", b"x"), (1, "hall", "h2.jpg", b"x"), (1, "hall", "h3.jpg", b"y"), (1, "hall", "h4.jpg", b"y"), (1, "attic", "a.jpg", None), (1, "cellar", "c.jpg", None)], "capture_id long, name string, photo string, content binary")
    doc = json.loads(tr.photo_documents(folders, rooms, photos).first().document)
    said = [(r["id"], r["name"], r["photos"], r["width"]["note"] if "note" in r["width"] else r["width"]["value"]) for r in doc["rooms"]]
    assert said == [("R1", "attic", 1, "not measured: fewer than 2 photos"), ("R2", "bath", 2, 4.0), ("R3", "cellar", 3, "not measured: no room outline found in the reconstruction"), ("R4", "hall", 9, "not measured: walls found on only 2 of 4 sides"), ("R5", "kitchen", 5, "not measured: photos disagree on size by 13%")]
    assert doc["rooms"][1]["width"]["pm95"] == 1.2 and doc["rooms"][1]["walls"][0]["id"] == "R2-W1" and doc["rooms"][0]["walls"] == [] and "outline" not in doc["rooms"][0] and doc["rooms"][0]["shape"] == "not measured"
    assert doc["adjacency"] == [{"rooms": ["R2", "R4"], "via": "shared photo b.jpg"}]
    assert doc["property"] == {"room_count": 5, "total_floor_area": {"value": 8.0, "pm95": 4.8, "note": "sum over 1 of 5 rooms (the rest not measured)"}}
    assert doc["warnings"][0] == rs.PHOTO_SAID and doc["warnings"][1] == "R1 (attic): not measured: fewer than 2 photos." and len(doc["warnings"]) == 5
    none = json.loads(tr.photo_documents(folders, rooms.limit(0), photos).first().document)
    assert none["property"]["total_floor_area"] == {"value": None, "pm95": None, "note": "sum over 0 of 5 rooms (the rest not measured)"}
