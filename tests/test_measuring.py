"""Operators against truth that is known by construction."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planloom.operators import damage as dm
from planloom.operators import frames as fr
from planloom.operators import motion as mo
from planloom.operators import outlines as ol
from planloom.operators import points as pt
from planloom.operators import raster as rs
from planloom.operators import walls as wl
from planloom.params import Params
from planloom.plans import plan, results, scene
from planloom.sources import captures as sc

SF = "/root/testdata/sf0.001"


def test_homes_are_measured(spark):
    """Two rooms each, with their true sizes, whether or not the end of the wall between them was seen."""
    p, levels, walls, gaps, cells = plan._home(spark, SF)
    heights = wl.room_heights(p, cells, levels)
    rooms = wl.measure_rooms(cells, wl.bounding_walls(walls, cells), wl.drift_of_floors(heights)).collect()
    truth = {r.capture_id: r for r in scene.homes(spark, SF).collect()}
    assert len(rooms) == 2 * len(truth) and any(k % 4 == 1 for k in truth)
    for r in rooms:
        home = truth[r.capture_id]
        assert r.sides == 4 and abs(r.length - home.deep * 0.05) < 1e-6
        assert min(abs(r.width - home.wide * 0.05), abs(r.width - 3.0)) < 1e-6
        assert abs(r.floor_area - r.width * r.length) < 1e-9 and 0 < r.width_pm95 < 0.02 and r.shape == "rectangular"
    doors = sorted((d.capture_id, round(d.width, 3)) for d in gaps.where("kind = 'door'").collect())
    assert [w for _, w in doors if w == 0.85] == [0.85] * len(truth)
    assert sorted(k for k, w in doors if w != 0.85) == sorted(k for k in truth if k % 4 == 1)
    # the whole floor is of one room or the other, the patch that wasn't seen and the floor below the table too
    sizes = {(r.capture_id, r.room_id): r.n for r in cells.groupBy("capture_id", "room_id").agg(F.count("*").alias("n")).collect()}
    for (k, room), n in sizes.items():
        full = min((truth[k].wide, 60), key=lambda w: abs(w * truth[k].deep - n)) * truth[k].deep
        assert 0.88 * full < n <= full, (k, room)
    for h in heights.collect():
        assert abs(h.floor_y - 0.003) < 1e-9 and abs(h.ceiling_y - 2.503) < 1e-9 and h.ceiling_seen > 0.2 and h.note is None
    joined = wl.adjacency(wl.door_rooms(plan.numbered_gaps(gaps), cells)).collect()
    assert {(x.capture_id, x.a, x.b) for x in joined} == {(k, 1, 2) for k in truth}
    assert all(abs(x.ceiling_y - x.floor_y - 2.5) < 0.03 for x in levels.collect())


def test_a_wall_bounds_a_room_along_half_of_the_stretch_that_they_share(spark):
    """One wall touches the room in a tenth of its stretch, another in six tenths, a third stands within it, a fourth has much of the room beyond it."""
    cells = spark.createDataFrame([(1, r, c, 1) for r in range(40) for c in range(40)], "capture_id long, row int, col int, room_id int")
    notched = cells.where("not (row >= 4 and col < 8)")  # the low side of x is touched in a tenth
    mostly = cells.where("not (row >= 24 and col < 8)")  # and here in six tenths
    wall = lambda i, axis, at: (1, i, axis, at, 0.0, 2.0, 900)
    walls = spark.createDataFrame([wall(0, "x", 0.0), wall(1, "x", 1.0), wall(2, "z", 2.0), wall(3, "z", 1.6)], "capture_id long, wall_idx int, axis string, position double, start double, end double, points long")
    sides = lambda c: sorted((r.wall_idx, r.side, round(r.overlap, 2)) for r in wl.bounding_walls(walls, c).collect())
    assert sides(cells) == [(0, "low", 2.0), (2, "high", 2.0)]
    assert sides(notched) == [(2, "high", 1.6)]
    assert sides(mostly) == [(0, "low", 1.2), (2, "high", 1.6)]


def test_ceilings_of_rooms(spark):
    """The fullest shelf is the ceiling, or nothing if too little of it was seen; another level is told; shelves within 10 cm are one."""
    cells = spark.createDataFrame([(1, r, c, room) for room in (1, 2, 3) for r in range(20) for c in range(20 * room, 20 * room + 20)], "capture_id long, row int, col int, room_id int")
    at = lambda room, y, n, each=1, skip=0: [(1, y, i // 20, 20 * room + i % 20) for i in range(skip, skip + n) for _ in range(each)]
    rows = [x for room in (1, 2, 3) for x in at(room, 0.01, 400)]
    rows += at(1, 2.5, 300) + at(1, 2.53, 60) + at(1, 2.2, 80, skip=300)  # a lowered part
    rows += at(2, 2.0, 30, each=9) + at(2, 2.5, 200)  # a wardrobe's top has more points than the ceiling
    rows += at(3, 2.5, 60)
    points = spark.createDataFrame(rows, "capture_id long, y double, row int, col int")
    levels = spark.createDataFrame([(1, 0.0)], "capture_id long, floor_y double")
    got = {r.room_id: r for r in wl.room_heights(points, cells, levels).collect()}
    assert abs(got[1].ceiling_y - 2.5) < 1e-9 and abs(got[1].ceiling_seen - 0.75) < 0.16 and abs(got[1].other_y - 2.2) < 1e-9 and abs(got[1].other_seen - 0.2) < 1e-9
    assert got[2].ceiling_y is None and got[2].note == "ceiling seen over only 8% of the room; not reported" and got[2].other_y is None
    assert got[3].ceiling_y is None and got[3].note == "ceiling not seen" and got[3].ceiling_seen == 0
    tall = {r.room_id: r for r in wl.ceiling_heights(wl.room_heights(points, cells, levels), spark.createDataFrame([(1, 0.003)], "capture_id long, drift_sigma double")).collect()}
    assert abs(tall[1].ceiling - 2.49) < 1e-9 and abs(tall[1].ceiling_pm95 - 2 * math.sqrt(2 * 0.005**2 + 0.003**2)) < 1e-9


def test_erosion_and_dilation_equal_brute_force(spark):
    r = np.random.default_rng(5)
    cells = {(int(a), int(b)) for a, b in r.integers(0, 25, (420, 2))}
    df = spark.createDataFrame([(1, a, b) for a, b in cells] + [(1, *next(iter(cells)))], "capture_id long, row int, col int")
    for kernel in (rs.ellipse(3), rs.ellipse(7), rs.square(3)):
        got = lambda x: sorted((c.row, c.col) for c in x.collect())
        assert got(rs.dilate(df, kernel)) == sorted({(a + i, b + j) for a, b in cells for i, j in kernel})
        assert got(rs.erode(df, kernel)) == sorted((a, b) for a, b in cells if all((a + i, b + j) in cells for i, j in kernel))


@pytest.mark.parametrize("turn", [0.0, 12.3, 37.85])
def test_rotation_is_found(spark, turn):
    a = math.radians(turn)
    rows = []
    for i in range(300):
        for x, z in ((0.0, i * 0.01), (i * 0.01, 0.0), (3.0, i * 0.01)):
            x, z = x + 0.005, z + 0.005
            rows.append((1, math.cos(a) * x - math.sin(a) * z, 1.0, math.sin(a) * x + math.cos(a) * z))
    df = spark.createDataFrame(rows, "capture_id long, x double, y double, z double")
    got = pt.find_rotation(df).first().angle % 90
    assert min(abs(got - turn), abs(got - turn - 90), abs(got - turn + 90)) <= 0.1


def test_gaps_are_bridged_up_to_six_cells(spark):
    def wall(missing):
        return [(1, 0.01, 0.05 + 0.1 * h, (j + 0.5) * 0.05) for j in range(60) if not 20 <= j < 20 + missing for h in range(10)]

    spikes = spark.createDataFrame([(1, "x", 0, 0.01)], "capture_id long, axis string, strip long, centre double")
    bands = spark.createDataFrame([(1, 0.0, 1.0)], "capture_id long, low double, high double")
    for missing, runs in ((6, 1), (7, 2)):
        pts = spark.createDataFrame(wall(missing), "capture_id long, x double, y double, z double")
        assert wl.runs(wl.near_spikes(pts, spikes, 0.03), bands).count() == runs


def test_morphology_and_components(spark):
    cells = [(1, r, c) for r in range(10) for c in range(10) if (r, c) != (5, 5)] + [(1, 20, 20)]
    df = spark.createDataFrame(cells, "capture_id long, row int, col int")
    closed = {(r.row, r.col) for r in rs.close(df, rs.square(3)).collect()}
    assert (5, 5) in closed and (20, 20) in closed
    opened = {(r.row, r.col) for r in rs.open_(df, rs.square(3)).collect()}
    assert (20, 20) not in opened and (0, 0) in opened
    assert {(r.component_id) for r in rs.components(df).collect()} == {1, 2}
    filled = rs.fill_rooms(rs.components(df).withColumnRenamed("component_id", "room_id"), df.limit(0), min_area=0.1)
    assert filled.count() == 100
    grown = {(r.row, r.col): r.room_id for r in rs.grow(df, spark.createDataFrame([(1, 0, 0, 7), (1, 9, 9, 3)], "capture_id long, row int, col int, room_id int")).collect()}
    assert grown[(0, 1)] == 7 and grown[(9, 8)] == 3 and grown[(0, 9)] == 3 and (20, 20) not in grown


def test_outline_of_an_l_shape(spark):
    cells = [(1, r, c) for r in range(40) for c in range(60) if r < 20 or c < 25]
    corners = ol.trace(spark.createDataFrame(cells, "room int, row int, col int"), ["room"])
    assert corners.count() == 6
    area = rs.polygon_area(corners, ["room"]).first().area
    assert abs(area - len(cells) * 0.0025) < 1e-9


def test_suppression_and_merging(spark):
    boxes = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 20.0, 20.0, 30.0, 30.0, 0.1), (2, 4, 0.0, 0.0, 10.0, 10.0, 0.5)]
    df = spark.createDataFrame(boxes, "label int, vec_id long, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r.vec_id for r in dm.suppress(df, ["label"]).collect()) == [1, 3, 4]
    seen = [(1, i, "crack", "S", s, 1.0 * i, 2.0, x, 0.0, 0.0) for i, (s, x) in enumerate([(0.9, 0.0), (0.8, 0.4), (0.7, 0.8), (0.6, None)])]
    det = spark.createDataFrame(seen, "capture_id long, det_id long, class string, surface string, score double, width_m double, height_m double, cx double, cy double, cz double")
    got = sorted((r.det_id, r.sightings) for r in dm.merge_sightings(det).collect())
    assert got == [(0, 3), (2, 1)]


def test_drift_fold_follows_offsets(spark):
    rows = [("a", ch, i, 0, 0.01 * ch + (0.2 if ch == 3 else 0), 5) for ch in range(5) for i in range(60)]
    cells = spark.createDataFrame(rows, "capture_id string, chunk long, fx long, fz long, y double, n long")
    got = {r.chunk: (round(r.lift, 6), r.used) for r in mo.drift_lifts(cells).collect()}
    assert got[0] == (0.0, True) and got[1] == (-0.01, True) and got[3][1] is False and got[3][0] == got[2][0]


def test_similarity_is_recovered(spark):
    r = np.random.default_rng(5)
    a = r.normal(size=(40, 3))
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = 1.7 * a @ q.T + [1, 2, 3]
    df = spark.createDataFrame(pd.DataFrame({"g": 1, **dict(zip("xyz", a.T, strict=True)), **dict(zip(("xx", "yy", "zz"), b.T, strict=True))}))
    m = mo.similarity(df, ["g"]).first()
    assert abs(m.scale - 1.7) < 1e-9 and np.allclose([[m[f"r{i}{j}"] for j in range(3)] for i in range(3)], q) and np.allclose([m.tx, m.ty, m.tz], [1, 2, 3])


def test_depth_folders(spark, tmp_path):
    r = np.random.default_rng(1)
    for kind, grid in (("depth", r.integers(0, 5000, (12, 16)).astype(np.uint16)), ("confidence", r.integers(0, 3, (12, 16)).astype(np.uint8))):
        (tmp_path / "cap" / kind).mkdir(parents=True)
        (tmp_path / "cap" / kind / "000007.png").write_bytes(sc.encode_png(grid))
        assert (sc.decode_png(sc.encode_png(grid)) == grid).all()
    px = sc.read_depth(spark, str(tmp_path)).collect()
    assert len(px) == 192 and {p.frame for p in px} == {7} and all(p.conf in (0, 1, 2) for p in px)
    (tmp_path / "cap" / "odometry.csv").write_text("h\n" + "\n".join(f"{i}.5,x,1,2,3,0,0,0,1,{'nan' if i else 100},2,3,4" for i in range(3)) + "\n")
    f = sc.read_odometry(spark, str(tmp_path)).orderBy("frame").collect()
    assert [x.ts for x in f] == [0.5, 1.5, 2.5] and f[0].fx == 100 and math.isnan(f[1].fx) and f[0].capture_id == "cap"
    camera = spark.createDataFrame([(9.0, 8.0, 7.0, 6.0)], "fx double, fy double, cx double, cy double")
    scaled = fr.intrinsics(sc.read_odometry(spark, str(tmp_path)), camera, Params(depth_width=1, colour_width=1)).orderBy("frame").collect()
    assert (scaled[0].fx, scaled[1].fx, scaled[1].cy) == (100, 9, 6)


def test_clouds_and_photos(spark, tmp_path):
    p = pd.DataFrame({"x": [1.5, 2.5], "y": [0.0, -1.0], "z": [3.0, 4.0], "r": [300.0, -5.0], "g": [1.9, 2.0], "b": [3.0, 4.0]})
    (tmp_path / "a.ply").write_bytes(sc.ply_bytes(p))
    got = sc.read_ply(spark, str(tmp_path)).orderBy("x").collect()
    assert [(g.x, g.r, g.g) for g in got] == [(1.5, 255.0, 1.0), (2.5, 0.0, 2.0)]
    (tmp_path / "home" / "hall").mkdir(parents=True)
    (tmp_path / "home" / "hall" / "1.JPG").write_bytes(b"x")
    (tmp_path / "home" / "hall" / "1.txt").write_bytes(b"x")
    assert [(r.room, r.name) for r in sc.list_photos(spark, str(tmp_path / "home")).collect()] == [("hall", "1.JPG")]


def box_room_views(tilt):
    """Depth pictures from inside a box of 4 x 2.5 x 3 m (y up), by cameras that look around; the piece's frame is turned by ``tilt`` degrees about x and has units of 2 m."""
    a = math.radians(tilt)
    lean = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    rows, poses = [], []
    frame = 0
    for n, yaw in enumerate(range(0, 360, 45)):
        # in a camera x is right, y down and z ahead
        c, s = math.cos(math.radians(yaw)), math.sin(math.radians(yaw))
        world = np.array([[c, 0, s], [0, -1, 0], [s, 0, -c]])  # columns: right, down, ahead
        eye = np.array([1.2 + 0.25 * n % 1.5, 1.3, 1.1 + 0.2 * n % 1.1])
        for r in range(0, 48):
            for k in range(0, 64):
                ray = world @ np.array([(k + 0.5 - 32) / 40, (r + 0.5 - 24) / 40, 1.0])
                with np.errstate(divide="ignore"):
                    t = np.where(ray > 0, (np.array([4, 2.5, 3]) - eye) / ray, np.where(ray < 0, -eye / ray, np.inf))
                rows.append((1, frame, r, k, float(t.min())))
        m = lean @ world
        w = math.sqrt(max(0.0, 1 + m[0, 0] + m[1, 1] + m[2, 2])) / 2
        q = None
        if w > 1e-6:
            q = ((m[2, 1] - m[1, 2]) / (4 * w), (m[0, 2] - m[2, 0]) / (4 * w), (m[1, 0] - m[0, 1]) / (4 * w), w)
        else:
            vals, vecs = np.linalg.eigh(m + m.T)
            q = (*vecs[:, -1], 0.0)
        poses.append((1, frame, *(float(x) / 2 for x in lean @ eye), *map(float, q), 40.0, 40.0, 32.0, 24.0))
        frame += 1
    return rows, poses


@pytest.mark.parametrize("tilt", [0.0, 25.0])
def test_points_of_a_piece_are_metric_and_upright(spark, tilt):
    rows, poses = box_room_views(tilt)
    pixels = spark.createDataFrame(rows, "piece long, frame long, row int, col int, depth double")
    cameras = spark.createDataFrame(poses, "piece long, frame long, px double, py double, pz double, qx double, qy double, qz double, qw double, fx double, fy double, cx double, cy double")
    scales = spark.createDataFrame([(1, 2.0)], "piece long, scale double")
    got = mo.metric_points(pixels, cameras, scales).toPandas()
    assert len(got) > 3000
    low, high = got["y"].min(), got["y"].max()
    assert abs(high - low - 2.5) < 0.03
    # floor and ceiling are level: what was seen of them, a metre and more of it, lies within 2 cm
    for level in (low, high):
        near = got[np.abs(got["y"] - level) < 0.02]
        assert len(near) > 50 and max(np.ptp(near["x"]), np.ptp(near["z"])) > 1


def test_documents_are_refused_where_they_break_the_contract(spark, tmp_path):
    from planloom.operators import results as rs_

    m = lambda v: (v, 0.02, None)
    measure = "struct<value:double,pm95:double,note:string>"
    walls = [("R2-W1", [0.0, 0.0], [4.0, 0.0], m(4.0), True), ("R2-W2", [4.0, 0.0], [4.0, 3.0], m(3.0), False)]
    rooms = spark.createDataFrame([(1, "R10", "Room 10", "not rectangular", None, m(2.0), m(2.0), (None, None, "x"), (None, None, 'said ,"note":null')), (1, "R2", "Room 2", "rectangular", walls, m(4.0), m(3.0), m(12.0), m(2.5))],
        f"capture_id long, id string, name string, shape string, walls array<struct<id:string,start:array<double>,end:array<double>,length:{measure},detected:boolean>>, width {measure}, length {measure}, floor_area {measure}, ceiling_height {measure}")
    captures = spark.createDataFrame([(1, "lidar", 12.5), (2, "video", 3.0)], "capture_id long, tier string, processing_seconds double")
    openings = spark.createDataFrame([(1, "O1", "door", [1.0, 0.0], [2.0, 0.0], m(1.0), ["R2", "R10"])], f"capture_id long, id string, type string, start array<double>, end array<double>, width {measure}, rooms array<string>")
    joined = spark.createDataFrame([(1, ["R2", "R10"], "O1")], "capture_id long, rooms array<string>, via string")
    docs = {r.capture_id: json.loads(r.document) for r in rs_.documents(captures, rooms=rooms, openings=openings, adjacency=joined).collect()}
    one = docs[1]
    assert list(one) == ["schema_version", "capture", "units", "rooms", "openings", "adjacency", "property", "damage", "concealed_damage_flags", "scope", "warnings"]
    assert one["units"] == "metres" and one["capture"] == {"id": "1", "tier": "lidar", "processing_seconds": 12.5}
    assert [r["id"] for r in one["rooms"]] == ["R2", "R10"] and "segment" not in one["rooms"][0] and "outline" not in one["rooms"][0]
    assert one["rooms"][1]["floor_area"] == {"value": None, "pm95": None, "note": "x"} and one["rooms"][1]["ceiling_height"]["note"] == 'said ,"note":null'
    assert one["rooms"][0]["walls"][1] == {"id": "R2-W2", "start": [4.0, 0.0], "end": [4.0, 3.0], "length": {"value": 3.0, "pm95": 0.02}, "detected": False}
    assert one["adjacency"] == [{"rooms": ["R2", "R10"], "via": "O1"}] and one["property"] == {"room_count": 2, "total_floor_area": {"value": 12.0, "pm95": 0.02, "note": "sum over 1 of 2 rooms (the rest not measured)"}}
    assert docs[2]["rooms"] == [] and docs[2]["warnings"] == [] and docs[2]["property"]["room_count"] == 0
    good = rs_.violations(rooms, captures, openings, joined)
    rs_.write_documents(rs_.documents(captures, rooms=rooms), good, f"{tmp_path}/good")
    assert spark.read.text(f"{tmp_path}/good").count() == 2
    for bad in (rooms.withColumn("shape", F.lit("rectangle")), rooms.withColumn("id", F.lit("Room")), rooms.withColumn("width", F.struct(F.lit(1.0).alias("value"), F.lit(-1.0).alias("pm95"), F.lit(None).cast("string").alias("note")))):
        with pytest.raises(ValueError, match="break the contract"):
            rs_.write_documents(rs_.documents(captures, rooms=rooms), rs_.violations(bad, captures), f"{tmp_path}/bad")
    rs_.write_debug(f"{tmp_path}/debug", rooms=rooms.select("capture_id", "id"))
    assert spark.read.json(f"{tmp_path}/debug/rooms").count() == 2


def test_outlines_are_traced_or_fall_back_to_the_rectangle(spark):
    ell = [(1, 1, r, c) for r in range(40) for c in range(60) if r < 20 or c < 24]
    thin = [(1, 2, r, c) for r in range(3) for c in range(100, 140)]  # nothing is left of it without spikes
    cells = spark.createDataFrame(ell + thin, "capture_id long, room_id int, row int, col int")
    side = lambda i, room, xl, xh, zl, zh: (1, room, "not rectangular", xh - xl, 0.02, zh - zl, 0.04, xl, xh, zl, zh, True, False, True, True)
    rooms = spark.createDataFrame([side(0, 1, 0.0, 3.0, 0.0, 2.0), side(1, 2, 5.0, 7.0, 0.0, 0.15)], "capture_id long, room_id int, shape string, width double, width_pm95 double, length double, length_pm95 double, x_low double, x_high double, z_low double, z_high double, x_low_found boolean, x_high_found boolean, z_low_found boolean, z_high_found boolean")
    walls = spark.createDataFrame([(1, 0, "x", 3.04), (1, 1, "z", 0.97)], "capture_id long, wall_idx int, axis string, position double")
    touched = spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "capture_id long, wall_idx int, room_id int")
    got = {}
    for r in ol.room_walls(rooms, cells, walls, touched).orderBy("k").collect():
        got.setdefault((r.room_id, r.traced), []).append((round(r.x, 2), round(r.z, 2), r.length, r.pm95, r.detected))
    assert set(got) == {(1, True), (2, False)} and len(got[1, True]) == 6
    assert {(x, z) for x, z, *_ in got[1, True]} == {(0.0, 0.0), (3.04, 0.0), (3.04, 0.97), (1.2, 0.97), (1.2, 2.0), (0.0, 2.0)}
    assert {(d, pm) for *_, pm, d in got[1, True]} == {(True, 0.014), (False, 0.141)} and sum(d for *_, d in got[1, True]) == 2
    assert [(n, pm, d) for _, _, n, pm, d in got[2, False]] == [(2.0, 0.02, True), (0.15, 0.04, False), (2.0, 0.02, True), (0.15, 0.04, True)]


def test_metadata_of_photos():
    body = b"\xff\xd8\xff\xdb\0\4\0\0\xff\xda"
    for orientation in (None, 1, 6):
        for focal in (None, 26):
            tags = sc.exif(sc.with_exif(body, orientation, focal))
            assert tags.get(sc.ORIENTATION) == orientation and tags.get(sc.FOCAL_35MM) == focal
    big = b"MM\0*" + (8).to_bytes(4, "big") + (1).to_bytes(2, "big") + (0x0112).to_bytes(2, "big") + (3).to_bytes(2, "big") + (1).to_bytes(4, "big") + (8).to_bytes(2, "big") + b"\0\0" + b"\0\0\0\0"
    assert sc._tags(big) == {sc.ORIENTATION: 8}
    assert sc.exif(body) == sc.exif(b"") == sc.exif(b"\x89PNG") == {} and sc.exif(body[:2] + b"\xff\xe1\0\x20Exif\0\0II*\0\xff\xff\xff\xff") == {}


def test_late_frames_are_dropped(spark, tmp_path):
    """A frame older than the watermark doesn't change its window, and windows are written once the watermark has passed them."""
    from planloom.streaming import twins

    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    schema = "kind string, time timestamp, score double"
    for n, rows in enumerate([[("a", at(1), 1.0), ("a", at(1, 30), 1.0), ("a", at(5), 1.0)], [("a", at(1, 45), 1.0), ("a", at(5, 10), 1.0), ("a", at(9), 1.0)]]):
        df = spark.createDataFrame([(k, t, s) for k, t, s in rows], "kind string, t string, score double").select("kind", F.to_timestamp("t").alias("time"), "score")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = twins._run(twins.tumbling(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), late="30 minutes"), str(tmp_path))
    got = sorted((r.begin % 86400 // 3600, r.n) for r in out.collect())
    assert got == [(1, 2), (5, 2)]


def test_state_goes_when_the_watermark_has_passed(spark, tmp_path):
    """Over windows in order, all are written once and the state that is left is that of the closing row."""
    from planloom.streaming import twins

    rows = spark.range(2000).select((F.col("id") % 3).cast("string").alias("kind"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 120).alias("time"), F.lit(1.0).alias("score"))
    out, left = twins._in_order(rows, lambda s: twins.tumbling(s, late="2 hours"), str(tmp_path), 4, "4 HOURS")
    want = {(r.kind, r.b): r.n for r in rows.groupBy("kind", (F.floor(F.unix_seconds("time") / 3600) * 3600).alias("b")).agg(F.count("*").alias("n")).collect()}
    got = out.collect()
    assert {(r.kind, r.begin): r.n for r in got} == want and len(got) == len(want) and left == 1
    none, left = twins._in_order(rows.limit(0), lambda s: twins.tumbling(s), str(tmp_path / "none"), 2, "4 HOURS")
    assert none.collect() == [] and left == 0


def test_rooms_of_two_plans_match_once(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.5), (1, 2, 2, 0.4), (1, 3, 1, 0.6), (1, 4, 4, 0.2)], "capture_id long, a long, b long, iou double")
    assert sorted((r.a, r.b) for r in ol.match_rooms(df).collect()) == [(1, 1), (2, 2)]


def test_places_in_rooms_and_on_surfaces(spark):
    corners = spark.createDataFrame([(1, 1, k, x, z, 2.5) for k, (x, z) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])], "capture_id long, room_id int, k int, x double, z double, ceiling double")
    places = [(1, 2.0, 1.2, 0.1, "R1-W1"), (2, 3.9, 1.2, 1.5, "R1-W2"), (3, 2.0, 0.05, 1.5, "R1-floor"), (4, 2.0, 2.4, 1.5, "R1-ceiling"), (5, 2.0, 1.2, 1.5, "R1-unknown"), (6, 4.2, 1.2, 1.0, "R1-W2"), (7, 6.0, 1.0, 1.0, None)]
    df = spark.createDataFrame([(1, i, x, y, z) for i, x, y, z, _ in places], "capture_id long, id long, x double, y double, z double")
    got = {r.id: r.surface for r in ol.place_on_plan(df, corners).collect()}
    assert got == {i: s for i, *_, s in places}


def test_anchors_of_homes_tell_their_overlaps(spark):
    got = results.wall_anchor(spark, SF)
    assert got.columns == ["capture_id", "turn", "dx", "dz", "overlap", "start", "accepted"]
    assert all(r.overlap >= 150 and r.overlap >= 1.05 * r.start for r in got.collect())


def test_angles_are_tried_on_places_of_a_capture(spark):
    """No table of places by angle is made, and the best angle is that of the operators for single steps."""
    r = np.random.default_rng(8)
    t = np.radians(-17.3)
    flat = np.concatenate([np.stack([np.full(300, 2.011), r.uniform(0, 3, 300)], 1), np.stack([r.uniform(0, 2, 200), np.full(200, 1.011)], 1)])
    rows = [(c, float(np.cos(t) * a + np.sin(t) * b), float(np.cos(t) * b - np.sin(t) * a)) for c in ("a", None) for a, b in flat] + [("a", 9e6, 0.0)]
    df = spark.createDataFrame(rows, "capture_id string, x double, z double")
    out = pt.find_rotation(df)
    steps = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in steps and "NestedLoop" not in steps and "Cartesian" not in steps
    got = [tuple(x) for x in out.collect()]
    one = pt.spikiness(pt.strips(df.where("capture_id = 'a'"), pt.angle_table(df, 0.0, 0.5, 180))).orderBy(F.desc("spikiness"), "angle").first().angle
    assert len(got) == 1 and got[0][0] == "a" and abs(got[0][1] - one) <= 0.5 and abs(got[0][1] % 90 - 17.3) <= 0.3


def test_anchors_try_every_move(spark, monkeypatch):
    """A degree and 10 cm to all sides, of which the best is that of plain loops; no table of moved places is made."""
    asked = []
    whole = mo.wall_anchor
    monkeypatch.setattr(mo, "wall_anchor", lambda *a: asked.append(a[2:]) or whole(*a))
    plan = results.wall_anchor(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert asked == [([-0.1, -0.08, -0.06, -0.04, -0.02, 0.0, 0.02, 0.04, 0.06, 0.08, 0.1], [-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0])]
    r = np.random.default_rng(5)
    cells = sorted({(int(a), int(b)) for a, b in r.integers(-40, 60, (300, 2))})
    at = [(float(round((b + 0.31) * 0.02 - 0.08, 4)), float(round((a + 0.17) * 0.02 + 0.1, 4))) for a, b in cells] + [(None, 1.0)]
    there = spark.createDataFrame([(k, a, b) for k in ("a", None) for a, b in cells], "capture_id string, row long, col long")
    mine = spark.createDataFrame([(k, x, z) for k in ("a", "b", None) for x, z in at], "capture_id string, x double, z double")
    got = whole(there, mine, *asked[0]).collect()
    n = {}
    for t in asked[0][1]:
        c, s = np.cos(np.radians(t)), np.sin(np.radians(t))
        for dx in asked[0][0]:
            for dz in asked[0][0]:
                n[t, dx, dz] = len({(int(np.floor((s * x + c * z + dz) / 0.02)), int(np.floor((c * x - s * z + dx) / 0.02))) for x, z in at[:-1]} & set(cells))
    best = min(n, key=lambda m: (-n[m], sum(map(abs, m)), m))
    assert best == (0.0, 0.08, -0.1) and [tuple(x) for x in got] == [("a", *best, n[best], n[0.0, 0.0, 0.0], True)]


def test_laid_out_points_are_dealt_and_not_broadcast(spark):
    """The tables that the homes are laid out from are small; the points aren't."""
    p = scene.points(spark, SF)
    assert p.rdd.getNumPartitions() > 3
    steps = pt.wall_band(p, pt.horizontal_levels(p))._jdf.queryExecution().executedPlan().toString()
    assert "Join" in steps and "Broadcast" not in steps


def test_spread_of_a_wall_by_its_places(spark):
    walls = spark.createDataFrame([(1, 0, "x", 1.0, 0.0, 2.0, 2.0)], "capture_id long, wall_idx int, axis string, position double, start double, end double, length double")
    off = [((i * 7) % 11 - 5) * 0.003 for i in range(60)]
    df = spark.createDataFrame([(1, 1.0 + x, y, 0.5) for x in off for y in (0.5, 1.0)], "capture_id long, x double, y double, z double")
    got = wl.wall_spread(walls, df).collect()
    assert len(got) == 1 and got[0].walls == 1 and abs(got[0].wall_spread - np.std(off)) < 1e-9


def test_of_two_walls_whose_corner_is_nearest_the_first_counts(spark):
    a, b = 1.9100000000000001, 0.9127382146439318
    corners = spark.createDataFrame([(1, 1, k, x, z, 2.5) for k, (x, z) in enumerate([(0.013, 0.027), (a, 0.027), (a, b), (0.013, b)])], "capture_id long, room_id int, k int, x double, z double, ceiling double")
    df = spark.createDataFrame([(1, 1, 2.1432494074106216, 1.2724960789084434, 1.0913482531905174)], "capture_id long, id long, x double, y double, z double")
    assert [r.surface for r in ol.place_on_plan(df, corners).collect()] == ["R1-W2"]


@pytest.mark.parametrize("clutter", [60, 500])
def test_three_directions_of_a_turned_box(spark, clutter):
    """Among much clutter, of which the normals that are tried first are all: pairs of the later ones still give the box."""
    r = np.random.default_rng(8)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    ids = [x.id for x in spark.range(600 + clutter).orderBy(F.xxhash64("id")).collect()]
    wild = [r.normal(size=3) for _ in range(clutter)]
    box = [q[:, i % 3] * r.choice([-1, 1]) + r.normal(size=3) * 0.01 for i in range(600)]
    first = clutter // 4
    order = wild[:first] + [x for _, x in sorted(zip(r.permutation(600 + clutter - first), box + wild[first:], strict=True), key=lambda t: t[0])]
    rows = [(1, int(i), *map(float, v / np.linalg.norm(v))) for i, v in zip(ids, order, strict=True)]
    df = spark.createDataFrame(rows, "g long, id long, x double, y double, z double")
    found = mo.box_directions(df, ["g"]).orderBy("d").collect()
    got = np.array([(x.x, x.y, x.z) for x in found])
    assert np.allclose(np.abs(got @ q).max(axis=1), 1, atol=5e-3) and np.allclose(got @ got.T, np.eye(3), atol=1e-9)
    assert all(190 <= x.inliers < 260 and x.n == 600 + clutter for x in found)


def test_directions_of_few_normals(spark):
    """No two at right angles, or no normals: no directions."""
    df = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0)], "g long, id long, x double, y double, z double")
    assert mo.box_directions(df, ["g"]).collect() == [] and mo.box_directions(df.limit(0), ["g"]).collect() == []


def test_rooms_found_in_pictures_are_those_of_the_single_steps(spark):
    from planloom.operators import raster as rs
    from planloom.params import DEFAULTS as p

    rng = __import__("numpy").random.default_rng(5)
    cells = [(c, int(r), int(k)) for c in (1, 2) for r in range(60) for k in range(90) if rng.random() > 0.02 and (c == 1 or r < 25 or k > 40)]
    cells += [(2, 100_000, 7), (3, 4, 4), (4, -5, -70_000)]  # strays far off, and homes without rooms
    floor = spark.createDataFrame(cells, "capture_id long, row int, col int")
    walls = spark.createDataFrame([(1, "x", 2.2, 0.0, 1.1), (1, "x", 2.2, 1.9, 3.0), (2, "z", 1.3, 0.0, 4.5)], "capture_id long, axis string, position double, start double, end double")
    holes = spark.createDataFrame([(1, "x", 2.2, 1.1, 1.4)], walls.schema)
    barriers = rs.barrier(walls, p=p).unionByName(rs.barrier(holes, extend=0.0, p=p)).distinct()
    free = rs.subtract(rs.close(floor, rs.ellipse(int(round(p.floor_fill / p.grid)) | 1)), barriers)
    islands = rs.components(rs.erode(free, rs.ellipse(2 * int(round(p.door_split / p.grid)) + 1)))
    grown = rs.grow(free, islands.withColumnRenamed("component_id", "room_id"))
    by_steps = {}
    for r in rs.fill_rooms(grown, barriers, p, p.min_room_area).collect():
        by_steps.setdefault((r.capture_id, r.room_id), set()).add((r.row, r.col))
    found = {}
    for r in rs.find_rooms(floor, walls, holes, p).collect():
        found.setdefault((r.capture_id, r.room_id), set()).add((r.row, r.col))
    for c in (1, 2):
        assert [by_steps[k] for k in sorted(by_steps) if k[0] == c] == [found[k] for k in sorted(found) if k[0] == c]
        assert sorted(k[1] for k in found if k[0] == c) == list(range(1, 1 + sum(k[0] == c for k in found)))
    assert {k[0] for k in found} == {1, 2} and len(found) >= 3


def test_holes_are_filled_for_all_rooms_of_a_capture_at_once(spark):
    from planloom.operators import raster as rs

    ring = [(1, 1, r, c) for r in range(5) for c in range(5) if max(abs(r - 2), abs(c - 2)) == 2]
    inner = [(1, 2, 2, 2), (1, 3, 9, 9)]  # within the first, and too small
    diamond = [(2, 7, 1, 0), (2, 7, 0, 1), (2, 7, 1, 2), (2, 7, 2, 1)]
    rooms = spark.createDataFrame(ring + inner + diamond, "capture_id long, room_id int, row int, col int")
    blocked = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "capture_id long, row int, col int")
    got = rs.fill_rooms(rooms, blocked, min_area=0.0024)
    assert {(r.capture_id, r.room_id, r.row, r.col) for r in got.collect()} == {(1, 1, r, c) for r in range(5) for c in range(5) if (r, c) != (1, 1)} | {(1, 3, 9, 9)} | {(2, 7, r, c) for r, c in ((1, 0), (0, 1), (1, 2), (2, 1), (1, 1))}
    # one group a capture, not one a room, and cells aren't dealt again afterwards
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "HashAggregate" not in plan


def test_points_look_their_room_up_without_being_dealt_by_cell(spark):
    from planloom.operators import raster as rs

    cells = spark.createDataFrame([(1, 3, -2, 1), (1, 3, 0, 2), (2, 0, 0, 1)], "capture_id long, row int, col int, room_id int")
    points = spark.createDataFrame([(1, 3, -2, "a"), (1, 3, -1, "b"), (1, 3, 0, "c"), (1, 2, 0, "d"), (1, 3, 1, "e"), (1, 4, -2, "f"), (2, 0, 0, "g"), (9, 0, 0, "h")], "capture_id long, row int, col int, wide string")
    told = rs.in_rooms(points, cells)
    assert sorted((r.wide, r.room_id) for r in told.collect()) == [("a", 1), ("c", 2), ("g", 1)]
    assert {r.wide: r.room_id for r in rs.in_rooms(points, cells, "left").collect()} == {**dict.fromkeys("bdefh"), "a": 1, "c": 2, "g": 1}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_small_pictures_go_on_together():
    import numpy as np
    import pandas as pd

    from planloom.sources import captures as sc

    grids = [np.arange(12, dtype=np.uint16).reshape(3, 4) * 300 + i for i in range(50)] + [np.full((2, 3), 9, np.uint8)]
    files = pd.DataFrame([(f"/x/c{i % 2}/{'depth' if g.dtype == np.uint16 else 'confidence'}/{i:06d}.png", sc.encode_png(g)) for i, g in enumerate(grids)], columns=["path", "content"])
    parts = list(sc._pixels(iter([files])))
    assert len(parts) == 1
    own = parts[0].set_index("frame")
    for i, g in enumerate(grids):
        assert np.array_equal(own.loc[i, "value"].to_numpy().reshape(g.shape), g) and set(own.loc[i, "capture_id"]) == {f"c{i % 2}"}
        assert own.loc[i, ["row", "col"]].to_numpy().tolist() == [[r, c] for r in range(g.shape[0]) for c in range(g.shape[1])]
