"""Rows are dealt to tasks by their number before they are laid out, so that what one task holds doesn't grow with the table."""

from math import floor

import numpy as np
import pytest

from planloom.operators import damage as dm
from planloom.operators import outlines as ol
from planloom.operators import points as pt
from planloom.operators import raster as rs
from planloom.operators import walls as wl
from planloom.plans import aggregates, checks, documents, pictures, scene
from planloom.sources import captures as sc
from planloom.sources import pictures as pic

SF = "/root/testdata/sf0.001"


def tasks(df) -> int:
    return df.rdd.getNumPartitions()


def test_barriers_are_laid_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(rs, "WALLS", 10)
    walls = spark.range(200).coalesce(1).selectExpr("id as capture_id", "'x' as axis", "1.0D as position", "0.0D as start", "id % 3 + 1.0D as end")
    cells = rs.barrier(walls)
    assert tasks(cells) == 20
    assert cells.count() == sum(2 * (floor((k % 3 + 1.0 + 0.15) / 0.05) + 1 - floor((0.0 - 0.15) / 0.05)) for k in range(200))


def test_polygons_are_filled_by_crossings(spark, monkeypatch):
    """A ring within a notch: rows with four crossings, and none of their cells outside."""
    monkeypatch.setattr(rs, "CORNERS", 8)
    u = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.7, 1.0), (0.7, 0.4), (0.3, 0.4), (0.3, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(r, k, x, z) for r in range(30) for k, (x, z) in enumerate(u)], "room int, k int, x double, z double")
    cells = rs.polygon_cells(df, ["room"])
    assert tasks(cells) == 30 and "count(1)" not in cells._jdf.queryExecution().toString()
    got = sorted((c.row, c.col) for c in cells.where("room = 7").collect())
    assert got == [(r, c) for r in range(20) for c in range(20) if r < 8 or c < 6 or c >= 14]


@pytest.mark.parametrize("name", ["topdown_density", "wall_spikes"])
def test_points_are_dealt_by_capture(spark, monkeypatch, name):
    monkeypatch.setattr(pt, "POINTS", 100)
    df = aggregates.QUERIES[name](spark, SF) if hasattr(aggregates, "QUERIES") else getattr(aggregates, name)(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert tasks(df) == -(-lines // 100)


def test_normals_are_dealt_by_capture(spark, monkeypatch):
    monkeypatch.setattr(checks, "NORMALS", 100)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f"{-(-lines // 100)})" in checks.box_directions(spark, SF)._jdf.queryExecution().toString()


def test_traces_of_many_rooms_are_one_batch(spark):
    """Rooms of different forms, in no order and with cells that repeat, are traced without a group of their own each."""
    rng = np.random.default_rng(1)
    cells = [(k, r - 5, c - 9) for k in range(50) for r in range(12 + k % 5) for c in range(20 if r < 6 else 8 + k % 3)]
    cells = [cells[i] for i in rng.permutation(len(cells))] + cells[:20]
    out = ol.trace(spark.createDataFrame(cells, "room int, row int, col int"), ["room"])
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    for k in (0, 7):
        got = [(round(c.x / 0.05), round(c.z / 0.05)) for c in out.where(f"room = {k}").orderBy("k").collect()]
        wide, tall = 8 + k % 3, 12 + k % 5
        assert got == [(-9, -5), (11, -5), (11, 1), (wide - 9, 1), (wide - 9, tall - 5), (-9, tall - 5)]


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"{k}" / "rgb").mkdir(parents=True)
        (tmp_path / f"{k}" / "rgb" / "7.png").write_bytes(sc.encode_png(np.full((2, 2), k, np.uint8)))
    df = pic.read_frames(spark, str(tmp_path))
    assert "FileScan" not in df._jdf.queryExecution().toString()
    assert [(r.capture_id, r.frame) for r in df.collect()] == [("0", 7), ("1", 7), ("2", 7)]


def test_odometry_is_listed_by_tasks(spark, tmp_path):
    for at in ("a", "deep/b", "_hidden"):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "odometry.csv").write_text("timestamp,frame\n1.5,0,2\r\n\n2.5,1,3")
    df = sc.read_odometry(spark, str(tmp_path))
    assert "FileScan" not in df._jdf.queryExecution().toString()
    assert sorted((r.capture_id, r.frame, r.ts, r.px) for r in df.collect()) == [("a", 0, 1.5, 2.0), ("a", 2, 2.5, 3.0), ("b", 0, 1.5, 2.0), ("b", 2, 2.5, 3.0)]


def test_clouds_are_written_by_tasks_by_their_points(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pictures, "POINTS", 1000)
    whole = pictures.dealt
    monkeypatch.setattr(pictures, "dealt", lambda df, each, *keys: seen.append(each) or whole(df, each, *keys))
    assert pictures.cloud_source(spark, SF).count() > 0 and seen == [1000]


def test_slices_are_told_once_a_capture(spark):
    """The number of slices comes from the capture's side of the join, not from each point."""
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.45), (1, 0.0, 0.0, 2.1)], "capture_id long, x double, z double, y double")
    bands = spark.createDataFrame([(1, 0.3, 2.2)], "capture_id long, low double, high double")
    df = wl.sliced(points, bands)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("round(")
    assert sorted((r.slices, r.any0, r.held0) for r in df.collect()) == [(19, 2, 2), (19, 1 << 18, 1 << 18)]


def test_a_form_of_homes_is_laid_out_once(spark):
    df = scene.points(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Generate")
    assert df.select("capture_id").distinct().count() == scene.homes(spark, SF).count()


def test_detections_are_dealt_by_picture(spark, monkeypatch):
    """A few boxes a picture: none of the pictures waits for all others in one task, and equal scores go by id."""
    monkeypatch.setattr(dm, "DETECTIONS", 40)
    rows = [(p, 10 * p + i, x, 0.0, x + 10.0, 10.0, s) for p in range(100) for i, (x, s) in enumerate([(0.0, 0.5), (1.0, 0.5), (30.0, None), (31.0, 0.2 if p % 2 else None)])]
    kept = dm.suppress(spark.createDataFrame(rows[::-1], "picture int, det_id long, x0 double, y0 double, x1 double, y1 double, score double").coalesce(1), ["picture"], "det_id")
    assert tasks(kept) == 10
    assert sorted(r.det_id for r in kept.collect()) == sorted(k for p in range(100) for k in (10 * p, 10 * p + 2 + p % 2))


def test_sightings_are_merged_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(dm, "DETECTIONS", 40)
    rows = [(h, 4 * h + i, "crack", None if h % 2 else "S", 0.9 - i / 10, float(i + 1) if i else None, None, x, 0.0, 0.0) for h in range(100) for i, x in enumerate([0.0, 0.2, 0.4, 3.0])]
    seen = spark.createDataFrame(rows, "capture_id long, det_id long, class string, surface string, score double, width_m double, height_m double, cx double, cy double, cz double").coalesce(1)
    merged = dm.merge_sightings(seen)
    assert tasks(merged) == 10
    got = sorted((r.capture_id, r.surface, r.det_id, r.sightings, r.width_m, r.height_m) for r in merged.collect())
    assert got == [x for h in range(100) for x in ((h, None if h % 2 else "S", 4 * h, 3, 2.5, None), (h, None if h % 2 else "S", 4 * h + 3, 1, 4.0, None))]


def test_nothing_of_homes_is_broadcast_for_damage(spark):
    """Pixels are laid out from a small table, which Spark takes for small."""
    boxes, px = documents._pictures(spark, SF)
    floors = scene.homes(spark, SF).selectExpr("capture_id", "0.0D as floor_y")
    corners = scene.homes(spark, SF).selectExpr("capture_id", "1 as room_id", "posexplode(array(struct(0.0D as x, 0.0D as z), struct(9.0D as x, 0.0D as z), struct(9.0D as x, 9.0D as z), struct(0.0D as x, 9.0D as z))) as (k, p)", "2.5D as ceiling").selectExpr("capture_id", "room_id", "k", "p.x", "p.z", "ceiling")
    plan = dm.sightings(boxes, px, floors, corners, 1000, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_charts_stand_for_cells(spark, monkeypatch):
    """One row a home holds its rooms; places that are few meet charts in tasks of so many cells, and points of heights are never written."""
    cells = spark.createDataFrame([(h, r, c, 1 + (c > 3)) for h in range(12) for r in range(-2, 6) for c in range(9) if (r + c + h) % 7], "capture_id long, row int, col int, room_id int")
    held = rs.charts(cells)
    assert held.count() == 12 and rs.cells_of(cells) is cells
    assert sorted(map(tuple, rs.cells_of(held).collect())) == sorted(map(tuple, cells.collect())) and rs.cells_of(held).schema == cells.schema
    monkeypatch.setattr(rs, "CHARTED", 72)
    assert tasks(rs.dealt_charts(held)) == 12
    doors = spark.createDataFrame([(h, 1, "door", 0.2, 0.1, 0.2, 0.3, 0.2) for h in range(12)], "capture_id long, gap_idx int, kind string, ax double, az double, bx double, bz double, width double")
    out = wl.door_rooms(doors, held)
    assert tasks(out) == 12
    assert sorted((r.capture_id, *r.rooms) for r in out.collect()) == sorted((r.capture_id, *r.rooms) for r in wl.door_rooms(doors, cells).collect())
    wrote = []
    whole = wl.written
    monkeypatch.setattr(wl, "written", lambda df, name: wrote.append((name, df.count())) or whole(df, name))
    points = spark.createDataFrame([(h, 0.01 * h + y, r, c) for h in range(12) for r in range(-2, 6) for c in range(9) for y in (0.0, 0.01, 2.5, 2.501, 2.502)], "capture_id long, y double, row int, col int")
    levels = spark.createDataFrame([(h, 0.01 * h) for h in range(12)], "capture_id long, floor_y double")
    show = lambda rooms: sorted((r.capture_id, r.room_id, round(r.floor_y, 6), r.floor_points, r.ceiling_y and round(r.ceiling_y, 6), round(r.ceiling_seen, 6), r.note) for r in wl.room_heights(points, rooms, levels).collect())
    got = show(held)
    assert got == show(cells) and len(got) == 24 and all(abs(x[4] - 0.01 * x[0] - 2.501) < 1e-6 for x in got if x[4])
    assert wrote and all(n <= 24 for _, n in wrote)


def test_homes_write_charts(spark, monkeypatch):
    from planloom.plans import plan

    wrote = {}
    whole = plan.written
    monkeypatch.setattr(plan, "written", lambda df, name: wrote.setdefault(name, whole(df, name)))
    plan.charted_home(spark, SF)
    assert wrote["rooms"].count() == scene.homes(spark, SF).count() and "rooms" in wrote["rooms"].columns and "points" not in wrote
