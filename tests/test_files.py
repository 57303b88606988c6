"""Files that are written and read: clouds by several tasks, frames by number, pages and drawings."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planloom.operators import results as rs
from planloom.sources import captures as sc
from planloom.sources import clouds
from planloom.sources import pictures as pic


def cloud(n, seed=1):
    r = np.random.default_rng(seed)
    return pd.DataFrame({**{c: r.normal(size=n).astype(np.float32).astype(float) for c in "xyz"}, **{c: r.integers(0, 256, n).astype(float) for c in "rgb"}})


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    p = cloud(1003)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.ply").write_bytes(sc.ply_bytes(p))
    (tmp_path / "_temporary-x").mkdir()
    (tmp_path / "_temporary-x" / "b.ply").write_bytes(sc.ply_bytes(p))
    clouds.register(spark)
    for split in (997, 15, 1 << 20):
        df = spark.read.format("point_cloud").option("splitBytes", split).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == -(-(tmp_path / "deep" / "a.ply").stat().st_size // split)
        got = df.toPandas()
        assert np.array_equal(got[list("xyzrgb")].sort_values(list("xyz")).to_numpy(), p.sort_values(list("xyz")).to_numpy())
    one = spark.read.format("point_cloud").load(str(tmp_path / "deep" / "a.ply"))
    assert one.count() == 1003 and one.columns == ["path", *"xyzrgb"]


def test_clouds_appear_when_the_job_commits(spark, tmp_path):
    clouds.register(spark)
    p = cloud(1000)
    df = spark.createDataFrame(p).repartition(3)
    path = str(tmp_path / "out")
    df.write.format("point_cloud").mode("append").option("filePoints", 150).save(path)
    files = list((tmp_path / "out").iterdir())
    assert len(files) >= 7 and all(f.suffix == ".ply" for f in files) and max(len(sc.parse_ply(f.read_bytes())) for f in files) == 150
    back = spark.read.format("point_cloud").load(path)
    assert back.count() == 1000 and abs(back.agg(F.sum("x")).first()[0] - p["x"].sum()) < 1e-6
    broken = df.withColumn("x", F.when(F.col("r") >= 0, F.raise_error(F.lit("stop"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("point_cloud").mode("append").save(path)
    assert {f.name for f in (tmp_path / "out").iterdir()} == {f.name for f in files}
    df.limit(10).write.format("point_cloud").mode("overwrite").save(path)
    assert spark.read.format("point_cloud").load(path).count() == 10
    with pytest.raises(Exception, match="no \\['b'\\]"):
        df.drop("b").write.format("point_cloud").mode("append").save(path)


def test_broken_clouds_are_refused(spark, tmp_path):
    clouds.register(spark)
    whole = sc.ply_bytes(cloud(10))
    for name, raw, said in (("short", whole[:-1], "ends before"), ("other", b"solid stl" * 40, "no cloud file"), ("none", b"", "no cloud file")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.ply").write_bytes(raw)
        with pytest.raises(Exception, match=said):
            spark.read.format("point_cloud").load(str(tmp_path / name)).count()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("point_cloud").load(str(tmp_path / "empty")).count() == 0


def test_only_wanted_frames_are_opened(spark, tmp_path):
    """Frames that aren't wanted have three thousand million bytes (none of them stored): whoever read one would fail."""
    for capture in ("a", "b"):
        (tmp_path / capture / "rgb").mkdir(parents=True)
        for i in range(6):
            (tmp_path / capture / "rgb" / f"{i:04d}.png").write_bytes(sc.encode_png(np.full((2, 2), i, np.uint8)))
        (tmp_path / capture / "rgb" / "notes.txt").write_bytes(b"x")
        (tmp_path / capture / "depth").mkdir()
        (tmp_path / capture / "depth" / "0001.png").write_bytes(b"x")
    wanted = spark.createDataFrame([("a", 4), ("a", 1), ("b", 5), ("c", 1), ("a", 1)], "capture_id string, frame long")
    df = pic.read_frames(spark, str(tmp_path), wanted)
    listed = df.select("path").count()
    assert listed == 3
    for capture, kept in (("a", {1, 4}), ("b", {5})):
        for i in set(range(6)) - kept:
            with open(tmp_path / capture / "rgb" / f"{i:04d}.png", "wb") as f:
                f.truncate(3 << 30)
    rows = df.collect()
    assert [(x.capture_id, x.frame, int(sc.decode_png(bytes(x.content))[0, 0])) for x in rows] == [("a", 1, 1), ("a", 4, 4), ("b", 5, 5)]
    assert pic.read_frames(spark, str(tmp_path), wanted.limit(0)).count() == 0
    assert pic.read_frames(spark, str(tmp_path)).select("frame").limit(0).count() == 0


def test_pages_hold_the_sample(spark):
    p = cloud(300).assign(capture_id=[1] * 280 + [2] * 20, ord=range(300), line=0)
    df = spark.createDataFrame(p)
    pages = pic.cloud_pages(df, most=100)
    rows = {x.capture_id: x for x in pages.collect()}
    assert rows[1].n == 100 and rows[2].n == 20 and rows[1].html.startswith("<!DOCTYPE html>")
    got = pic.points_of_pages(pages).toPandas()
    want = sc.cap_points(df, 100, by=["capture_id"]).toPandas()
    order = ["capture_id", *"xyz"]
    assert np.allclose(got.sort_values(order)[[*order, *"rgb"]].to_numpy(), want.sort_values(order)[[*order, *"rgb"]].to_numpy())
    assert pic.cloud_pages(df.limit(0)).count() == 0


MEASURE = "struct<value:double,pm95:double,note:string>"


def document(spark, rooms, openings=(), joined=(), tier="lidar"):
    doc = {"schema_version": "1.0", "capture": {"id": "1", "tier": tier}, "units": "metres", "rooms": rooms, "openings": list(openings), "adjacency": list(joined), "property": {"room_count": len(rooms), "total_floor_area": {"value": 1.0, "pm95": 0.1}}, "damage": [], "concealed_damage_flags": [], "scope": [], "warnings": []}
    return spark.createDataFrame([(1, json.dumps(doc))], "capture_id long, document string")


def a_room(ident, x, segment=None, name=None, area=12.0):
    m = lambda v: {"value": v, "pm95": 0.1}
    ring = [[x, 0.0], [x + 4, 0.0], [x + 4, 3.0], [x, 3.0]]
    walls = [{"id": f"{ident}-W{k + 1}", "start": ring[k], "end": ring[(k + 1) % 4], "length": m(4.0 if k % 2 == 0 else 3.0), "detected": k != 2} for k in range(4)]
    return {"id": ident, "name": name or f"Room {ident[1:]}", "segment": segment, "outline": ring, "shape": "rectangular", "width": m(4.0), "length": m(3.0), "floor_area": m(area), "ceiling_height": m(None), "walls": walls}


def test_plans_are_drawn_from_documents(spark):
    door = {"id": "O1", "type": "door", "start": [4.0, 1.0], "end": [4.0, 1.8], "width": {"value": 0.8, "pm95": 0.04}, "rooms": ["R1", "R2"]}
    docs = document(spark, [a_room("R1", 0.0, 1, "A & <b> (segment 1)"), a_room("R2", 4.0, 1), a_room("R3", 50.0, 2)], [door])
    panels = {x.segment: x.svg for x in pic.plan_panels(docs).collect()}
    assert set(panels) == {1, 2} and 'width="760" height="430"' in panels[1] and "Lidar plan, segment 1" in panels[1]
    assert "A &amp; &lt;b&gt;</text>" in panels[1] and "ceiling not seen" in panels[1] and "4.00?" in panels[1] and ">0.80</text>" in panels[1]
    assert panels[1].count('class="guess"') == 2 and panels[1].count('class="door"') == 1 and 'class="door"' not in panels[2]
    assert panels[1].index('class="room"') < panels[1].index('id="R1-W1"') < panels[1].index('id="O1"') < panels[1].index('class="label"')
    import xml.etree.ElementTree as tree

    for svg in panels.values():
        tree.fromstring(svg)
    empty = pic.plan_panels(document(spark, [])).first()
    assert "No rooms found" in empty.svg and empty.segment == 0


def test_diagrams_join_rooms(spark):
    rooms = [a_room(f"R{i}", 0.0, name=f"room{i}") for i in range(1, 6)]
    rooms[4]["floor_area"] = {"value": None, "pm95": None, "note": "not measured: fewer than 2 photos"}
    docs = document(spark, rooms, joined=[{"rooms": ["R1", "R5"], "via": "shared photo a.jpg"}, {"rooms": ["R1", "R9"], "via": "?"}], tier="photo")
    e = [tuple(x) for x in pic.elements(pic.diagrams(docs), "capture_id").collect()]
    assert [x[3] for x in e if x[2] == "box"] == ["R1", "R2", "R3", "R4", "R5"]
    assert [(x[3], x[5]) for x in e if x[2] == "link"] == [("R1-R5", "170 170 520 380")]
    assert [x[4] for x in e if x[2] == "size"][-1] == "not measured: fewer than 2 photos"
    assert pic.diagrams(document(spark, [])).count() == 1


def test_documents_name_no_unknown_lists(spark):
    with pytest.raises(ValueError, match="walls"):
        rs.documents(spark.createDataFrame([(1, "lidar")], "capture_id long, tier string"), walls=None)
