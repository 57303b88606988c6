"""Queries on files of clouds, frames and drawings: written, read back and looked into."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..sources import captures as sc
from ..sources import clouds
from ..sources import pictures as pic
from ..storage import dealt, shared_dir
from . import scene
from .bind import POINTS_SQL, points, query, rounded, table
from .documents import _PHOTOS_SQL, _photo_docs

C = F.col
#: Points, and pictures, that one task writes.
POINTS, PICTURES = 500_000, 4_000


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("cloud_source", f"WITH {POINTS_SQL} SELECT g, count(*) AS n, round(sum(x::FLOAT::DOUBLE), 2) AS x, round(sum(z::FLOAT::DOUBLE), 2) AS z, sum(trunc(r))::DOUBLE AS r FROM p GROUP BY g")
def cloud_source(spark, sf):
    """Points written as files of the point_cloud format by several tasks, and read back a split at a time."""
    clouds.register(spark)
    folder = _folder(spark, "cloud")
    dealt(points(spark, sf).select(*"xyzrgb"), POINTS).write.format(clouds.NAME).mode("append").option("filePoints", 50_000).save(folder)
    back = spark.read.format(clouds.NAME).option("splitBytes", 200_000).load(folder)
    return back.groupBy("g").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("z"), 2).alias("z"), F.sum("r").alias("r"))


@query("viewer_points", f"WITH {POINTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY md5(concat_ws(':', ord, line, r, g, 0)), ord, line, r, g) AS place FROM p) SELECT capture_id, round(x::FLOAT::DOUBLE, 4) AS x, round(y::FLOAT::DOUBLE, 4) AS y, round(z::FLOAT::DOUBLE, 4) AS z, r, g, b FROM k WHERE place <= 200")
def viewer_points(spark, sf):
    """The points that pages to look at clouds hold, 200 of each at most, unpacked again."""
    return rounded(pic.points_of_pages(pic.cloud_pages(points(spark, sf), most=200, keys=("ord", "line", "r", "g"))), 4)


@query("frame_folder", "SELECT s_suppkey::VARCHAR AS capture_id, i AS frame, (i*10 + s_suppkey % 7)::BIGINT AS brightest FROM supplier CROSS JOIN range(8) r(i) WHERE i % 3 = s_suppkey % 3")
def frame_folder(spark, sf):
    """The wanted frames of folders of numbered pictures, opened in order; the brightest pixel of each."""
    folder = _folder(spark, "frames")
    s = table(spark, sf, "supplier").select(C("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))

    def put(batches):
        for pdf in batches:
            for k, i in zip(pdf["k"], pdf["i"], strict=True):
                system, at = clouds.located(f"{folder}/{k}/rgb")
                system.create_dir(at, recursive=True)
                grey = np.full((3, 4), i, np.uint8)
                grey[1, 2] = i * 10 + k % 7
                with system.open_output_stream(f"{at}/{i:06d}.png") as out:
                    out.write(sc.encode_png(grey))
            yield pd.DataFrame({"n": [len(pdf)]})

    dealt(s, PICTURES, "k").mapInPandas(put, "n long").agg(F.sum("n")).collect()
    wanted = s.where("i % 3 = k % 3").select(C("k").alias("capture_id"), C("i").alias("frame"))

    def brightest(batches):
        for pdf in batches:
            yield pd.DataFrame({"capture_id": pdf["capture_id"], "frame": pdf["frame"], "brightest": [int(sc.decode_png(bytes(x)).max()) for x in pdf["content"]]})

    return pic.read_frames(spark, folder, wanted).mapInPandas(brightest, "capture_id string, frame long, brightest long")


_PX = "round({}*80 + 60)::BIGINT"
_PZ = "round({}*80 + 130)::BIGINT"


@query("plan_elements", f"""WITH {scene.SCENE_SQL}, r AS (SELECT capture_id, unnest([1, 2]) AS i, wide*0.05::DOUBLE AS wide, deep*0.05::DOUBLE AS deep FROM h), s AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE wide END AS a, CASE WHEN i = 1 THEN wide ELSE wide + 3 END AS b FROM r),
pl AS (SELECT *, {_PX.format('a')} AS x0, {_PX.format('b')} AS x1, {_PZ.format('0')} AS z0, {_PZ.format('deep')} AS z1 FROM s)
SELECT capture_id, 'room' AS class, 'R' || i AS id, '' AS said, x0 || ',' || z0 || ' ' || x1 || ',' || z0 || ' ' || x1 || ',' || z1 || ' ' || x0 || ',' || z1 AS numbers FROM pl
UNION ALL SELECT capture_id, 'wall', 'R' || i || '-W' || k, '', CASE k WHEN 1 THEN concat_ws(' ', x0, z0, x1, z0) WHEN 2 THEN concat_ws(' ', x1, z0, x1, z1) WHEN 3 THEN concat_ws(' ', x1, z1, x0, z1) ELSE concat_ws(' ', x0, z1, x0, z0) END FROM pl CROSS JOIN range(1, 5) t(k)
UNION ALL SELECT capture_id, 'door', 'O1', '', concat_ws(' ', x1, 194, x1, 262) FROM pl WHERE i = 1
UNION ALL SELECT capture_id, 'label', '', ['Room ' || i, printf('%.2f x %.2f m', b - a, deep), 'ceiling 2.50 m'][k + 1], concat_ws(' ', ((x0 + x1)/2)::BIGINT, ((z0 + z1)/2)::BIGINT - 24 + [0, 17, 51][k + 1]) FROM pl CROSS JOIN range(3) t(k)
UNION ALL SELECT capture_id, 'length', '', printf('%.2f', CASE WHEN k % 2 = 0 THEN b - a ELSE deep END), concat_ws(' ', CASE k WHEN 1 THEN x1 - 16 WHEN 3 THEN x0 + 16 ELSE ((x0 + x1)/2)::BIGINT END, CASE k WHEN 0 THEN z0 + 16 WHEN 2 THEN z1 - 16 ELSE ((z0 + z1)/2)::BIGINT END) FROM pl CROSS JOIN range(4) t(k)""")
def plan_elements(spark, sf):
    """What the drawings of the homes' plans show, looked up in them: rooms, walls, the door between them, sizes and lengths."""
    from .results import home_document

    e = pic.elements(pic.plan_panels(home_document(spark, sf)[0]), "capture_id", "segment")
    return e.where(C("class").isin("room", "wall", "label", "length") & (C("id") != "scale") & ~C("said").contains("+-") | (C("class") == "door") & (C("id") == "O1")).select("capture_id", "class", "id", "said", "numbers")


@query("diagram_elements", f"""WITH {_PHOTOS_SQL}, c AS (SELECT capture_id, greatest(1, ceil(sqrt(count(*))))::INT AS cols FROM q GROUP BY 1), bx AS (SELECT q.*, 40 + (i - 1) % cols * 350 AS x, 110 + (i - 1) // cols * 210 AS y FROM q JOIN c USING (capture_id))
SELECT capture_id::BIGINT AS capture_id, 'box' AS class, id, '' AS said, x || ' ' || y AS numbers FROM bx UNION ALL SELECT capture_id::BIGINT, 'name', '', name, (x + 130) || ' ' || (y + 30) FROM bx
UNION ALL SELECT a.capture_id::BIGINT, 'link', CASE WHEN a.i < b.i THEN a.id || '-' || b.id ELSE b.id || '-' || a.id END, '', CASE WHEN a.i < b.i THEN concat_ws(' ', a.x + 130, a.y + 60, b.x + 130, b.y + 60) ELSE concat_ws(' ', b.x + 130, b.y + 60, a.x + 130, a.y + 60) END FROM bx a JOIN bx b ON b.capture_id = a.capture_id AND b.k = a.k + 1 WHERE a.k % 2 = 0
UNION ALL SELECT capture_id::BIGINT, 'size', '', CASE WHEN reason IS NULL THEN printf('%.2f x %.2f m, %.1f m2 +-%.1f', w, d, a, round(sqrt(0.01::DOUBLE + power(0.6::DOUBLE*a, 2)), 3)) ELSE 'not measured: ' || reason END, (x + 130) || ' ' || (y + 60) FROM bx""")
def diagram_elements(spark, sf):
    """What the diagrams of photographed rooms show: boxes with names and sizes, and lines between rooms that share a doorway's photo."""
    return pic.elements(pic.diagrams(_photo_docs(spark, sf)), "capture_id").where(C("class").isin("box", "name", "link", "size")).drop("tag")
