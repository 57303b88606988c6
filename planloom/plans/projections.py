"""Queries that project and filter: rotations, back-projection, grids, boxes."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import frames as fr
from ..operators import points as pt
from .bind import FRAMES_SQL, POINTS_SQL, VECTORS_SQL, frames, points, query, rounded, table, vectors

C = F.col
_R = ("1-2*(y*y+z*z)", "2*(x*y-z*w)", "2*(x*z+y*w)", "2*(x*y+z*w)", "1-2*(x*x+z*z)", "2*(y*z-x*w)", "2*(x*z-y*w)", "2*(y*z+x*w)", "1-2*(x*x+y*y)")


@query("quat_matrix", f"""WITH {VECTORS_SQL}, n AS (SELECT *, sqrt(e1*e1+e2*e2+e3*e3+e4*e4) AS n FROM v), q AS (SELECT vec_id, e1/n AS x, e2/n AS y, e3/n AS z, e4/n AS w FROM n WHERE n > 0)
SELECT vec_id, {", ".join(f"round({s}, 6) + 0.0 AS r{i // 3}{i % 3}" for i, s in enumerate(_R))} FROM q""")
def quat_matrix(spark, sf):
    """Rotation matrices of quaternions."""
    v = vectors(spark, sf).where("e1 <> 0 or e2 <> 0 or e3 <> 0 or e4 <> 0")
    return rounded(v.select("vec_id", *[c.alias(k) for k, c in g.quaternion_to_matrix(C("e1"), C("e2"), C("e3"), C("e4")).items()]))


@query("intrinsics_fallback", """WITH i AS (SELECT p_partkey AS frame, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS fx, CASE WHEN p_size % 7 <> 0 THEN p_retailprice + 1 END AS fy, p_size * 20.0::DOUBLE AS cx, p_size * 15.0::DOUBLE AS cy FROM part),
k AS (SELECT median(fx) AS fx, median(fy) AS fy, median(cx) AS cx, median(cy) AS cy FROM i)
SELECT frame, round(CASE WHEN b THEN k.fx ELSE i.fx END * 256 / 1920, 6) AS fx, round(CASE WHEN b THEN k.fy ELSE i.fy END * 256 / 1920, 6) AS fy, round(CASE WHEN b THEN k.cx ELSE i.cx END * 256 / 1920, 6) AS cx, round(CASE WHEN b THEN k.cy ELSE i.cy END * 256 / 1920, 6) AS cy
FROM (SELECT *, fx IS NULL OR fy IS NULL OR cx IS NULL OR cy IS NULL AS b FROM i) i CROSS JOIN k""")
def intrinsics_fallback(spark, sf):
    """Frames without all four intrinsics get those of the camera; all are scaled to the depth grid."""
    p = table(spark, sf, "part")
    i = p.select(C("p_partkey").alias("frame"), F.when(C("p_size") % 5 != 0, C("p_retailprice")).alias("fx"), F.when(C("p_size") % 7 != 0, C("p_retailprice") + 1).alias("fy"), (C("p_size") * 20.0).alias("cx"), (C("p_size") * 15.0).alias("cy"))
    camera = i.agg(*[F.median(c).alias(c) for c in ("fx", "fy", "cx", "cy")])
    return rounded(fr.intrinsics(i, camera))


@query("stride_sample", f"""WITH {FRAMES_SQL}, n AS (SELECT capture_id, count(*) AS n FROM f GROUP BY 1)
SELECT capture_id, event_id, frame FROM f JOIN n USING (capture_id) WHERE frame % greatest(5, round_even(n / 1200.0::DOUBLE, 0)::BIGINT) = 0""")
def stride_sample(spark, sf):
    """Every s-th frame of a capture, s from its length."""
    return fr.stride_sample(frames(spark, sf)).select("capture_id", "event_id", "frame")


def _pixels(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(C("l_orderkey").alias("frame"), C("l_linenumber").cast("int").alias("row"), C("l_quantity").cast("int").alias("col"), (C("l_extendedprice") / 19997).alias("depth"))


def _poses(spark, sf):
    o = table(spark, sf, "orders")
    a = F.radians((C("o_custkey") % 360).cast("double")) / 2
    return o.select(C("o_orderkey").alias("frame"), (C("o_totalprice") / 99991).alias("px"), F.lit(1.5).alias("py"), ((C("o_custkey") % 10) / 2).cast("double").alias("pz"), F.lit(0.0).alias("qx"), F.sin(a).alias("qy"), F.lit(0.0).alias("qz"), F.cos(a).alias("qw"), F.lit(200.0).alias("fx"), F.lit(210.0).alias("fy"), F.lit(25.0).alias("cx"), F.lit(4.0).alias("cy"))


@query("backproject", """WITH o AS (SELECT o_orderkey AS frame, o_totalprice / 99991 AS px, 1.5::DOUBLE AS py, (o_custkey % 10) / 2.0::DOUBLE AS pz, radians((o_custkey % 360)::DOUBLE) / 2 AS a FROM orders),
q AS (SELECT *, sin(a) AS y, cos(a) AS w FROM o), c AS (SELECT l_orderkey AS frame, l_linenumber::INT AS row, floor(l_quantity)::INT AS col, (floor(l_quantity)::INT + 0.5::DOUBLE - 25) / 200 * (l_extendedprice / 19997) AS x, (l_linenumber + 0.5::DOUBLE - 4) / 210 * (l_extendedprice / 19997) AS y0, l_extendedprice / 19997 AS z FROM lineitem)
SELECT frame, row, col, round((1 - 2*q.y*q.y) * c.x + 2*q.y*w * c.z + px, 6) + 0.0 AS x, round(c.y0 + py, 6) + 0.0 AS y, round(-2*q.y*w * c.x + (1 - 2*q.y*q.y) * c.z + pz, 6) + 0.0 AS z FROM c JOIN q USING (frame)""")
def backproject(spark, sf):
    """Pixels as points of the world."""
    return rounded(fr.to_world(_pixels(spark, sf), _poses(spark, sf), keys=["frame"]).select("frame", "row", "col", "x", "y", "z"))


def _grid(spark, sf):
    e = table(spark, sf, "events")
    i = C("event_id")
    return e.select(F.floor(i / 256).cast("long").alias("frame"), (F.floor(i / 16) % 16).cast("int").alias("row"), (i % 16).cast("int").alias("col"), F.greatest(F.lit(0.0), F.lit(1.0) + (C("value") % 10) / 40).alias("depth"), (i % 5).cast("int").alias("conf"))


_GRID_SQL = "g AS (SELECT event_id // 256 AS frame, ((event_id // 16) % 16)::INT AS row, (event_id % 16)::INT AS col, greatest(0.0::DOUBLE, 1.0::DOUBLE + (value % 10) / 40) AS depth, (event_id % 5)::INT AS conf FROM events)"


@query("trust_filter", f"""WITH {_GRID_SQL}, n AS (SELECT *, coalesce(lag(depth) OVER r, depth) AS a, coalesce(lead(depth) OVER r, depth) AS b, coalesce(lag(depth) OVER c, depth) AS u, coalesce(lead(depth) OVER c, depth) AS d FROM g
WINDOW r AS (PARTITION BY frame, row ORDER BY col), c AS (PARTITION BY frame, col ORDER BY row))
SELECT frame, row, col, round(depth, 6) AS depth FROM n WHERE conf >= 2 AND depth > 0.2::DOUBLE AND depth < 5.0::DOUBLE AND greatest(abs(a - depth), abs(b - depth), abs(u - depth), abs(d - depth)) < 0.05::DOUBLE * depth""")
def trust_filter(spark, sf):
    """Pixels of sure depth that don't lie at an edge."""
    return rounded(fr.trusted(_grid(spark, sf)).select("frame", "row", "col", "depth"))


@query("surface_normals", f"""WITH {_GRID_SQL}, n AS (SELECT *, lag(depth) OVER r AS a, lead(depth) OVER r AS b, lag(depth) OVER c AS u, lead(depth) OVER c AS d FROM g
WINDOW r AS (PARTITION BY frame, row ORDER BY col), c AS (PARTITION BY frame, col ORDER BY row)),
x AS (SELECT frame, row, col, 2*0.01::DOUBLE AS rx, b - a AS rz, 2*0.01::DOUBLE AS dy, d - u AS dz FROM n WHERE a IS NOT NULL AND b IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL),
m AS (SELECT *, -rz*dy AS nx, -rx*dz AS ny, rx*dy AS nz FROM x)
SELECT frame, row, col, round(nx / sqrt(nx*nx+ny*ny+nz*nz), 6) + 0.0 AS nx, round(ny / sqrt(nx*nx+ny*ny+nz*nz), 6) + 0.0 AS ny, round(nz / sqrt(nx*nx+ny*ny+nz*nz), 6) + 0.0 AS nz FROM m""")
def surface_normals(spark, sf):
    """Unit normals of inner pixels from central differences."""
    grid = _grid(spark, sf).select("frame", "row", "col", (C("col") * 0.01).alias("x"), (C("row") * 0.01).alias("y"), C("depth").alias("z"))
    return rounded(fr.normals(grid))


@query("rotate_points", f"WITH {POINTS_SQL} SELECT ord, line, round(cos(radians(17.5::DOUBLE))*x + sin(radians(17.5::DOUBLE))*z, 6) + 0.0 AS x, round(cos(radians(17.5::DOUBLE))*z - sin(radians(17.5::DOUBLE))*x, 6) + 0.0 AS z FROM p")
def rotate_points(spark, sf):
    x, z = g.rotate_about_vertical(C("x"), C("z"), F.lit(17.5))
    return rounded(points(spark, sf).select("ord", "line", x.alias("x"), z.alias("z")))


@query("turn_shift", f"WITH {POINTS_SQL} SELECT ord, line, round(2 + cos(radians(w))*(x-2) - sin(radians(w))*(z-1) + 0.1::DOUBLE, 6) + 0.0 AS x, round(1 + sin(radians(w))*(x-2) + cos(radians(w))*(z-1) - 0.2::DOUBLE, 6) + 0.0 AS z FROM p")
def turn_shift(spark, sf):
    x, z = g.turn_and_shift(C("x"), C("z"), F.lit(2.0), F.lit(1.0), C("w"), F.lit(0.1), F.lit(-0.2))
    return rounded(points(spark, sf).select("ord", "line", x.alias("x"), z.alias("z")))


@query("quarter_turns", f"WITH {POINTS_SQL} SELECT ord, line, (ord % 4)::INT AS k, CASE ord % 4 WHEN 0 THEN x WHEN 1 THEN -z WHEN 2 THEN -x ELSE z END AS x, CASE ord % 4 WHEN 0 THEN z WHEN 1 THEN x WHEN 2 THEN -z ELSE -x END AS z FROM p")
def quarter_turns(spark, sf):
    x, z = g.quarter_turn(C("x"), C("z"), C("ord") % 4)
    return points(spark, sf).select("ord", "line", (C("ord") % 4).cast("int").alias("k"), x.alias("x"), z.alias("z"))


@query("wall_band", f"WITH {POINTS_SQL}, l AS (SELECT capture_id, min(y) AS floor_y, CASE WHEN capture_id % 3 > 0 THEN max(y) END AS ceiling_y FROM p GROUP BY 1) SELECT ord, line, y FROM p JOIN l USING (capture_id) WHERE y > floor_y + 0.3::DOUBLE AND y < coalesce(ceiling_y - 0.3::DOUBLE, floor_y + 2.0::DOUBLE)")
def wall_band(spark, sf):
    p = points(spark, sf)
    levels = p.groupBy("capture_id").agg(F.min("y").alias("floor_y"), F.max("y").alias("m")).select("capture_id", "floor_y", F.when(C("capture_id") % 3 > 0, C("m")).alias("ceiling_y"))
    return pt.wall_band(p, levels).select("ord", "line", "y")


@query("grid_cells", f"""WITH {POINTS_SQL}, b AS (SELECT capture_id, min(x) - 0.2::DOUBLE AS ox, min(z) - 0.2::DOUBLE AS oz FROM p GROUP BY 1)
SELECT capture_id, trunc((z - oz) / 0.05::DOUBLE)::INT AS row, trunc((x - ox) / 0.05::DOUBLE)::INT AS col, count(*) AS n FROM p JOIN b USING (capture_id) GROUP BY 1, 2, 3""")
def grid_cells(spark, sf):
    """Points by cell of the plan's grid."""
    return pt.with_cells(points(spark, sf)).groupBy("capture_id", "row", "col").agg(F.count("*").alias("n"))


@query("upright_choice", f"WITH {VECTORS_SQL}, s AS (SELECT vec_id, [(e1, -0, 'right'), (e2, -1, 'up'), (-e1, -2, 'left'), (-e2, -3, 'down')] AS c FROM v) SELECT vec_id, CASE WHEN e1 >= e2 AND e1 >= -e1 AND e1 >= -e2 THEN 'right' WHEN e2 >= -e1 AND e2 >= -e2 THEN 'up' WHEN -e1 >= -e2 THEN 'left' ELSE 'down' END AS upright FROM v")
def upright_choice(spark, sf):
    """Which of four picture axes points down most; the first of equals."""
    v = vectors(spark, sf)
    axes = [("right", C("e1")), ("up", C("e2")), ("left", -C("e1")), ("down", -C("e2"))]
    return v.select("vec_id", fr.first_greatest(axes).alias("upright"))


@query("exif_focal", "SELECT p_partkey, round(CASE WHEN p_size % 6 = 0 THEN 800.0::DOUBLE ELSE p_size * sqrt((4000 + p_size)::DOUBLE * (4000 + p_size) + 3000.0::DOUBLE * 3000) / 43.27::DOUBLE END, 5) AS focal FROM part")
def exif_focal(spark, sf):
    """Focal lengths in pixels, or the model's where a picture says none."""
    p = table(spark, sf, "part")
    said = F.when(C("p_size") % 6 != 0, C("p_size"))
    return p.select("p_partkey", F.round(F.coalesce(g.exif_focal(said, 4000 + C("p_size"), F.lit(3000)), F.lit(800.0)), 5).alias("focal"))


@query("spot_ratio", f"""WITH {VECTORS_SQL}, s AS (SELECT vec_id, label, e1*e4 + e2*e5 + e3*e6 AS depth, greatest(0, least(255, trunc((e7 + 1) * 128)::INT)) AS col, greatest(0, least(191, trunc((e8 + 1) * 96)::INT)) AS row, abs(e9) + 0.1::DOUBLE AS seen FROM v)
SELECT vec_id, col, row, round(seen / depth, 6) AS ratio FROM s WHERE depth > 0""")
def spot_ratio(spark, sf):
    """Depth of spots along the camera's axis, their pixels, and the ratio of the seen depth to it."""
    v = vectors(spark, sf)
    depth = g.dot((C("e1"), C("e2"), C("e3")), (C("e4"), C("e5"), C("e6")))
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c.cast("int")))
    s = v.select("vec_id", depth.alias("depth"), clip((C("e7") + 1) * 128, 256).alias("col"), clip((C("e8") + 1) * 96, 192).alias("row"), (F.abs("e9") + 0.1).alias("seen"))
    return s.where("depth > 0").select("vec_id", "col", "row", F.round(C("seen") / C("depth"), 6).alias("ratio"))


def _between_sql() -> str:
    sel = []
    skew = (("0", "-v3", "v2"), ("v3", "0", "-v1"), ("-v2", "v1", "0"))
    for i in range(3):
        for j in range(3):
            square = f"(v{i + 1}*v{j + 1}{' - vv' if i == j else ''})"
            sel.append(f"round({int(i == j)} + {skew[i][j]} + {square}/(1+c), 5) + 0.0 AS r{i}{j}")
    return ", ".join(sel)


@query("rotation_between", f"""WITH {VECTORS_SQL}, a AS (SELECT vec_id, e1/n AS a1, e2/n AS a2, e3/n AS a3, e4/m AS b1, e5/m AS b2, e6/m AS b3 FROM (SELECT *, sqrt(e1*e1+e2*e2+e3*e3) AS n, sqrt(e4*e4+e5*e5+e6*e6) AS m FROM v)),
c AS (SELECT vec_id, a2*b3-a3*b2 AS v1, a3*b1-a1*b3 AS v2, a1*b2-a2*b1 AS v3, a1*b1+a2*b2+a3*b3 AS c FROM a), d AS (SELECT *, v1*v1+v2*v2+v3*v3 AS vv FROM c)
SELECT vec_id, {_between_sql()} FROM d WHERE c > -0.999::DOUBLE""")
def rotation_between(spark, sf):
    v = vectors(spark, sf)
    a, b = (C("e1"), C("e2"), C("e3")), (C("e4"), C("e5"), C("e6"))
    cos = g.dot(a, b) / (F.sqrt(g.dot(a, a)) * F.sqrt(g.dot(b, b)))
    return rounded(v.where(cos > -0.999).select("vec_id", *[c.alias(k) for k, c in g.rotation_between(a, b).items()]), 5)


@query("camera_up", f"WITH {VECTORS_SQL}, m AS (SELECT label, avg(-e1) AS x, avg(-e2) AS y, avg(-e3) AS z FROM v GROUP BY 1) SELECT label, round(x/sqrt(x*x+y*y+z*z), 6) + 0.0 AS x, round(y/sqrt(x*x+y*y+z*z), 6) + 0.0 AS y, round(z/sqrt(x*x+y*y+z*z), 6) + 0.0 AS z FROM m")
def camera_up(spark, sf):
    """The mean of the cameras' up axes, as a unit vector."""
    return rounded(fr.mean_direction(vectors(spark, sf), ["label"], [-C("e1"), -C("e2"), -C("e3")]))


@query("conf_quantile_keep", f"WITH {VECTORS_SQL}, q AS (SELECT label, quantile_cont(e1, 0.3) AS q FROM v GROUP BY 1) SELECT vec_id, label, round(e1, 6) AS conf FROM v JOIN q USING (label) WHERE e1 >= q")
def conf_quantile_keep(spark, sf):
    """The surest 70 % of the points of each photo."""
    v = vectors(spark, sf)
    q = v.groupBy("label").agg(F.percentile("e1", 0.3).alias("q"))
    return v.join(q, "label").where("e1 >= q").select("vec_id", "label", F.round("e1", 6).alias("conf"))


@query("surface_of_point", f"WITH {POINTS_SQL} SELECT ord, line, CASE WHEN y < 0.15::DOUBLE THEN 'floor' WHEN y > 2.5::DOUBLE - 0.25::DOUBLE THEN 'ceiling' ELSE 'wall' END AS surface FROM p")
def surface_of_point(spark, sf):
    return points(spark, sf).select("ord", "line", pt.surface_of(C("y"), F.lit(2.5)).alias("surface"))


def _boxes(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", F.floor(C("vec_id") / 40).cast("long").alias("label"), *[x.alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), ((F.least("e1", "e2") + 0.5) * 400, (F.least("e3", "e4") + 0.5) * 300, (F.greatest("e1", "e2") + 0.5) * 400, (F.greatest("e3", "e4") + 0.5) * 300), strict=True)], F.abs("e8").alias("score"))


BOXES_SQL = f"{VECTORS_SQL}, b AS (SELECT vec_id, vec_id // 40 AS label, (least(e1,e2)+0.5::DOUBLE)*400 AS x0, (least(e3,e4)+0.5::DOUBLE)*300 AS y0, (greatest(e1,e2)+0.5::DOUBLE)*400 AS x1, (greatest(e3,e4)+0.5::DOUBLE)*300 AS y1, abs(e8) AS score FROM v)"


@query("box_filter", f"WITH {BOXES_SQL}, c AS (SELECT vec_id, greatest(x0,0) AS x0, greatest(y0,0) AS y0, least(x1,400) AS x1, least(y1,300) AS y1 FROM b) SELECT vec_id, round(x0,6) AS x0, round(y0,6) AS y0, round(x1,6) AS x1, round(y1,6) AS y1 FROM c WHERE x1 > x0 AND y1 > y0 AND (x1-x0)*(y1-y0) <= 0.5::DOUBLE * 120000")
def box_filter(spark, sf):
    """Boxes cut to the picture; none that is empty or covers more than half."""
    from ..operators import damage as dm

    return rounded(dm.clip_boxes(_boxes(spark, sf), 400, 300).select("vec_id", "x0", "y0", "x1", "y1"))


@query("vector_angle", f"WITH {VECTORS_SQL} SELECT vec_id, round(degrees(acos(greatest(-1, least(1, (e1*e4+e2*e5+e3*e6) / sqrt((e1*e1+e2*e2+e3*e3)*(e4*e4+e5*e5+e6*e6)))))), 5) AS degrees FROM v")
def vector_angle(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(g.angle((C("e1"), C("e2"), C("e3")), (C("e4"), C("e5"), C("e6"))), 5).alias("degrees"))


