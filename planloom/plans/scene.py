"""A home for each supplier: two rooms beside each other with a door between, as points on a lattice.

A wall has a hole that is bridged, the other room a table that hides the floor, the first one a patch that was never seen; in every fourth home the
end of the wall between the rooms wasn't seen either.

Sizes depend on the supplier's key, so the data are as many as the table's rows. Points stand a quarter cell off every bin's
bounds, so a last-digit difference moves none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import turn_and_shift
from ..storage import keyed
from .bind import table

C = F.col
DOOR = (0.8, 1.65)
#: Heights of floor and ceiling, and shifts along x: the ceiling is seen twice as densely.
FLATS = ((0.003, 0.0), (2.503, 0.0), (2.503, 0.05))
#: Missing end of the inner wall, hole in the first wall, and, as x and z, the patch never seen and the table (from the inner wall on).
END, HOLE, UNSEEN, TABLE = 0.7, (2.0, 2.2), ((1.5, 2.1), (1.0, 1.6)), ((1.0, 2.0), (1.2, 1.8))


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, wide (of the first room, in cells of 5 cm), deep."""
    k = C("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("capture_id"), (80 + (k % 5) * 2).cast("int").alias("wide"), (60 + (k % 3) * 2).cast("int").alias("deep"))


#: Homes laid out by one task: some million points.
DEALT = 64


def dealt(spark: SparkSession, homes: DataFrame, key: str = "capture_id") -> DataFrame:
    """Homes dealt to tasks by capture before their points are laid out, so that these are made side by side, and what follows by capture needs no shuffle."""
    return homes.repartition(max(spark.sparkContext.defaultParallelism, -(-homes.count() // DEALT)), key)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, x, y, z of floors, ceilings and walls.

    Sizes repeat, so there are a fixed few forms of homes: each form's points are laid out once, and every home gets those of its form.
    """
    h = homes(spark, sf_dir).withColumn("ended", C("capture_id") % 4 == 1)
    h = h.withColumn("form", (C("wide") * 1000 + C("deep") * 2 + C("ended").cast("int")).cast("long"))
    forms = _laid(h.select("form", "wide", "deep", "ended").distinct())
    return dealt(spark, h.select("capture_id", "form")).join(F.broadcast(forms), "form").select("capture_id", "x", "y", "z")


def _laid(h: DataFrame) -> DataFrame:
    """form, x, y, z of forms of homes."""
    total = C("wide") + 60
    at = lambda c: (C(c) + 0.25) * 0.05
    seq = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    flat = h.withColumn("i", seq(F.floor(total / 2).cast("int"))).withColumn("j", seq(F.floor(C("deep") / 2).cast("int")))
    within = lambda c, span: (c > span[0]) & (c < span[1])
    flat = flat.select("form", "wide", ((C("i") + 0.25) * 0.1).alias("x"), F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(dx).alias("dx")) for y, dx in FLATS])).alias("f"), ((C("j") + 0.25) * 0.1).alias("z"))
    flat = flat.select("form", "wide", (C("x") + C("f.dx")).alias("x"), C("f.y").alias("y"), "z")
    flat = flat.where(~(within(C("x"), UNSEEN[0]) & within(C("z"), UNSEEN[1])))
    hidden = within(C("x") - C("wide") * 0.05, TABLE[0]) & within(C("z"), TABLE[1]) & (C("y") < 1)
    flat = flat.select("form", "x", F.when(hidden, C("y") + 0.8).otherwise(C("y")).alias("y"), "z")
    height = (C("h") + 0.25) * 0.1
    levels = lambda df: df.withColumn("h", seq(F.lit(24)))
    xw = levels(h.withColumn("j", seq(C("deep"))).withColumn("w", F.explode(F.array(F.lit(0), C("wide"), total))))
    xw = xw.where((C("w") != C("wide")) | (at("j") < DOOR[0]) | (at("j") > DOOR[1]))
    xw = xw.where((C("w") != C("wide")) | ~C("ended") | (at("j") < C("deep") * 0.05 - END)).where((C("w") != 0) | ~within(at("j"), HOLE)).select("form", (C("w") * 0.05 + 0.005).alias("x"), height.alias("y"), at("j").alias("z"))
    zw = levels(h.withColumn("i", seq(total)).withColumn("w", F.explode(F.array(F.lit(0), C("deep"))))).select("form", at("i").alias("x"), height.alias("y"), (C("w") * 0.05 + 0.005).alias("z"))
    return flat.unionByName(xw).unionByName(zw)


def drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points in three chunks, of the first room, of both and of the second one, each 17 mm higher than the one before."""
    p = points(spark, sf_dir).join(keyed(homes(spark, sf_dir).select("capture_id", "wide")), "capture_id")
    first = C("x") < C("wide") * 0.05
    p = p.select("capture_id", "x", "y", "z", F.explode(F.when(first, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("chunk"))
    return p.withColumns({"chunk": C("chunk").cast("long"), "y": C("y") + C("chunk") * DRIFT})


#: Metres that a chunk lies above the one before.
DRIFT = 0.017
#: What takes a chunk back, for each chunk before it: degrees about the home's middle, and metres along x and z.
TURN, SHIFT = 0.25, (0.02, -0.04)


def pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each home: px, pz."""
    return homes(spark, sf_dir).select("capture_id", ((C("wide") + 60) * 0.025).alias("px"), (C("deep") * 0.025).alias("pz"))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drifting chunks, each turned and shifted against the one before as well."""
    p = drifting(spark, sf_dir).join(keyed(pivots(spark, sf_dir)), "capture_id")
    k = C("chunk")
    x, z = turn_and_shift(C("x") - k * SHIFT[0], C("z") - k * SHIFT[1], C("px"), C("pz"), -k * TURN, F.lit(0.0), F.lit(0.0))
    return p.select("capture_id", "chunk", x.alias("x"), "y", z.alias("z"))

#: The same points for DuckDB: tables h and p.
SCENE_SQL = """h AS (SELECT s_suppkey AS capture_id, (80 + (s_suppkey % 5)*2)::INT AS wide, (60 + (s_suppkey % 3)*2)::INT AS deep FROM supplier),
flat AS (SELECT capture_id, wide, (i + 0.25::DOUBLE)*0.1::DOUBLE + dx AS x, y, (j + 0.25::DOUBLE)*0.1::DOUBLE AS z FROM (SELECT capture_id, wide, deep, unnest(range((wide+60)//2)) AS i FROM h) a, LATERAL (SELECT unnest(range(deep//2)) AS j) b, (VALUES (0.003::DOUBLE, 0.0::DOUBLE), (2.503::DOUBLE, 0.0::DOUBLE), (2.503::DOUBLE, 0.05::DOUBLE)) v(y, dx)),
p AS (SELECT capture_id, x, CASE WHEN y < 1 AND x - wide*0.05::DOUBLE > 1 AND x - wide*0.05::DOUBLE < 2 AND z > 1.2::DOUBLE AND z < 1.8::DOUBLE THEN y + 0.8::DOUBLE ELSE y END AS y, z FROM flat WHERE NOT (x > 1.5::DOUBLE AND x < 2.1::DOUBLE AND z > 1 AND z < 1.6::DOUBLE)
UNION ALL SELECT capture_id, w*0.05::DOUBLE + 0.005::DOUBLE, (k + 0.25::DOUBLE)*0.1::DOUBLE, (j + 0.25::DOUBLE)*0.05::DOUBLE FROM (SELECT capture_id, wide, unnest([0, wide, wide+60]) AS w, deep FROM h) a, LATERAL (SELECT unnest(range(deep)) AS j) b, range(24) t(k) WHERE (w <> wide OR (j + 0.25::DOUBLE)*0.05::DOUBLE < 0.8::DOUBLE OR (j + 0.25::DOUBLE)*0.05::DOUBLE > 1.65::DOUBLE) AND (w <> wide OR capture_id % 4 <> 1 OR (j + 0.25::DOUBLE)*0.05::DOUBLE < deep*0.05::DOUBLE - 0.7::DOUBLE) AND (w <> 0 OR NOT ((j + 0.25::DOUBLE)*0.05::DOUBLE > 2 AND (j + 0.25::DOUBLE)*0.05::DOUBLE < 2.2::DOUBLE))
UNION ALL SELECT capture_id, (i + 0.25::DOUBLE)*0.05::DOUBLE, (k + 0.25::DOUBLE)*0.1::DOUBLE, w*0.05::DOUBLE + 0.005::DOUBLE FROM (SELECT capture_id, unnest([0, deep]) AS w, wide FROM h) a, LATERAL (SELECT unnest(range(wide+60)) AS i) b, range(24) t(k))"""
