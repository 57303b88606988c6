"""Operators that compare, scale and add up measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params


def drift_sigma(rooms: DataFrame, least: int = 100, p: Params = DEFAULTS) -> DataFrame:
    """Half the spread of room floors with ``least`` or more points, where there are several; a few millimetres at least."""
    sure = F.when(F.col("floor_points") >= least, F.col("floor_y"))
    half = (F.max(sure) - F.min(sure)) / 2
    return rooms.groupBy("capture_id").agg(F.when(F.count(sure) > 1, F.greatest(F.lit(p.min_drift_sigma), half)).otherwise(F.lit(p.min_drift_sigma)).alias("drift_sigma"))


def piece_scale(ratios: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Metres per unit of each piece; null where it has too few spots."""
    frames = ratios.where("ratio > 0").groupBy("piece", "frame").agg(F.median("ratio").alias("m"), F.count("*").alias("n"))
    return frames.groupBy("piece").agg(F.when(F.sum("n") >= p.min_spots, F.median("m") / p.depth_bias).alias("scale"))


def depth_error(ratios: DataFrame) -> DataFrame:
    scale = ratios.groupBy("piece").agg(F.median("ratio").alias("scale"))
    wobble = ratios.groupBy("piece", "frame").agg(F.median("ratio").alias("m")).groupBy("piece").agg(F.stddev_pop("m").alias("wobble"))
    err = ratios.join(scale, "piece").groupBy("piece", "scale").agg(F.avg(F.abs(F.col("ratio") - 1)).alias("raw"), F.avg(F.abs(F.col("ratio") / F.col("scale") - 1)).alias("scaled"))
    return err.join(wobble, "piece").select("piece", "raw", "scaled", "scale", "wobble")


def path_error(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the path x, y, z by frame; root mean square and greatest distance of xx, yy, zz from it; percent of the length."""
    w = Window.partitionBy(*keys).orderBy("frame")
    far = lambda a, b: F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))
    own = [F.col(c) for c in "xyz"]
    d = rows.select(*keys, far(own, [F.lag(c).over(w) for c in "xyz"]).alias("step"), far(own, [F.col(c * 2) for c in "xyz"]).alias("err"))
    rms = F.sqrt(F.avg(F.col("err") * F.col("err")))
    return d.groupBy(*keys).agg(F.sum("step").alias("length"), rms.alias("rms"), F.max("err").alias("worst"), (100 * rms / F.sum("step")).alias("percent"))


def largest(rows: DataFrame, keys: list[str], size: str, ident: str) -> DataFrame:
    """The row of greatest size in each group, of equals that of the smallest id."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(size), -F.col(ident))).alias("b")).select(*keys, "b.*")


def long_pieces(frames: DataFrame, least: int) -> DataFrame:
    return frames.groupBy("capture_id", "piece").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame")).where(F.col("n") >= least)


def depth_budget(pieces: DataFrame, total: int = 240, low: int = 3, high: int = 20) -> DataFrame:
    share = total * F.col("n") / F.sum("n").over(Window.partitionBy("capture_id"))
    return pieces.withColumn("budget", F.greatest(F.lit(low), F.least(F.lit(high), F.bround(share.cast("double")).cast("long"))))


def property_totals(rooms: DataFrame) -> DataFrame:
    n, m = F.count("*"), F.count("area")
    note = F.when(m < n, F.concat(F.lit("sum over "), m.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" rooms")))
    return rooms.groupBy("capture_id").agg(n.alias("n_rooms"), m.alias("measured"), F.sum("area").alias("total"), F.sqrt(F.sum(F.col("pm95") * F.col("pm95"))).alias("pm95"), note.alias("note"))


def renumber(rows: DataFrame, keys: list[str], order: list[str], prefix: str, name: str) -> DataFrame:
    """Dense ids with a prefix in each group."""
    return rows.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")))


def within_gate(a: Column, b: Column, p: Params = DEFAULTS) -> Column:
    """Whether two measures agree to a centimetre or half a percent of their mean; null where one is unmeasured."""
    d = F.abs(a - b)
    return (d <= p.gate_abs) | (d <= p.gate_rel * F.abs(a + b) / 2)


def repeatability(pairs: DataFrame, turns: int = 0) -> DataFrame:
    """A row for each pair of rooms and dimension: a, b, diff, pct, ok ('pass', 'fail', 'n/a', or 'reported' for the area).

    An odd number of quarter turns between the captures swaps the second one's width and length.
    """
    bw, bl = ("length_b", "width_b") if turns % 2 else ("width_b", "length_b")
    dims = [("width", "width_a", bw), ("length", "length_a", bl), ("ceiling_height", "ceiling_a", "ceiling_b"), ("floor_area", "area_a", "area_b")]
    one = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(a).alias("a"), F.col(b).alias("b")) for d, a, b in dims])).alias("d")
    keys = [c for c in ("room_a", "room_b") if c in pairs.columns]
    rows = pairs.select(*keys, one).select(*keys, "d.*")
    ok = F.when(F.col("a").isNull() | F.col("b").isNull(), "n/a").when(F.col("dimension") == "floor_area", "reported").when(within_gate(F.col("a"), F.col("b")), "pass").otherwise("fail")
    mean = F.abs(F.col("a") + F.col("b")) / 2
    return rows.select(*keys, "dimension", "a", "b", (F.col("b") - F.col("a")).alias("diff"), (100 * F.abs(F.col("b") - F.col("a")) / F.when(mean > 0, mean)).alias("pct"), ok.alias("ok"))
