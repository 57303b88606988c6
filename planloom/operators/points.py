"""Operators on weighted points: voxels, levels, bands, strips, grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import DEFAULTS, Params
from ..storage import dealt, keyed

CAPTURE = ["capture_id"]


def voxel_downsample(points: DataFrame, keys: list[str] = CAPTURE, p: Params = DEFAULTS) -> DataFrame:
    """One point for each occupied voxel: weighted means of place and colour, the sum of weights.

    Partial sums are formed before the shuffle, so merging chunk after chunk is what the aggregation does by itself.
    """
    cell = [F.floor(F.col(a) / p.voxel).cast("long").alias(f"v{a}") for a in "xyz"]
    total = F.sum("w")
    means = [(F.sum(F.col(c) * F.col("w")) / total).alias(c) for c in "xyzrgb"]
    return points.where("w > 0").groupBy(*keys, *cell).agg(*means, total.alias("w"))


def horizontal_levels(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """floor_y and ceiling_y of each capture from the peaks of a histogram of heights, below and above the median.

    The lowest of equal peaks counts. There is no ceiling where its peak is under a fifth of the floor's or it is under 1.8 m above the floor.
    """
    # equal heights are counted first, so that medians and bins handle numbers of points and not points
    heights = points.groupBy("capture_id", "y").agg(F.count("*").alias("k"))
    base = heights.groupBy("capture_id").agg(F.min("y").alias("low"), F.percentile("y", 0.5, F.col("k")).alias("middle"))
    bins = heights.join(keyed(base), "capture_id").groupBy("capture_id", "low", "middle", F.floor((F.col("y") - F.col("low")) / p.level_bin).cast("long").alias("bin")).agg(F.sum("k").alias("n"))
    bins = bins.withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * p.level_bin)
    peak = lambda side: F.max_by(F.struct("centre", "n"), F.when(side, F.struct(F.col("n"), -F.col("bin"))))
    both = bins.groupBy("capture_id").agg(peak(F.col("centre") < F.col("middle")).alias("f"), peak(F.col("centre") >= F.col("middle")).alias("c"))
    seen = (F.col("c.n") >= p.min_ceiling_share * F.col("f.n")) & (F.col("c.centre") - F.col("f.centre") >= p.min_ceiling_gap)
    return both.select("capture_id", F.col("f.centre").alias("floor_y"), F.when(seen, F.col("c.centre")).alias("ceiling_y"))


def wall_band(points: DataFrame, levels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Points between floor and ceiling, well off both; up to 2 m above the floor where the ceiling isn't known."""
    j = points.join(keyed(levels.select("capture_id", "floor_y", "ceiling_y")), "capture_id")
    top = F.coalesce(F.col("ceiling_y") - p.band_high, F.col("floor_y") + p.band_default)
    return j.where((F.col("y") > F.col("floor_y") + p.band_low) & (F.col("y") < top)).drop("floor_y", "ceiling_y")


def places_of(points: DataFrame) -> DataFrame:
    """Places in plan to the millimetre with their number of points: capture_id, x, z, k. Points that stand above each other are one before they are rounded, which costs more than adding up."""
    k = F.sum("k") if "k" in points.columns else F.count("*")
    own = points.groupBy("capture_id", "x", "z").agg(k.alias("k"))
    return own.groupBy("capture_id", F.round("x", 3).alias("x"), F.round("z", 3).alias("z")).agg(F.sum("k").alias("k"))


def strips(points: DataFrame, angles: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Points by capture, angle (if given: a short table), axis and strip of 2 cm, after turning them about the vertical.

    Points (or places with their number k of points) are first added up by millimetre, so that each angle is tried on places and not on points.
    """
    places = places_of(points)
    if angles is not None:
        places = places.crossJoin(F.broadcast(angles))
        x, z = g.rotate_about_vertical(F.col("x"), F.col("z"), F.col("angle"))
    else:
        places, x, z = places.withColumn("angle", F.lit(0.0)), F.col("x"), F.col("z")
    axes = F.explode(F.array(F.struct(F.lit("x").alias("axis"), x.alias("at")), F.struct(F.lit("z").alias("axis"), z.alias("at")))).alias("s")
    return places.select("capture_id", "angle", "k", axes).groupBy("capture_id", "angle", F.col("s.axis").alias("axis"), F.floor(F.col("s.at") / p.strip).cast("long").alias("strip")).agg(F.sum("k").alias("n"))


def spikiness(strip_counts: DataFrame) -> DataFrame:
    """Sum of squared strip counts of both axes over the squared number of points, by angle: high where walls lie along the axes."""
    s = strip_counts.groupBy("capture_id", "angle").agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"), (F.sum("n") / 2).alias("total"))
    return s.select("capture_id", "angle", (F.col("squares") / (F.col("total") * F.col("total"))).alias("spikiness"))


def angle_table(points: DataFrame, first: float, step: float, n: int) -> DataFrame:
    return points.sparkSession.range(n).select((F.lit(first) + F.col("id") * step).alias("angle"))


def _spikiest(x: np.ndarray, z: np.ndarray, k: np.ndarray, angles: np.ndarray, strip: float) -> float:
    """The angle of the greatest ``spikiness`` of places with their numbers of points; the first of equals."""
    found = []
    for a in np.radians(angles):
        squares = 0.0
        for at in (np.cos(a) * x + np.sin(a) * z, np.cos(a) * z - np.sin(a) * x):
            i = np.floor(at / strip).astype(np.int64)
            i -= i.min()
            if i.max() > 100_000 + 4 * len(i):  # strays far off
                i = np.unique(i, return_inverse=True)[1]
            squares += np.square(np.bincount(i, weights=k)).sum()
        found.append(squares)
    return float(angles[int(np.argmax(found))])


def find_rotation(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The turn by which walls lie along the axes: 180 angles of half a degree, then 21 of a twentieth around the best (the first of equals).

    Spark adds points up by place; a capture's places are brought together once, and all angles are tried there, so that no table of places by angle is made.
    """
    places = places_of(points.select("capture_id", "x", "z")).where("capture_id is not null and x is not null and z is not null")

    def run(own: pa.Table) -> pa.Table:
        x, z, k = (own[c].to_numpy().astype(float) for c in ("x", "z", "k"))
        coarse = _spikiest(x, z, k, np.arange(180) * 0.5, p.strip)
        c, s = np.cos(np.radians(coarse)), np.sin(np.radians(coarse))
        fine = _spikiest(c * x + s * z, c * z - s * x, k, (np.arange(21) - 10) * 0.05, p.strip)
        return pa.table({"capture_id": own["capture_id"][:1], "angle": pa.array([coarse + fine])})

    kind = dict(points.dtypes)["capture_id"]
    return places.groupBy("capture_id").applyInArrow(run, f"capture_id {kind}, angle double").select("capture_id", F.round("angle", 2).alias("angle"))


def wall_spikes(strip_counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Strips with enough points that none within two strips exceeds; equal ones are all kept. ``centre`` is the strip's middle."""
    w = Window.partitionBy("capture_id", "axis").orderBy("strip").rangeBetween(-p.peak_reach, p.peak_reach)
    top = strip_counts.withColumn("most", F.max("n").over(w))
    return top.where((F.col("n") >= p.min_peak_points) & (F.col("n") == F.col("most"))).select("capture_id", "axis", "strip", "n", ((F.col("strip") + 0.5) * p.strip).alias("centre"))


def cells_of(x: Column, z: Column, ox: Column, oz: Column, cell: float) -> list[Column]:
    """row and col of the plan's grid; parts of cells are cut towards zero."""
    return [((z - oz) / cell).cast("int").alias("row"), ((x - ox) / cell).cast("int").alias("col")]


#: Points that are dealt to one task.
POINTS = 500_000


def with_cells(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Points with row and col of a grid that begins 0.2 m before the first point. They are dealt to tasks by capture."""
    points = dealt(points, POINTS, "capture_id")
    origin = points.groupBy("capture_id").agg((F.min("x") - p.grid_margin).alias("ox"), (F.min("z") - p.grid_margin).alias("oz"))
    return points.join(keyed(origin), "capture_id").select(*points.columns, *cells_of(F.col("x"), F.col("z"), F.col("ox"), F.col("oz"), p.grid))


def surface_of(y: Column, ceiling: Column) -> Column:
    return F.when(y < 0.15, "floor").when(y > ceiling - 0.25, "ceiling").otherwise("wall")


def floor_cells(points: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Mean height and number of floor points by cell of 10 cm."""
    return points.groupBy(*keys, F.floor(F.col("x") / p.floor_cell).cast("long").alias("fx"), F.floor(F.col("z") / p.floor_cell).cast("long").alias("fz")).agg(F.avg("y").alias("y"), F.count("*").alias("n"))


def height_offset(plan: DataFrame, chunk: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Median height of the plan over a chunk in the cells that both have; null where these are fewer than 50."""
    both = plan.select("capture_id", "fx", "fz", F.col("y").alias("plan_y")).join(chunk, ["capture_id", "fx", "fz"])
    m = both.groupBy("capture_id", "chunk").agg(F.median(F.col("plan_y") - F.col("y")).alias("offset"), F.count("*").alias("n_cells"))
    return m.select("capture_id", "chunk", "n_cells", F.when(F.col("n_cells") >= p.min_floor_cells, F.col("offset")).alias("offset"))


def top_colour(cells: DataFrame) -> DataFrame:
    """Colour of the highest point of each cell; of equally high ones that of the greatest ord and line."""
    return cells.groupBy("capture_id", "row", "col").agg(F.max_by(F.struct("r", "g", "b"), F.struct("y", "ord", "line")).alias("c")).select("capture_id", "row", "col", "c.*")


def density(cells: DataFrame) -> DataFrame:
    """Points of each cell over the 95th percentile of its capture's cells, at most 1."""
    n = cells.groupBy("capture_id", "row", "col").agg(F.count("*").alias("n"))
    top = n.groupBy("capture_id").agg(F.percentile("n", 0.95).alias("top"))
    return n.join(keyed(top), "capture_id").select("capture_id", "row", "col", F.least(F.lit(1.0), F.col("n") / F.col("top")).alias("density"))
