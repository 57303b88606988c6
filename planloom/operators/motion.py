"""Operators on moving captures: drift from chunk to chunk, pieces of a path, similarity between paths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import DEFAULTS, Params
from ..storage import dealt, keyed, written
from . import frames as fr
from .points import voxel_downsample

C = F.col


class FloorMap:
    """Floor heights by cell, as sums and numbers of points: what a chunk saw, and the state that drift correction carries from chunk to chunk.

    ``at`` are the cells, each once and in order, as one number each.
    """

    def __init__(self, at=(), total=(), n=()):
        self.at, self.total, self.n = np.asarray(at, np.int64), np.asarray(total, np.float64), np.asarray(n, np.int64)

    def offset(self, floor: FloorMap, least: int) -> float | None:
        """Median height of the map over a chunk's floor in shared cells; None where these are few."""
        _, i, j = np.intersect1d(self.at, floor.at, assume_unique=True, return_indices=True)
        return float(np.median(self.total[i] / self.n[i] - floor.total[j] / floor.n[j])) if len(i) >= max(least, 1) else None

    def add(self, floor: FloorMap, lift: float) -> None:
        at = np.union1d(self.at, floor.at)
        total, n = np.zeros(len(at)), np.zeros(len(at), np.int64)
        mine, own = np.searchsorted(at, self.at), np.searchsorted(at, floor.at)
        total[mine], n[mine] = self.total, self.n
        total[own] = total[own] + floor.total + lift * floor.n
        n[own] += floor.n
        self.at, self.total, self.n = at, total, n


def step(state: FloorMap, lift: float, floor: FloorMap, reference: float | None = None, p: Params = DEFAULTS) -> tuple[float, float | None, bool]:
    """The lift after a chunk, its offset, and whether the chunk's floor was used.

    Only cells that, lifted, lie within 15 cm of the capture's floor (``reference``, if given) can be floor. A chunk whose offset is more than 5 cm off the lift so
    far keeps that lift, and its floor isn't added.
    """
    if reference is not None:
        near = np.abs(floor.total / floor.n + lift - reference) <= p.max_floor_gap
        floor = FloorMap(floor.at[near], floor.total[near], floor.n[near])
    if not len(state.at):
        state.add(floor, lift)
        return lift, 0.0, True
    offset = state.offset(floor, p.min_floor_cells)
    if offset is None:
        state.add(floor, lift)
        return lift, None, True
    if abs(offset - lift) > p.max_lift_step:
        return lift, offset, False
    state.add(floor, offset)
    return offset, offset, True


def chunk_floors(own: pd.DataFrame):
    """Chunks in order, with their floor cells (sum, number) and the capture's floor, if there is a column of it."""
    number, fx, fz, y, n = (own[c].to_numpy() for c in ("chunk", "fx", "fz", "y", "n"))
    at = fx.astype(np.int64) << 32 | fz.astype(np.int64) & 0xFFFFFFFF
    order = np.lexsort((at, number))
    for rows in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
        chunk, floor = number[rows[0]], FloorMap(at[rows], y[rows] * n[rows], n[rows])
        reference = own["reference"].iloc[rows[0]] if "reference" in own else None
        yield chunk, floor, None if reference is None or pd.isna(reference) else float(reference)


def drift_lifts(cells: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Lift of each chunk of a capture, carried from chunk to chunk: capture_id, chunk, lift, offset, used.

    ``cells`` are floor cells (capture_id, chunk, fx, fz, y, n and, if known, reference: the capture's floor). Only these, not points, are brought together
    by capture; they are bounded by the home's floor.
    """
    kind = dict(cells.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, lift, rows = FloorMap(), 0.0, []
        for chunk, floor, reference in chunk_floors(pdf):
            lift, offset, used = step(state, lift, floor, reference, p)
            rows.append((pdf["capture_id"].iloc[0], chunk, lift, offset, used))
        return pd.DataFrame(rows, columns=["capture_id", "chunk", "lift", "offset", "used"])

    return cells.groupBy("capture_id").applyInPandas(run, f"capture_id {kind['capture_id']}, chunk long, lift double, offset double, used boolean")


def correct(points: DataFrame, lifts: DataFrame) -> DataFrame:
    """Points with their chunk's lift added. Lifts meet points by capture, so points that are dealt by capture aren't shuffled."""
    j = points.join(keyed(by_chunk(lifts, "lift")), "capture_id", "left")
    return j.withColumn("y", C("y") + F.coalesce(F.try_element_at("told", C("chunk"))["lift"], F.lit(0.0))).drop("told")


def by_chunk(rows: DataFrame, *names: str) -> DataFrame:
    """What is told of chunks as one map a capture, by chunk, so that it meets points by capture alone: capture_id, told."""
    entry = F.struct("chunk", F.struct(*names).alias("told"))
    return rows.where("chunk is not null").groupBy("capture_id").agg(F.map_from_entries(F.collect_list(entry)).alias("told"))


def similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Scale, rotation and shift that take points x, y, z best onto xx, yy, zz: keys, scale, r00 to r22, tx, ty, tz, n.

    Sums of products are one aggregation; only these few numbers of each group go through a singular value decomposition.
    """
    a, b = ("x", "y", "z"), ("xx", "yy", "zz")
    sums = [F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (*a, *b)], *[F.avg(C(p) * C(q)).alias(f"p_{p}_{q}") for p in a for q in b], F.avg(sum((C(c) * C(c) for c in a), F.lit(0.0))).alias("square")]
    out = ["scale", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"]
    kinds = dict(pairs.dtypes)

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                ma, mb = np.array([getattr(r, f"m_{c}") for c in a]), np.array([getattr(r, f"m_{c}") for c in b])
                cov = np.array([[getattr(r, f"p_{p}_{q}") for p in a] for q in b]) - np.outer(mb, ma)
                u, d, vt = np.linalg.svd(cov)
                sign = np.array([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1])
                rot = u @ np.diag(sign) @ vt
                var = r.square - ma @ ma
                scale = float((d * sign).sum() / var) if var > 0 else 1.0
                rows.append([*[getattr(r, k) for k in keys], scale, *rot.ravel(), *(mb - scale * rot @ ma), r.n])
            yield pd.DataFrame(rows, columns=[*keys, *out, "n"])

    ddl = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} double" for c in out] + ["n long"])
    return pairs.groupBy(*keys).agg(*sums).mapInPandas(run, ddl)


#: Normals of a group that pairs are formed of, partners that each gets, and the side of the bins in which directions are counted.
TRIALS, PARTNERS, BIN = 300, 2, 0.04
#: Normals whose pairs are formed by one task.
TRIED = 30_000
#: Times that the chosen directions are centred on bins.
REFINED = 3


def box_directions(normals: DataFrame, keys: list[str], tolerance: float = 10.0, right: float = 5.0, trials: int = TRIALS, partners: int = PARTNERS) -> DataFrame:
    """The three directions at right angles along which most normals lie: keys, d (0 to 2), x, y, z, inliers, n.

    Pairs of normals at right angles (within 5 degrees) give candidates: the first of a pair, what the second has across it, and their cross product. Of each group the
    ``trials`` normals of the smallest hashes are tried, each with the ``partners`` among them of the smallest hashes, so that runs agree. All normals vote on all candidates
    at once, counted by small bins of directions, so a group costs its bins times its candidates however many normals it has. A normal votes where it lies within 10 degrees of one of the three. Of the
    best candidate (of equal ones the first), each direction then becomes the mean of what lies along it, first of bins, again and again, so that it comes to lie in the middle of its surfaces and not of stray
    normals, and last of all normals; the one of most normals stays so, and the others are put at right angles to it.
    """
    from pyspark.sql import Window

    v = tuple(C(c) for c in "xyz")
    cos, sin = (float(f(np.radians(d))) for f, d in ((np.cos, tolerance), (np.sin, right)))
    w = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
    few = normals.withColumn("k", F.row_number().over(w)).where(C("k") <= trials).select(*keys, "k", *"xyz")
    few = dealt(written(few, "normals"), TRIED, *keys)
    side = lambda n: few.select(*keys, C("k").alias(f"k{n}"), *[C(c).alias(f"{n}{c}") for c in "xyz"])
    a, b = (tuple(C(f"{n}{c}") for c in "xyz") for n in "ab")
    pairs = side("a").join(keyed(side("b")), keys).where((C("ka") != C("kb")) & (F.abs(g.dot(a, b)) < sin))
    pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "ka").orderBy(F.xxhash64("ka", "kb"), "kb"))).where(C("place") <= partners)
    along = g.dot(a, b)
    flat = tuple(y - along * x for x, y in zip(a, b, strict=True))
    size = F.sqrt(g.dot(flat, flat))
    pairs = pairs.select(*keys, "ka", "place", *[C(f"a{c}") for c in "xyz"], *[(y / size).alias(f"b{c}") for c, y in zip("xyz", flat, strict=True)])
    frames = written(pairs.select("*", *[x.alias(f"c{c}") for c, x in zip("xyz", g.cross(a, b), strict=True)]), "frames")
    bins = normals.groupBy(*keys, *[F.floor(c / BIN).cast("int").alias(f"v{n}") for n, c in zip("xyz", v, strict=True)]).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))
    mean = F.sqrt(g.dot(v, v))
    bins = bins.select(*keys, *[(C(c) / F.when(mean > 0, mean)).alias(c) for c in "xyz"], "n")
    near = F.greatest(*[F.abs(g.dot(v, tuple(C(f"{n}{c}") for c in "xyz"))) for n in "abc"])
    votes = bins.join(keyed(frames.select(*keys, "ka", "place", *[f"{n}{c}" for n in "abc" for c in "xyz"])), keys).groupBy(*keys, "ka", "place").agg(F.sum(F.when(near > cos, C("n")).otherwise(0)).alias("inliers"))
    best = votes.groupBy(*keys).agg(F.max_by(F.struct("ka", "place"), F.struct(C("inliers"), -C("ka"), -C("place"))).alias("b")).select(*keys, "b.ka", "b.place")
    three = F.posexplode(F.array(*[F.struct(*[C(f"{n}{c}").alias(f"o{c}") for c in "xyz"]) for n in "abc"])).alias("d", "o")
    chosen = frames.join(keyed(best), [*keys, "ka", "place"]).select(*keys, three).select(*keys, "d", "o.*")
    kept = F.when(F.abs("cos") > cos, F.signum("cos"))

    def centred(own: DataFrame, axes: DataFrame) -> DataFrame:
        """Each direction as the mean of what lies along it; x, y, z and the numbers of those and of all."""
        j = own.join(keyed(axes), keys).withColumn("cos", g.dot(v, tuple(C(f"o{c}") for c in "xyz")))
        m = j.groupBy(*keys, "d").agg(*[F.sum(C(c) * kept * C("n")).alias(c) for c in "xyz"], F.sum(F.when(kept.isNotNull(), C("n")).otherwise(0)).alias("inliers"), F.sum("n").alias("n"))
        return m.select(*keys, "d", *[(C(c) / mean).alias(c) for c in "xyz"], "inliers", "n")

    as_axes = lambda df: df.select(*keys, "d", *[C(c).alias(f"o{c}") for c in "xyz"])
    for _ in range(REFINED):
        chosen = as_axes(centred(bins, chosen))
    told = centred(normals.withColumn("n", F.lit(1).cast("long")), chosen)
    # at right angles again: that of most normals stays, the next is what it has across that, the last what is across both
    kinds = dict(normals.dtypes)
    one = F.array(*[C(c).cast("double") for c in ("inliers", "d", "x", "y", "z")])
    ranked = told.where("x is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(one), asc=False).alias("s"), F.first("n").alias("n")).where(F.size("s") > 1)

    def square(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                s = np.array([list(x) for x in r.s], float)
                p = s[0, 2:]
                q = s[1, 2:] - p * (p @ s[1, 2:])
                q /= np.linalg.norm(q)
                rest = ({0.0, 1.0, 2.0} - set(s[:2, 1])).pop()
                last = s[2, 0] if len(s) > 2 else 0
                for d, axis, inliers in ((s[0, 1], p, s[0, 0]), (s[1, 1], q, s[1, 0]), (rest, np.cross(p, q), last)):
                    rows.append([*[getattr(r, k) for k in keys], int(d), *axis, int(inliers), r.n])
            yield pd.DataFrame(rows, columns=[*keys, "d", *"xyz", "inliers", "n"])

    return ranked.mapInPandas(square, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["d int", "x double", "y double", "z double", "inliers long", "n long"]))


def piece_up(candidates: DataFrame, rough: DataFrame, keys: list[str], min_walk: float = 0.5, max_tilt: float = 60.0) -> DataFrame:
    """Which of a piece's three directions is up: that of least path extent if the second extent is over half a metre, else the one nearest the cameras' up.

    ``candidates`` has x, y, z and extent. The direction is turned towards the cameras' up; null if it is more than 60 degrees off.
    """
    up = rough.select(*keys, *[C(c).alias(f"u{c}") for c in "xyz"])
    j = candidates.join(keyed(up), keys).withColumn("cos", g.dot((C("x"), C("y"), C("z")), (C("ux"), C("uy"), C("uz"))))
    own = F.struct("x", "y", "z", "cos", "extent")
    m = j.groupBy(*keys).agg(F.min_by(own, "extent").alias("flat"), F.max_by(own, F.abs("cos")).alias("near"), F.sort_array(F.collect_list("extent")).alias("extents"))
    pick = F.when(F.get("extents", F.lit(1)) > min_walk, C("flat")).otherwise(C("near"))
    m = m.select(*keys, pick.alias("u")).withColumn("s", F.when(C("u.cos") < 0, -1.0).otherwise(1.0))
    ok = F.abs("u.cos") >= float(np.cos(np.radians(max_tilt)))
    return m.select(*keys, *[F.when(ok, C(f"u.{c}") * C("s")).alias(c) for c in "xyz"])


def metric_points(pixels: DataFrame, poses: DataFrame, scales: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Upright points of pieces in metres: piece, x, y, z, w by voxel, y upwards.

    ``pixels`` are piece, frame (of one piece only), row, col, depth in metres; ``poses`` have the camera of each frame in the piece's own frame and units (px to pz, qx to qw) and its
    intrinsics; ``scales`` the metres of a unit. Pixels go to the piece's frame by pose, their normals give the room's three directions; up is the one that
    ``piece_up`` picks by the cameras' path and their own up; points are turned so that it is y, and thinned to voxels.
    """
    key = ["piece"]
    metric = poses.join(keyed(scales), key).select("piece", "frame", *[(C(c) * C("scale")).alias(c) for c in ("px", "py", "pz")], "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")
    world = fr.to_world(pixels.select("piece", "frame", "row", "col", "depth"), keyed(metric), ["piece", "frame"])
    found = fr.normals(world).join(keyed(metric.select("piece", "frame").distinct()), "frame")
    normals = found.select("piece", F.xxhash64("frame", "row", "col").alias("id"), C("nx").alias("x"), C("ny").alias("y"), C("nz").alias("z"))
    box = box_directions(normals, key).select("piece", "d", "x", "y", "z")
    path = box.join(keyed(metric.select("piece", "px", "py", "pz")), key).groupBy("piece", "d", "x", "y", "z")
    at = g.dot((C("x"), C("y"), C("z")), (C("px"), C("py"), C("pz")))
    candidates = path.agg((F.max(at) - F.min(at)).alias("extent")).drop("d")
    # rows of pictures go down, so a camera's up is its -y
    m = g.quaternion_to_matrix(C("qx"), C("qy"), C("qz"), C("qw"))
    rough = fr.mean_direction(metric, key, list(g.rotate(m, F.lit(0.0), F.lit(-1.0), F.lit(0.0))))
    up = piece_up(candidates, rough, key).where("x is not null").select("piece", *[C(c).alias(f"u{c}") for c in "xyz"])
    turn = g.rotation_between((C("ux"), C("uy"), C("uz")), (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    x, y, z = g.rotate(turn, C("x"), C("y"), C("z"))
    none = [F.lit(0.0).alias(c) for c in "rgb"]
    upright = world.join(keyed(up), key).select("piece", x.alias("x"), y.alias("y"), z.alias("z"), *none, F.lit(1.0).alias("w"))
    return voxel_downsample(upright, key, p).select("piece", "x", "y", "z", "w")


def _overlaps(at: np.ndarray, plan: np.ndarray, turns: list[float], shifts: list[float], cell: float) -> np.ndarray:
    """How many of the plan's cells (row, col) places (x, z) lie on, by turn and by shift along x and z. Cells that several places lie on count once."""
    rows, cols = np.unique(plan[:, 0]), np.unique(plan[:, 1])
    # numbers of the plan's cells by the rows and columns that it has; 0, and a last row and column, for cells elsewhere
    known = np.zeros((len(rows) + 1, len(cols) + 1), np.int64)
    at_row, at_col = np.searchsorted(rows, plan[:, 0]), np.searchsorted(cols, plan[:, 1])
    known[at_row, at_col] = 1
    known[known > 0] = np.arange(1, known.sum() + 1)
    size = int(known.max()) + 1
    known, wide = known.ravel(), known.shape[1]
    mine = size * np.arange(len(shifts))[:, None]

    def among(values: np.ndarray, own: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(own, values), len(own) - 1)
        return np.where(own[i] == values, i, len(own))

    out = np.zeros((len(turns), len(shifts), len(shifts)), np.int64)
    by = np.array(shifts)[:, None]
    for t, turn in enumerate(turns):
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        col = among(np.floor((c * at[:, 0] - s * at[:, 1] + by) / cell), cols)
        row = among(np.floor((s * at[:, 0] + c * at[:, 1] + by) / cell), rows)
        for k, own in enumerate(row):
            met = np.zeros(size * len(shifts), bool)
            met[known[own * wide + col] + mine] = True
            out[t, :, k] = np.count_nonzero(met.reshape(len(shifts), size)[:, 1:], axis=1)
    return out


def wall_anchor(plan: DataFrame, chunk: DataFrame, shifts: list[float], turns: list[float], cell: float = 0.02, min_overlap: int = 150, min_gain: float = 1.05) -> DataFrame:
    """The small move of a chunk's wall points that lays most of them on the plan's wall cells: capture_id, turn, dx, dz, overlap, start, accepted.

    All turns (about the origin) and shifts are tried; overlap counts distinct cells. Of equal overlaps the least move counts, then
    the first. It is accepted with 150 cells and 5 % more than without a move. A capture's places and cells are brought together once and all moves
    are tried there, so no table of moved places is made.
    """
    moves = np.array([(t, x, z, abs(t) + abs(x) + abs(z)) for t in turns for x in shifts for z in shifts], float)
    still = np.flatnonzero(moves[:, 3] == 0)
    kind = dict(chunk.dtypes)["capture_id"]
    schema = f"capture_id {kind}, turn double, dx double, dz double, overlap long, start long, accepted boolean"

    def run(key, own: pa.Table, cells: pa.Table) -> pa.Table:
        if key[0].as_py() is not None and own.num_rows and cells.num_rows:
            at, there = (np.stack([t[c].to_numpy() for c in names], axis=1) for t, names in ((own, "xz"), (cells, ("home_row", "home_col"))))
            n = _overlaps(at, there, turns, shifts, cell).ravel()
            best = np.lexsort((moves[:, 2], moves[:, 1], moves[:, 0], moves[:, 3], -n))[0]
            start = int(n[still].max(initial=0))
            if n[best]:
                told = {"capture_id": key[0], **dict(zip(("turn", "dx", "dz"), moves[best, :3].tolist(), strict=True)), "overlap": int(n[best]), "start": start, "accepted": bool(n[best] >= min_overlap and n[best] >= min_gain * start)}
                return pa.table({c: pa.array([v.as_py() if c == "capture_id" else v], own["capture_id"].type if c == "capture_id" else None) for c, v in told.items()})
        return pa.table({"capture_id": pa.array([], own["capture_id"].type), **{c: pa.array([], pa.float64()) for c in ("turn", "dx", "dz")}, **{c: pa.array([], pa.int64()) for c in ("overlap", "start")}, "accepted": pa.array([], pa.bool_())})

    places = chunk.select("capture_id", F.round("x", 4).alias("x"), F.round("z", 4).alias("z")).where("x is not null and z is not null").distinct()
    there = plan.where("row is not null and col is not null").select(C("capture_id").alias("home"), C("row").alias("home_row"), C("col").alias("home_col"))
    return places.groupBy("capture_id").cogroup(there.groupBy("home")).applyInArrow(run, schema)
