"""Operator 4: exact top-k search by inner product with two cover trees.

Vectors are dealt to the nearest of some pivots; each pivot's cell is cut into shells by the distance to it, and these into blocks of
bounded size. First each query group is searched in the block nearest to the pivot of its cell, which bounds its kth scores from below.
Then each group goes to the blocks in which some query of it can score better, by pivot, shell radius and kth score, and to no other, and
a block is sent only to the groups that it can serve. There a cover tree over the queries and one over the block are walked together:
a pair of nodes is left out when no pair of their points can reach the worst kth score of the query node. Results of blocks are merged
by query. Pivots and pruning decide only about the work; results are exact.

Where points are nearly as far from each other as their centre bounds them (random directions in many dimensions), no radius
leaves anything out, whatever the tree; its nodes are then single points, each scored once, and the work is that of all products.

Equal vectors matter only by their smallest ids: no more than k + 1 of each are kept (a query itself may be among
them), so a vector that a third of all rows share is as cheap as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise, ship

#: Pivots, and the vectors they are chosen from: those of the smallest hashes.
PIVOTS, SAMPLE = 48, 2048
#: Shells of a cell at most: a power of two.
SHELLS = 16
#: Vectors of a block and queries of a group, about.
BLOCK, GROUP = 4096, 4096
#: Points of a tree's leaf, and the factor by which covering radii shrink from level to level.
LEAF, SHRINK = 48, 0.7
#: Points among which the next centres of a level are chosen at once.
BATCH = 256
#: Scores are integers, so this only covers the rounding of bounds.
MARGIN = 1e-3
#: Integers and their products are exact up to here.
EXACT = 2**53


class Tree(NamedTuple):
    """Nodes in breadth-first order: centre row, covering radius of all points below, children (first, last), number of points, and rows of leaves."""

    points: np.ndarray
    norms: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    size: np.ndarray
    rows: list[np.ndarray]

    def inner(self, nodes: np.ndarray) -> np.ndarray:
        return self.last[nodes] > self.first[nodes]

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of all these nodes."""
        return np.concatenate([np.arange(self.first[n], self.last[n]) for n in nodes.tolist()]) if len(nodes) else nodes


def _gaps(points: np.ndarray, squares: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares[a][:, None] + squares[b][None, :] - 2 * points[a] @ points[b].T, 0))


def _net(points: np.ndarray, squares: np.ndarray, own: np.ndarray, reach: float) -> list[tuple[int, np.ndarray, float]]:
    """Points of ``own`` further than ``reach`` apart that cover it within that: each with the rows it covers and its radius."""
    leads: list[int] = []
    who, gap = np.zeros(len(own), np.int64), np.zeros(len(own))
    left = np.arange(len(own))
    while len(left):
        some = left[:BATCH]
        between = _gaps(points, squares, own[some], own[some]) <= reach
        free, new = np.ones(len(some), dtype=bool), []
        for i in range(len(some)):
            if free[i]:
                new.append(i)
                free &= ~between[i]
        apart = _gaps(points, squares, own[some[new]], own[left])
        apart[np.arange(len(new)), new] = 0  # a centre has itself; the batch stands first among those left
        near = apart.argmin(axis=0)
        dist = apart[near, np.arange(len(left))]
        done = dist <= reach
        who[left[done]], gap[left[done]] = near[done] + len(leads), dist[done]
        leads += own[some[new]].tolist()
        left = left[~done]
    order = np.argsort(who, kind="stable")
    cuts = np.searchsorted(who[order], np.arange(len(leads) + 1))
    return [(lead, own[order[a:b]], float(gap[order[a:b]].max())) for lead, a, b in zip(leads, cuts[:-1], cuts[1:], strict=True)]


def build(points: np.ndarray) -> Tree:
    """A cover tree: the children of a node are points of it further apart than SHRINK times its radius (or less, where one would
    cover all), which cover it within that. Leaves have LEAF points or fewer, or equal ones."""
    points = points.astype(np.float64)
    squares = (points * points).sum(axis=1)
    every = np.arange(len(points))
    root = int(np.argmin(squares - 2 * points @ points.mean(axis=0)))
    centre, radius = [root], [float(_gaps(points, squares, np.array([root]), every).max())]
    first, last, rows = [0], [0], [every]
    size, node = [len(points)], 0
    while node < len(centre):
        own = rows[node]
        if len(own) > LEAF and radius[node] > 0:
            reach = radius[node] * SHRINK
            while len(level := _net(points, squares, own, reach)) == 1:
                reach *= SHRINK
            first[node], last[node], rows[node] = len(centre), len(centre) + len(level), every[:0]
            for lead, part, far in level:
                centre.append(lead)
                radius.append(far if len(part) > 1 else 0.0)
                first.append(0)
                last.append(0)
                rows.append(part)
                size.append(len(part))
        node += 1
    return Tree(points, np.sqrt(squares), *(np.array(x) for x in (centre, radius, first, last, size)), rows)


class Best(NamedTuple):
    """The k best of each query: scores, ids and rows (best first; -inf where there are fewer)."""

    score: np.ndarray
    ident: np.ndarray
    row: np.ndarray


class Work:
    """What a search did: pairs of nodes looked at and left out, and pairs of points scored."""

    def __init__(self) -> None:
        self.pairs = self.pruned = self.scored = 0


def search(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, work: Work | None = None) -> Best:
    """Exact top k of each query among ``data`` by inner product, ties to smaller ids; only scores of ``least`` or more count."""
    floor = np.full(len(queries), -np.inf) if least is None else least.astype(np.float64)
    best = Best(np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max), np.zeros((len(queries), k), np.int64))
    work = work or Work()
    if not len(queries) or not len(data):
        return best
    q, d = build(queries), build(data)
    if q.norms.max() * d.norms.max() >= EXACT:
        raise OverflowError("inner products beyond 2**53 can't be told exactly")
    worst = floor.copy()  # of each query: what a score must reach
    q_centre, d_centre = q.points[q.centre], d.points[d.centre]
    q_norm, d_norm = q.norms[q.centre], d.norms[d.centre]

    members: list[np.ndarray] = list(q.rows)
    for i in range(len(q.centre) - 1, -1, -1):
        if q.last[i] > q.first[i]:
            members[i] = np.concatenate(members[q.first[i] : q.last[i]])

    def can(i: int, js: np.ndarray) -> np.ndarray:
        """The data nodes below which a point can score enough for a query below node i."""
        most = d_centre[js] @ q_centre[i] + q.radius[i] * d_norm[js] + d.radius[js] * q_norm[i] + q.radius[i] * d.radius[js]
        left = js[most + MARGIN >= worst[members[i]].min()]
        work.pairs, work.pruned = work.pairs + len(js), work.pruned + len(js) - len(left)
        return left

    def offer(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray) -> None:
        """Takes scores of data rows into the best."""
        bar = worst[rows]
        if scores.shape[1] > k:
            bar = np.maximum(bar, np.partition(scores, -k, axis=1)[:, -k])
        at, col = np.nonzero(scores >= bar[:, None])
        if not len(at):
            return
        who = np.concatenate([at, np.repeat(np.arange(len(rows)), k)])
        score = np.concatenate([scores[at, col], best.score[rows].ravel()])
        row = np.concatenate([cols[col], best.row[rows].ravel()])
        ident = np.concatenate([ids[cols[col]], best.ident[rows].ravel()])
        order = np.lexsort((ident, -score, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order, place = order[place < k], place[place < k]
        to = rows[who[order]]
        best.score[to, place], best.ident[to, place], best.row[to, place] = score[order], ident[order], row[order]
        worst[rows] = np.maximum(worst[rows], best.score[rows][:, -1])

    def leaf(i: int, js: np.ndarray) -> None:
        rows = q.rows[i]
        points, norms = q.points[rows], q.norms[rows]
        while len(js):
            scores = points @ d_centre[js].T
            work.scored += scores.size
            work.pairs += len(js)
            if len(js) >= k:  # centres are points too, each another one
                worst[rows] = np.maximum(worst[rows], np.partition(scores, -k, axis=1)[:, -k])
            alive = (scores + norms[:, None] * d.radius[js] + MARGIN >= worst[rows][:, None]).any(axis=0)
            work.pruned += len(js) - int(alive.sum())
            single = d.size[js] == 1
            if (alive & single).any():
                offer(rows, d.centre[js[alive & single]], scores[:, alive & single])
            js = js[alive & ~single]
            inner = d.inner(js)
            some = [d.rows[j] for j in js[~inner].tolist()]
            if some:
                cols = np.concatenate(some)
                work.scored += len(rows) * len(cols)
                offer(rows, cols, points @ d.points[cols].T)
            js = d.below(js[inner])

    stack = [(0, np.array([0]))]
    while stack:
        i, js = stack.pop()
        js = can(i, js)
        if q.last[i] == q.first[i]:
            leaf(i, js)
            continue
        # data nodes wider than the query node are opened before it is
        while len(wide := js[d.inner(js) & (d.radius[js] > q.radius[i])]):
            js = np.concatenate([js[~(d.inner(js) & (d.radius[js] > q.radius[i]))], can(i, d.below(wide))])
        if len(js):
            stack += [(n, js) for n in range(q.first[i], q.last[i])]
    return best


def _quantise(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for ident, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if ident is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    x = np.floor(x * scale)
                    if len(x) and np.abs(x).max() >= EXACT:
                        raise OverflowError("components beyond 2**53 can't be told exactly")
                    ids.append(ident)
                    vectors.append(np.trim_zeros(x.astype("<i8"), "b").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["id", "v"])

    return run


def matrix(blobs, width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width), dtype=np.int64)
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, dtype="<i8")
        out[i, : len(x)] = x
    return out


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: the top of a cover tree over the sample. Pivots near each other stand near each other."""
    points = points.astype(np.float64)
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    row = [chosen.pop(0)]
    while chosen:
        row.append(chosen.pop(int(np.argmin(((points[chosen] - points[row[-1]]) ** 2).sum(axis=1)))))
    return points[row]


def _cells(pivots, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        square = (p * p).sum(axis=1)
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), width).astype(np.float64)
            gap = (x * x).sum(axis=1)[:, None] + square[None, :] - 2 * x @ p.T
            cell = gap.argmin(axis=1)
            far = np.sqrt(np.maximum(gap[np.arange(len(x)), cell], 0)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return run


def _reach(pivots, radius, width: int):
    """The cells in which a query can reach its least score, and how far from the pivot a vector must be for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, r = pivots.value, radius
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), width).astype(np.float64)
            norm = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)
            least = batch.column("least").fill_null(float("-inf")).to_numpy(zero_copy_only=False)
            need = (least[:, None] - MARGIN - x @ p.T) / norm[:, None]
            row, cell = np.nonzero((need <= r[None, :]) & (r[None, :] >= 0))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(cell.astype(np.int32)), pa.array(need[row, cell])], [*batch.schema.names, "cell", "need"])

    return run


FOUND = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("m", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "q long, id long, m long, score long"


def _search_groups(k: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data, queries = matrix(left.column("v").to_pylist(), width), matrix(right.column("v").to_pylist(), width)
        least = right.column("least").fill_null(float("-inf")).to_numpy()
        best = search(queries, data, left.column("id").to_numpy(), k, least)
        row, col = np.nonzero(np.isfinite(best.score))
        times = left.column("m").to_numpy()[best.row[row, col]]
        return pa.table([right.column("q").to_numpy()[row], best.ident[row, col], times, best.score[row, col].astype(np.int64)], schema=FOUND)

    return run


def groups_of(counts: list[int], size: int) -> tuple[list[int], list[int]]:
    """First group and number of groups of each cell: small neighbouring cells share one, large ones have several."""
    first, parts, held, now = [], [], 0, 0
    for n in counts:
        if n > size or held + n > size:
            now, held = now + (held > 0), 0
        first.append(now)
        parts.append(max(-(-n // size), 1))
        if n > size:
            now += parts[-1]
        else:
            held += n
    return first, parts


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank (from 1), vec_id, score.

    Components x become floor(scale * x); queries are the rows whose id is divisible by ``every``, candidates all rows but the query's
    own. Ties go to smaller ids; a query with fewer candidates has fewer rows. Rows with a null id, and vectors that are
    null or hold null or non-finite components, take no part. Shorter vectors count as if zeros followed. Rows
    that repeat, or share an id, are rows like all others: each is a candidate of the other, and each asks for itself. Further columns
    aren't used; an empty table gives an empty result. Components or inner products beyond 2**53 raise an OverflowError.
    """
    spark = vectors.sparkSession
    ship(spark)
    result = "query_id long, rank int, vec_id long, score long"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_quantise(scale), "id long, v binary")
    rows = materialise(rows.groupBy("id", "v").agg(F.count("*").alias("m")), "vectors")
    # the smallest ids of equal vectors
    kept = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1).drop("place")
    width = (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8 or 1
    sample = rows.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return spark.createDataFrame([], result)
    pivots = spark.sparkContext.broadcast(choose_pivots(matrix(sample, width), PIVOTS))
    n = len(pivots.value)
    placed = materialise(kept.mapInArrow(_cells(pivots, width), "id long, v binary, m long, cell int, far double"), "placed")
    cuts = F.percentile_approx("far", [i / SHELLS for i in range(1, SHELLS)]).alias("cuts")
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), cuts).collect()}  # PIVOTS rows at most
    radius = np.array([cells[i].far if i in cells else -1.0 for i in range(n)])
    bounds = []
    for i in range(n):
        shells = 1
        while i in cells and shells < SHELLS and shells * block < cells[i].n:
            shells *= 2
        step = SHELLS // shells
        bounds.append([float(cells[i].cuts[j * step - 1]) for j in range(1, shells)] if i in cells else [])
    own_bounds = F.get(F.array(*[F.array(*[F.lit(x) for x in b]).cast("array<double>") for b in bounds]), F.col("cell"))
    shelled = placed.withColumn("shell", F.size(F.filter(own_bounds, lambda b: b < F.col("far"))))
    shells = shelled.groupBy("cell", "shell").agg(F.max("far").alias("edge"), F.ceil(F.count("*") / block).cast("int").alias("parts"))
    shells = spark.createDataFrame(shells.collect(), "cell int, shell int, edge double, parts int")  # PIVOTS * SHELLS rows at most
    block_of = ["cell", "shell", "part"]
    data = shelled.join(F.broadcast(shells.drop("edge")), ["cell", "shell"]).select("id", "v", "m", "cell", "shell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))

    asked = rows.where(F.col("id") % every == 0)
    queries = asked.select("v").distinct().mapInArrow(_cells(pivots, width), "v binary, cell int, far double").select(F.monotonically_increasing_id().alias("q"), "v", "cell")
    queries = materialise(queries, "queries")
    many = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    first, parts = groups_of([many.get(i, 0) for i in range(n)], group)
    at = lambda x: F.get(F.array(*[F.lit(i) for i in x]), F.col("cell"))
    queries = queries.withColumn("group", (at(first) + F.pmod(F.xxhash64("q"), at(parts))).cast("int"))
    # first look: each query in one block of its own cell gives a score that k + 1 vectors reach
    inmost = data.where("shell = 0 and part = 0").withColumn("group", F.explode(F.sequence(at(first), at(first) + at(parts) - 1)))
    near = inmost.groupBy("cell", "group").cogroup(queries.withColumn("least", F.lit(None).cast("double")).groupBy("cell", "group")).applyInArrow(_search_groups(k + 1, width), FOUND_DDL)
    floors = near.groupBy("q").agg(F.when(F.count("*") > k, F.min("score").cast("double")).alias("least"))
    # then every query in every block that can hold something as good, and every block with the groups of these
    asking = queries.drop("cell").join(floors, "q", "left").select("q", "v", "group", "least")
    sent = materialise(asking.mapInArrow(_reach(pivots, radius, width), "q long, v binary, group int, least double, cell int, need double"), "reach")
    blocks = shells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    sent_to = sent.join(blocks, "cell").where("need <= edge").select("q", "v", "least", "group", *block_of)
    served = sent.groupBy("group", "cell").agg(F.min("need").alias("need")).join(blocks, "cell").where("need <= edge").select(F.col("group").alias("to"), *block_of)
    found = data.join(served, block_of).groupBy(*block_of, "to").cogroup(sent_to.groupBy(*[F.col(c).alias(f"{c}_") for c in block_of], "group")).applyInArrow(_search_groups(k + 1, width), FOUND_DDL)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "m"))).alias("best"))
    answers = asked.mapInArrow(_squares(width), "id long, v binary, m long, square long").join(queries.select("q", "v"), "v").join(lists, "q")
    each = F.flatten(F.transform("best", lambda b: F.array_repeat(F.struct(b["id"].alias("id"), b["score"].alias("score")), F.least(b["m"], F.lit(k + 1)).cast("int"))))
    answers = answers.withColumn("every", each).withColumn("own", F.array_position("every", F.struct(F.col("id").alias("id"), F.col("square").alias("score"))))
    others = F.when(F.col("own") > 0, F.concat(F.slice("every", 1, F.col("own") - 1), F.slice("every", F.col("own") + 1, F.size("every")))).otherwise(F.col("every"))
    answers = answers.withColumn("others", F.slice(others, 1, k)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("others").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def _squares(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x * x).sum(axis=1), pa.int64())], [*batch.schema.names, "square"])

    return run
