"""Operator 12: approximate nearest neighbours by inner product, with a robust-pruned directed graph for each shard.

Vectors are dealt to shards of bounded size by a hash. In a shard, the largest inner product becomes the smallest Euclidean distance when each vector gets one more
component, the root of what its square lacks to the longest vector's, and each query a zero. The graph starts with random edges.
Then every vector searches the graph greedily from the shard's middle; the vectors that the search came to are its candidates, from which robust
pruning keeps diverse edges: the nearest one stays and takes out those that are nearer to it, by a relaxed factor, than to
the vector itself. Edges are also added backwards and pruned where there are too many. Vectors of a batch search and prune at once.

Each query searches the graph of every shard by a beam of bounded width. What the beam holds is scored exactly, in double precision on the original
components, and the best of all shards are merged. So the neighbours found may fall short of the true ones; their scores, order and ties don't.

Equal vectors are one vertex, with the smallest ids that can matter: a vector that a third of all rows share costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise, ship

#: Vectors of a shard, about, and queries of a block.
SHARD, BLOCK = 8192, 2048
#: Edges of a vertex, beam widths while building and searching, and the factor by which pruning is relaxed.
DEGREE, BUILD_BEAM, BEAM, RELAXED = 32, 64, 128, 1.2
#: Vertices that are put in at once, queries that search at once, and vertices that a search opens at once.
BATCH, TOGETHER, OPEN = 256, 256, 4


def middle(points: np.ndarray) -> int:
    """The point nearest to the mean."""
    return int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest vertices that greedy searches come to: ids (queries, beam; -1 where there are fewer) and squared distances, nearest first.

    A search holds the ``beam`` nearest vertices seen, opens the nearest ones not yet opened, and ends when all it holds are open.
    """
    n, q = len(points), len(queries)
    squares = (points * points).sum(axis=1)
    own = (queries * queries).sum(axis=1)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # where an edge is missing
    ident = np.full((q, beam), n, np.int64)
    dist = np.full((q, beam), np.inf, points.dtype)
    opened = np.ones((q, beam), bool)
    ident[:, 0], opened[:, 0] = start, False
    dist[:, 0] = own + squares[start] - 2 * queries @ points[start]
    seen[:, start] = True
    alive = np.arange(q)
    while len(alive):
        order = np.where(opened[alive], np.inf, dist[alive])
        at = np.argpartition(order, min(OPEN, beam - 1), axis=1)[:, :OPEN]
        some = np.isfinite(np.take_along_axis(order, at, axis=1))
        going = some.any(axis=1)
        alive, at, some = alive[going], at[going], some[going]
        if not len(alive):
            break
        rows = alive[:, None]
        opened[rows, at] = True
        new = np.where(some[:, :, None], edges[np.where(some, ident[rows, at], 0)], n).reshape(len(alive), -1)
        new[seen[rows, new]] = n
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n  # the same vertex by several edges
        seen[rows, new] = True
        new = np.sort(new, axis=1)[:, : max(int((new < n).sum(axis=1).max()), 1)]
        there = np.where(new < n, new, 0)
        gap = squares[there] + own[alive][:, None] - 2 * (points[there] @ queries[alive][:, :, None])[:, :, 0]
        gap[new == n] = np.inf
        both = np.concatenate([dist[alive], gap], axis=1)
        best = np.argpartition(both, beam - 1, axis=1)[:, :beam]
        dist[alive] = np.take_along_axis(both, best, axis=1)
        ident[alive] = np.take_along_axis(np.concatenate([ident[alive], new], axis=1), best, axis=1)
        opened[alive] = np.take_along_axis(np.concatenate([opened[alive], new == n], axis=1), best, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    dist, ident = np.take_along_axis(dist, order, axis=1), np.take_along_axis(ident, order, axis=1)
    return np.where(np.isfinite(dist), ident, -1), dist


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """Edges (rows, degree; len(points) where there are fewer) of the vertices ``own`` from their candidates (-1: none; they may repeat).

    Again and again the nearest candidate left becomes an edge, and all go that are ``relaxed`` times nearer to it than to the vertex.
    """
    n = len(points)
    squares = (points * points).sum(axis=1)
    there = np.where(candidates >= 0, candidates, 0)
    gap = squares[there] + squares[own][:, None] - 2 * (points[there] @ points[own][:, :, None])[:, :, 0]
    gap[(candidates < 0) | (candidates == own[:, None])] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    there, gap = np.take_along_axis(there, order, axis=1), np.take_along_axis(gap, order, axis=1)
    some = points[there]
    between = squares[there][:, :, None] + squares[there][:, None, :] - 2 * some @ some.transpose(0, 2, 1)
    left = np.isfinite(gap)
    out = np.full((len(own), degree), n, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        at = left.argmax(axis=1)
        some = left[rows, at]
        if not some.any():
            break
        out[some, k] = there[rows, at][some]
        left &= relaxed * relaxed * between[rows, at] > gap
        left[rows, at] = False
        left &= there != there[rows, at][:, None]
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> tuple[np.ndarray, int]:
    """Edges (vertices, degree; the number of vertices where there are fewer) and the vertex where searches start. The same points give the same graph."""
    n = len(points)
    if n <= degree + 1:  # all to all
        edges = np.full((n, degree), n, np.int64)
        for i in range(n):
            edges[i, : n - 1] = np.delete(np.arange(n), i)
        return edges, middle(points)
    random = np.random.default_rng(n)
    edges = random.integers(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = n
    start = middle(points)
    order = random.permutation(n)
    for first in range(0, n, BATCH):
        own = order[first : first + BATCH]
        met, _ = beam_search(points, edges, start, points[own], beam)
        now = np.where(edges[own] < n, edges[own], -1)
        edges[own] = robust_prune(points, own, np.concatenate([met, now], axis=1), degree, relaxed)
        # edges backwards: where there is room they are added, else all are pruned together
        to, at = edges[own].ravel(), np.repeat(own, degree)
        to, at = to[to < n], at[to < n]
        by = np.argsort(to, kind="stable")
        to, at = to[by], at[by]
        heads, begin, many = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(begin, many)
        backwards = np.full((len(heads), int(many.max())), -1, np.int64)
        backwards[np.repeat(np.arange(len(heads)), many), place] = at
        old = np.where(edges[heads] < n, edges[heads], -1)
        known = (backwards[:, :, None] == old[:, None, :]).any(axis=2)
        backwards[known] = -1
        full = (old >= 0).sum(axis=1) + (backwards >= 0).sum(axis=1) > degree
        for i in np.flatnonzero(~full):
            put = np.concatenate([old[i][old[i] >= 0], backwards[i][backwards[i] >= 0]])
            edges[heads[i], : len(put)], edges[heads[i], len(put) :] = put, n
        for some in np.array_split(np.flatnonzero(full), -(-int(full.sum()) // BATCH) or 1):
            if len(some):
                edges[heads[some]] = robust_prune(points, heads[some], np.concatenate([old[some], backwards[some]], axis=1), degree, relaxed)
    return edges, start


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component, all of one length: the nearest of them to a query with a zero there has the largest inner product."""
    x = vectors / (np.abs(vectors).max() or 1.0)
    square = (x * x).sum(axis=1)
    x = np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1)
    return (x / np.sqrt(square.max())).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up component by component: the same pair gives the same double wherever it stands."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def floats(blobs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, "<f8")
        out[i, : len(x)] = x
    return out


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, blobs = [], []
        for ident, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if ident is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
            if len(x) and np.isfinite(x).all() and x.any():
                ids.append(ident)
                blobs.append((np.trim_zeros(x, "b") + 0.0).tobytes())  # no negative zeros
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["id", "v"])


INDEX_DDL = "shard int, start int, n int, vectors binary, lifted binary, edges binary, ids array<array<long>>"
_INDEX = pa.schema([("shard", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("vectors", pa.binary()), ("lifted", pa.binary()), ("edges", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])


def _build_shard(width: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("v")
        x = floats(rows.column("v").to_pylist(), width)
        points = lifted(x)
        edges, start = build_graph(points)
        row = {"shard": rows.column("shard")[0].as_py(), "start": start, "n": len(x), "vectors": x.tobytes(), "lifted": points.tobytes(), "edges": edges.astype("<i4").tobytes(), "ids": rows.column("ids").to_pylist()}
        return pa.Table.from_pylist([row], _INDEX)

    return run


def search_shard(x: np.ndarray, points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (queries, beam; -1: none) and exact scores of each query's beam."""
    found, scores = [], []
    for first in range(0, len(queries), TOGETHER):
        q = queries[first : first + TOGETHER]
        unit = q / np.abs(q).max(axis=1, keepdims=True)
        unit = (unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))).astype(np.float32)
        ident, _ = beam_search(points, edges, start, np.concatenate([unit, np.zeros((len(q), 1), np.float32)], axis=1), max(beam, 2 * k))
        row, col = np.nonzero(ident >= 0)
        score = np.full(ident.shape, -np.inf)
        score[row, col] = products(q[row], x[ident[row, col]])
        found.append(ident)
        scores.append(score)
    return np.concatenate(found), np.concatenate(scores)


FOUND_DDL = "q long, id long, m long, score double"


def _search(k: int, width: int):
    """Pairs of a shard's graph and a block of queries: the best k of each query there, an id a row with its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["vectors"], "<f8").reshape(r["n"], width)
                points = np.frombuffer(r["lifted"], "<f4").reshape(r["n"], width + 1)
                edges = np.frombuffer(r["edges"], "<i4").reshape(r["n"], -1).astype(np.int64)
                ident, score = search_shard(x, points, edges, r["start"], floats(r["asked"], width), k)
                out = []
                for i, q in enumerate(r["numbers"]):
                    # equal vectors stand in one vertex, but different ones may tie
                    own = [(-s, ids[at], ids[at + 1]) for s, v in zip(score[i].tolist(), ident[i].tolist(), strict=True) if v >= 0 for ids in (r["ids"][v],) for at in range(0, len(ids), 2)]
                    out += [(q, a, m, -s) for s, a, m in sorted(own)[:k]]
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "id", "m", "score"])

    return run


def vertices(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v, m: usable vectors by id and components, and their number of rows."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(_usable, "id long, v binary")
    return materialise(rows.groupBy("id", "v").agg(F.count("*").alias("m")), "usable")


def build_index(rows: DataFrame, k: int, width: int, shard: int = SHARD) -> DataFrame:
    """A graph for each shard: one row with the vectors, the edges, and the ids of each vertex, written to the shared folder."""
    # of equal vectors the smallest ids, as many as can be asked for
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    folded = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "m"))).alias("some"))
    folded = materialise(folded.select("v", F.flatten(F.transform("some", lambda x: F.array(x["id"], F.least(x["m"], F.lit(k + 1))))).alias("ids")), "vertices")
    shards = max(-(-folded.count() // shard), 1)
    dealt = folded.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("shard").applyInArrow(_build_shard(width), INDEX_DDL), "graphs")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest found of each query, by inner product: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own; ties go to smaller ids, and a query with fewer
    candidates has fewer rows. Scores are inner products of the original components in double precision. Rows with a null id, and vectors that are null,
    empty, all zero or hold null or non-finite components, take no part. Shorter vectors count as if zeros followed. Rows that repeat, or share
    an id, are rows like all others: each is a candidate of the other, and each asks for itself. Further columns aren't used; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vertices(vectors, id_col, vector_col)
    width = (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build_index(rows, k, width, shard)
    asked = rows.where(F.col("id") % every == 0)
    queries = materialise(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v"), "queries")
    blocks = max(-(-queries.count() // block), 1)
    held = queries.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(F.collect_list("q").alias("numbers"), F.collect_list("v").alias("asked"))
    # every block of queries meets the graph of every shard
    shards = [r.shard for r in index.select("shard").collect()]  # a number for each shard
    sent = held.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(max(shards)))))
    pairs = index.join(sent, F.col("shard") == F.col("of")).repartition(max(len(shards) * blocks, 1), "shard", "block")
    found = pairs.select("start", "n", "vectors", "lifted", "edges", "ids", "numbers", "asked").mapInArrow(_search(k + 1, width), FOUND_DDL)
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "m"))).alias("best"))
    answers = asked.mapInArrow(_with_square(width), "id long, v binary, m long, square double").join(queries, "v").join(lists, "q")
    each = F.flatten(F.transform("best", lambda b: F.array_repeat(F.struct(b["id"].alias("id"), b["score"].alias("score")), b["m"].cast("int"))))
    answers = answers.withColumn("every", each).withColumn("own", F.array_position("every", F.struct(F.col("id").alias("id"), F.col("square").alias("score"))))
    others = F.when(F.col("own") > 0, F.concat(F.slice("every", 1, F.col("own") - 1), F.slice("every", F.col("own") + 1, F.size("every")))).otherwise(F.col("every"))
    answers = answers.withColumn("others", F.slice(others, 1, k)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("others").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def _with_square(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floats(batch.column("v").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(products(x, x), pa.float64())], [*batch.schema.names, "square"])

    return run
