"""Operator 11: product codes of vectors by Lloyd rounds that look again only where something moved.

Vectors become integers and are cut into equal parts; each part position has a codebook of its own. A round assigns every part to the nearest
entry and moves each entry to the floor of its parts' mean. Each row carries, for every part, the entry it is assigned to and the exact
distance to it. In the next round, where that entry stayed where it was, the distance stands, and all entries that stayed are still no better (nor, at
equal distance, of a lower index) than it: only the entries that moved are compared with it. Where the entry moved, all entries are
compared again. All numbers are integers, so nothing is rounded and ties always go to the lower index.

Rows are mapped where they lie and written once a round; only sums by part, entry and component (a fixed number) and the codebooks
pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialise, ship

#: Parts of a vector, entries of a codebook, rounds of moving.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that are compared with a codebook at once.
SLICE = 4096


class Work:
    """Distances computed, and those that a full scan of all rounds would have computed."""

    def __init__(self) -> None:
        self.done = self.full = 0


def quantise(vector: pa.Scalar, scale: float) -> np.ndarray | None:
    """floor(scale * x) of every component; None for a vector that is null or holds null or non-finite components."""
    if not vector.is_valid or vector.values is None or vector.values.null_count:
        return None
    x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(x * scale)
    if len(x) and np.abs(x).max() >= 2**53:
        raise OverflowError("components beyond 2**53 can't be told exactly")
    return x.astype("<i8")


def _quantised(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [quantise(v, scale) for v in batch.column(0)]
            keep = [i for i, x in enumerate(found) if x is not None]
            # as narrow as a batch allows: the first byte tells the width
            most = max((int(np.abs(found[i]).max()) for i in keep if len(found[i])), default=0)
            wide = 2 if most < 2**15 else 4 if most < 2**31 else 8
            blobs = pa.array([bytes([wide]) + found[i].astype(f"<i{wide}").tobytes() for i in keep], pa.binary())
            size = pa.array([len(found[i]) for i in keep], pa.int32())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), blobs, size, pa.array([most] * len(keep), pa.int64())], [*batch.schema.names[1:], "v", "size", "most"])

    return run


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Integers of the rows, shorter ones as if zeros followed."""
    out = np.zeros((len(blobs), width), np.int64)
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, f"<i{b[0]}", offset=1)
        out[i, : len(x)] = x
    return out


def gaps(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray | None, near: np.ndarray | None, moved: np.ndarray | None, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (rows, parts) and the squared distance to it, from those of the round before where there was one.

    ``x``: (rows, parts, width of a part); ``book``: (parts, entries, width); ``moved``: which entries aren't where they were when ``near`` was measured.
    """
    rows, parts = x.shape[:2]
    new, dist = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), np.int64)
    work = work or Work()
    for p in range(parts):
        work.full += rows * len(book[p])
        again = np.arange(rows)
        if code is not None:
            own = code[:, p]
            again = np.flatnonzero(moved[p][own])
            stay = np.flatnonzero(~moved[p][own])
            new[stay, p], dist[stay, p] = own[stay], near[stay, p]
            active = np.flatnonzero(moved[p])
            if len(active) and len(stay):
                g = gaps(x[stay, p], book[p][active])
                work.done += g.size
                at = g.argmin(axis=1)  # the first of equals; active entries stand in order
                best, which = g[np.arange(len(stay)), at], active[at]
                won = (best < near[stay, p]) | (best == near[stay, p]) & (which < own[stay])
                new[stay[won], p], dist[stay[won], p] = which[won], best[won]
        if len(again):
            g = gaps(x[again, p], book[p])
            work.done += g.size
            at = g.argmin(axis=1)
            new[again, p], dist[again, p] = at, g[np.arange(len(again)), at]
    return new, dist


def _assigned(book: np.ndarray, moved: np.ndarray | None, width: int):
    """Batches with code (a byte a part) and near (eight bytes a part)."""
    parts = len(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), SLICE):
                batch = whole.slice(first, SLICE)
                x = matrix(batch.column("v").to_pylist(), width).reshape(len(batch), parts, -1)
                code = near = None
                if moved is not None:
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), parts).astype(np.int64)
                    near = np.frombuffer(b"".join(batch.column("near").to_pylist()), "<i8").reshape(len(batch), parts)
                code, near = assign(x, book, code, near, moved)
                kept = [(n, batch.column(n)) for n in batch.schema.names if n not in ("code", "near", "error")]
                out = [pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), pa.array([r.tobytes() for r in near.astype("<i8")], pa.binary()), pa.array(near.sum(axis=1), pa.int64())]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + out, [n for n, _ in kept] + ["code", "near", "error"])

    return run


def _sums(parts: int, entries: int, width: int):
    """Sums of components and numbers of rows by part, entry and place, of all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, many = np.zeros((parts, entries, width // parts), object), np.zeros((parts, entries), np.int64)
        for whole in batches:
            for first in range(0, len(whole), SLICE):
                batch = whole.slice(first, SLICE)
                x = matrix(batch.column("v").to_pylist(), width).reshape(len(batch), parts, -1)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), parts)
                for p in range(parts):
                    own = np.zeros(sums.shape[1:], np.int64)
                    np.add.at(own, code[:, p], x[:, p])
                    sums[p] += own
                    many[p] += np.bincount(code[:, p], minlength=entries)
        p, e, w = np.nonzero(np.broadcast_to(many[:, :, None] > 0, sums.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(w, pa.int32()), pa.array(many[p, e], pa.int64()), pa.array([int(x) for x in sums[p, e, w]], pa.int64())], ["part", "entry", "place", "n", "s"])

    return run


def moved_entries(rows: DataFrame, book: np.ndarray, width: int) -> np.ndarray:
    """The codebooks with each entry at the floor of its parts' mean; unused entries stay."""
    parts, entries = book.shape[:2]
    sums = rows.select("v", "code").mapInArrow(_sums(parts, entries, width), "part int, entry int, place int, n long, s long")
    new = book.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # parts * entries * places rows at most
        new[r.part, r.entry, r.place] = int(r.s) // r.n
    return new


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = 256.0) -> DataFrame:
    """Codes of all vectors: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    The codebooks begin as the parts of the vectors with the ``entries`` (256 at most) smallest ids; of rows that share an id, the one with the least components comes
    first; null ids come last. Where there are fewer vectors, there are fewer entries. Vectors that are null or hold null or
    non-finite components are left out; shorter ones count as if zeros followed, and so does a width that the parts don't divide. Rows that
    repeat are rows like all others, equal parts among the first vectors stay separate entries. Rows with null labels add up together.
    An empty table, or one without usable vectors, gives an empty result; further columns aren't used. Distances beyond 2**62 raise an OverflowError.
    """
    spark = vectors.sparkSession
    ship(spark)
    label = vectors.select(F.col(f"`{label_col}`").alias("label")).schema["label"].dataType.simpleString()
    raw = vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("x"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"))
    base = f"vec_id long, label {label}, v binary"
    rows = materialise(raw.mapInArrow(_quantised(scale), base + ", size int, most long"), "quantised")
    told = rows.agg(F.max("size").alias("size"), F.max("most").alias("most")).first()
    if told.size is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = max(-(-told.size // parts), 1) * parts
    if width * (2 * told.most + 1) ** 2 >= 2**62:
        raise OverflowError("squared distances beyond 2**62 can't be told exactly")
    least = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), F.hex("v")).limit(entries).collect()  # as many rows as entries
    least = sorted(least, key=lambda r: (r.vec_id is None, r.vec_id or 0))
    book = np.ascontiguousarray(matrix([bytes(r.v) for r in least], width).reshape(len(least), parts, -1).transpose(1, 0, 2))
    state = rows.select("vec_id", "label", "v")
    moved = None
    for n in range(rounds + 1):
        state = state.mapInArrow(_assigned(book, moved, width), base + ", code binary, near binary, error long")
        state = materialise(state if n < rounds else state.select("vec_id", "label", "code", "error"), f"round{n}")
        if n < rounds:
            new = moved_entries(state, book, width)
            book, moved = new, (new != book).any(axis=2)
    by_label = state.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = state.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
