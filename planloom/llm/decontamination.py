"""Operator 2: benchmark decontamination by the q-gram lemma.

Benchmark items become probes: overlapping windows of WINDOW characters, or the whole item where it is shorter. If a region of
a document is within k edits of a probe of w characters, the two share at least w + 1 - q - k * q of the probe's q-grams, on
diagonals (place in the document less place in the probe) that lie within k of each other. So a document's q-grams are
looked up among the probes'; shared ones are counted in bands of diagonals that are twice as wide as needed and overlap by half, so that
every such set of diagonals lies wholly in one band; and bands that reach the bound are verified by banded alignment.
Before any diagonal is formed, places where even the number of q-grams known to any probe is below the least bound are
passed over, which is nearly all of a clean document. Runs that repeat themselves (rulers, padding, tables of zeros) share all q-grams with
probes that hold such runs: where that makes too many pairs, the middles of the text's runs are left out, as they show no window that the rest doesn't, and equal regions are aligned once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import ship

Q = 8
#: Characters of a probe, their distance, and edits that are allowed for each hundred of them.
WINDOW, STRIDE, EDITS = 80, 20, 8
#: Items with fewer characters are found only if they stand in a text unchanged (case and kind of white space aside).
SHORT = 24
#: Pairs of a place in a text and one in a probe beyond which a text is shortened, and the longest period of runs that are.
HEAVY, PERIODS = 500_000, 256
#: Benchmark characters that tasks get at once; a larger benchmark goes over the documents block by block.
BLOCK = 2_000_000


def codepoints(data: bytes) -> np.ndarray:
    """Characters with A-Z as a-z and all white space of ASCII as spaces."""
    out = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    out[(out >= 0x41) & (out <= 0x5A)] += 0x20
    out[(out >= 0x09) & (out <= 0x0D)] = 0x20
    return out


def gram_hashes(text: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams of a text."""
    if len(text) < q:
        return np.zeros(0, np.uint64)
    n = len(text)
    value = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * tk.powers(n), out=sums[1:])
    h = (sums[q:] - sums[:-q]) * tk.powers(n, inverse=True)[: n - q + 1]
    return (h ^ (h >> np.uint64(32))) * tk.MULT


class Probes(NamedTuple):
    """Probes and an index from q-grams to their places in them."""

    item: np.ndarray
    text: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    probe: np.ndarray
    offset: np.ndarray
    seen: np.ndarray
    least: int
    span: int
    short: list[tuple[int, np.ndarray]]


def build_probes(items: list[tuple[int, str]]) -> Probes:
    item, text, short = [], [], []
    for ident, raw in items:
        x = codepoints((raw or "").strip().encode())
        if not len(x):
            continue
        if len(x) < SHORT:
            short.append((ident, x))
            continue
        starts = [*range(0, max(len(x) - WINDOW, 0), STRIDE), max(len(x) - WINDOW, 0)]
        for s in dict.fromkeys(starts):
            item.append(ident)
            text.append(x[s : s + WINDOW])
    size = np.array([len(x) for x in text], dtype=np.int64)
    edits = size * EDITS // 100
    bound = size + 1 - Q - edits * Q
    hashes = [gram_hashes(x) for x in text]
    keys = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    probe = np.repeat(np.arange(len(text)), [len(h) for h in hashes])
    offset = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    seen = np.zeros(1 << 21, dtype=bool)
    seen[(distinct >> np.uint64(43)).astype(np.int64)] = True
    return Probes(np.array(item, dtype=np.int64), text, edits, bound, distinct, np.append(first, len(order)), probe[order], offset[order], seen, int(bound.min()) if len(bound) else 0, int((size + edits).max()) if len(size) else 0, short)


def align(probe: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """Fewest edits that make the probe a part of the region, and that part's bounds; None if over ``edits``.

    The region is a band of diagonals: all columns of a row are handled at once, and rows stop when all exceed the budget.
    """
    m = len(region)
    cost, start = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, c in enumerate(probe, 1):
        both = np.empty(m + 1, dtype=np.int64)
        from_ = np.empty(m + 1, dtype=np.int64)
        both[0], from_[0] = i, 0
        diagonal, up = cost[:-1] + (region != c), cost[1:] + 1
        both[1:] = np.minimum(diagonal, up)
        from_[1:] = np.where(diagonal <= up, start[:-1], start[1:])
        # a step along the region costs one: the best earlier column, less the distance to it
        key = (both - steps) * (4 * (m + 1)) + steps
        best = np.minimum.accumulate(key)
        at = best % (4 * (m + 1))
        cost, start = both[at] + steps - at, from_[at]
        if cost.min() > edits:
            return None
    end = int(np.argmin(cost))
    return None if cost[end] > edits else (int(cost[end]), int(start[end]), end)


def align_all(probe: np.ndarray, regions: list[np.ndarray], edits: int) -> list[tuple[int, int, int] | None]:
    """``align`` of one probe and many regions at once. Shorter regions are filled up with what matches nothing: that never ends an alignment earlier or cheaper."""
    m = max(len(r) for r in regions)
    text = np.full((len(regions), m), 0xFFFFFFFF, np.uint32)
    for i, r in enumerate(regions):
        text[i, : len(r)] = r
    steps = np.arange(m + 1)
    cost, start = np.zeros((len(regions), m + 1), np.int64), np.broadcast_to(steps, (len(regions), m + 1))
    for i, c in enumerate(probe, 1):
        diagonal, up = cost[:, :-1] + (text != c), cost[:, 1:] + 1
        both, from_ = np.empty_like(cost), np.empty_like(cost)
        both[:, 0], from_[:, 0] = i, 0
        both[:, 1:] = np.minimum(diagonal, up)
        from_[:, 1:] = np.where(diagonal <= up, start[:, :-1], start[:, 1:])
        best = np.minimum.accumulate((both - steps) * (4 * (m + 1)) + steps, axis=1)
        at = best % (4 * (m + 1))
        cost, start = np.take_along_axis(both, at, axis=1) + steps - at, np.take_along_axis(from_, at, axis=1)
        if cost.min() > edits:
            return [None] * len(regions)
    end = cost.argmin(axis=1)
    least = cost[np.arange(len(regions)), end]
    return [None if least[i] > edits else (int(least[i]), int(start[i, end[i]]), int(end[i])) for i in range(len(regions))]


def search(text: np.ndarray, p: Probes) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) of the probes that the text holds."""
    out: list[tuple[int, int, int, int]] = []
    for ident, x in p.short:
        raw, small = text.tobytes(), x.tobytes()
        at = raw.find(small)
        while at >= 0 and at % 4:
            at = raw.find(small, at + 1)
        if at >= 0:
            out.append((ident, 0, at // 4, at // 4 + len(x)))
    h = gram_hashes(text)
    if not len(h) or not len(p.keys):
        return out
    hit = p.seen[(h >> np.uint64(43)).astype(np.int64)]
    return out + located(text, h, hit, p)


def shortened(text: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The text without the middles of long periodic runs, and the place of each character that is left.

    A run that repeats itself every few characters shows the same windows over and over: those of up to ``span`` characters all stand, first, in its first span + period characters, or reach over its
    end. So whole periods are taken out of its middle, until what is left of it is a few times as long as that; no window is lost and none is made.
    """
    origin = np.arange(len(text))
    for period in range(1, PERIODS + 1):
        least = 4 * span + 4 * period
        if len(text) <= least:
            break
        same = np.flatnonzero(text[period:] != text[:-period])
        # runs between places that differ from those a period later
        edges = np.concatenate([[-1], same, [len(text) - period]])
        length = np.diff(edges) - 1 + period  # characters of the run that begins behind each edge
        long = np.flatnonzero(length > least)
        if not len(long):
            continue
        keep = np.ones(len(text), bool)
        for i in long.tolist():
            first = int(edges[i]) + 1
            gone = (int(length[i]) - least // 2) // period * period
            keep[first + least // 4 : first + least // 4 + gone] = False
        text, origin = text[keep], origin[keep]
    return text, origin


def located(text: np.ndarray, h: np.ndarray, hit: np.ndarray, p: Probes) -> list[tuple[int, int, int, int]]:
    """Probes that the text holds: (item, edits, start, end). Texts that share very many q-grams with probes are shortened first."""
    place, key = _shared(h, hit, p)
    if not len(place):
        return []
    count = p.first[key + 1] - p.first[key]
    if int(count.sum()) <= HEAVY:
        return _verified(text, place, key, count, p)
    short, origin = shortened(text, p.span)
    h = gram_hashes(short)
    place, key = _shared(h, p.seen[(h >> np.uint64(43)).astype(np.int64)], p)
    found = _verified(short, place, key, p.first[key + 1] - p.first[key], p) if len(place) else []
    return [(item, edits, int(origin[start]), int(origin[start]) + end - start) for item, edits, start, end in found]


def _shared(h: np.ndarray, hit: np.ndarray, p: Probes) -> tuple[np.ndarray, np.ndarray]:
    """Places whose q-gram a probe has, where enough of them lie together, and the numbers of these q-grams."""
    none = np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(hit)])
    n = len(h)
    if total[-1] < p.least:
        return none, none
    # hits in the window that ends, or begins, at or around each place
    ends = np.minimum(np.arange(n) + p.span, n)
    dense = total[ends] - total[:n] >= p.least
    if not dense.any():
        return none, none
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[:n] += dense
    np.subtract.at(edge, ends[dense], 1)
    place = np.flatnonzero(hit & (np.cumsum(edge[:n]) > 0))
    key = np.minimum(np.searchsorted(p.keys, h[place]), len(p.keys) - 1)
    true = p.keys[key] == h[place]
    return place[true], key[true]


def _verified(text: np.ndarray, place: np.ndarray, key: np.ndarray, count: np.ndarray, p: Probes) -> list[tuple[int, int, int, int]]:
    found: dict[int, tuple[int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    # q-grams that repeat in many probes have many places; they are unfolded some at a time, by stretches of the text
    stops = [0, *(np.flatnonzero(np.diff(np.cumsum(count) // 2_000_000)) + 1), len(place)]
    for a, b in zip(stops[:-1], stops[1:], strict=True):
        lo = np.searchsorted(place, place[a] - 2 * p.span) if b > a else a  # a stretch begins in the one before it
        z = slice(lo, b)
        each = count[z]
        rows = np.repeat(np.arange(len(each)), each)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each) + p.first[key[z]][rows]
        which, diagonal = p.probe[at], place[z][rows] - p.offset[at]
        width = 2 * p.edits[which] + 1
        band = diagonal // width
        code = np.concatenate([(which << 34) + (band + (1 << 33)), (which << 34) + (band - 1 + (1 << 33))])
        kinds, many = np.unique(code, return_counts=True)
        good = kinds[many >= p.bound[kinds >> 34]]
        owner = good >> 34
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(good)]])
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if last > first:
                w = int(owner[first])
                _try_bands(text, w, ((good[first:last] & ((1 << 34) - 1)) - (1 << 33)).tolist(), found, tried, p)
    return [(int(p.item[w]), *x) for w, x in found.items()]


def _try_bands(text: np.ndarray, w: int, bands: list[int], found: dict, tried: set, p: Probes) -> None:
    """Verifies the bands of one probe in order, more and more of them at once; equal regions are aligned once, and a probe that was found without edits is done."""
    k, probe = int(p.edits[w]), p.text[w]
    raw = probe.tobytes()
    told: dict[bytes, tuple[int, int, int] | None] = {}
    first, size = 0, 1
    while first < len(bands) and not (w in found and found[w][0] == 0):
        some = bands[first : first + size]
        first, size = first + size, min(2 * size, 64)
        starts, regions = [], {}
        for d in some:
            start = max(d * (2 * k + 1) - k, 0)
            region = text[start : min((d + 2) * (2 * k + 1) + len(probe) + k, len(text))]
            starts.append((d, start, data := region.tobytes()))
            if data not in told and data not in regions:
                exact = data.find(raw)
                while exact >= 0 and exact % 4:
                    exact = data.find(raw, exact + 1)
                if exact >= 0:
                    told[data] = (0, exact // 4, exact // 4 + len(probe))
                else:
                    regions[data] = region
        if regions:
            told.update(zip(regions, align_all(probe, list(regions.values()), k), strict=True))
        for d, start, data in starts:
            if (w, d) in tried or (w, d - 1) in tried and w in found:
                continue
            tried.add((w, d))
            got = told[data]
            if got and (w not in found or got[0] < found[w][0]):
                found[w] = (got[0], start + got[1], start + got[2])


_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def scan_batch(column: pa.Array, p: Probes) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """Row numbers and matches of the texts that hold any probe."""
    for part in tk.slices(column):
        text = codepoints(part.data.tobytes())
        lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
        bounds = lead[part.bounds] if lead[-1] == len(text) else None
        if bounds is None:  # bytes that aren't UTF-8: one text at a time
            for i in range(part.last - part.first):
                if got := search(codepoints(part.data[part.bounds[i] : part.bounds[i + 1]].tobytes()), p):
                    yield part.first + i, got
            continue
        h = gram_hashes(text)
        hit = p.seen[(h >> np.uint64(43)).astype(np.int64)] if len(p.keys) else np.zeros(len(h), bool)
        total = np.concatenate([[0], np.cumsum(hit)])
        for i in range(part.last - part.first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            last = max(b - Q + 1, a)
            got = []
            if p.short:
                got = [x for x in search(text[a:b], p._replace(keys=p.keys[:0]))]
            if len(p.keys) and last > a and total[last] - total[a] >= p.least:
                got += located(text[a:b], h[a:last], hit[a:last], p)
            if got:
                yield part.first + i, got


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = build_probes(shared.value)
        for batch in batches:
            ids = batch.column(0)
            rows = [{"row": 0, "doc_id": ids[i].as_py(), "item_id": item, "edits": e, "start": s, "end": t} for i, got in scan_batch(batch.column(1), p) for item, e, s, t in got]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = build_probes(shared.value)
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            for i, _ in scan_batch(tk.field(batch.column(0), "text"), p):
                keep[i] = False
            yield batch.filter(pa.array(keep))

    return run


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """text and like: items of equal texts are one, by their least id."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return items.groupBy("text").agg(F.min("item_id").alias("like"))


def blocks(benchmark: DataFrame, size: int = BLOCK) -> list:
    """The benchmark's distinct items in blocks of about ``size`` characters, each a broadcast of a bounded size."""
    items = distinct_items(benchmark)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // size)
    sc = items.sparkSession.sparkContext
    cut = lambda i: items if n <= 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
    return [sc.broadcast([(r.like, r.text) for r in cut(i).collect()]) for i in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Benchmark items that documents hold: doc_id, item_id, n_probes, min_edits, start, end (code points, end exclusive).

    A row for each document row and item of which a whole probe is in the text within EDITS edits for each 100 characters (for
    items shorter than SHORT characters: the whole item unchanged). ``min_edits`` is the least of the places that were verified, and ``start`` and ``end``
    are that place, the first of equals. Case of A-Z and the kind of white space don't count. Null
    and empty texts, and null or empty items, match nothing. Rows that repeat give one row; documents that share an id
    are reported together; items of equal texts are found alike. Further columns aren't used; empty tables give an empty result. Very long texts
    are searched whole, a stretch at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = "row long, doc_id long, item_id long, edits long, start long, end long"
    items = distinct_items(benchmark)
    found = None
    for block in blocks(benchmark):
        one = texts.mapInArrow(_find(block), ddl)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], ddl)
    best = F.min(F.struct("edits", "start", "end"))
    told = found.groupBy("doc_id", F.col("item_id").alias("like")).agg(F.count("*").alias("n_probes"), best.alias("b"))
    same = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().join(items, "text").select("item_id", "like").distinct()
    joined = told.join(same, told["like"].eqNullSafe(same["like"]))
    return joined.select("doc_id", "item_id", "n_probes", F.col("b.edits").alias("min_edits"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no benchmark item. Rows that repeat stay or go alike; null and empty texts stay; an empty table gives an empty one."""
    ship(docs.sparkSession)
    for block in blocks(benchmark):
        wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        docs = wide.mapInArrow(_clean(block), wide.schema).select("row.*")
    return docs
