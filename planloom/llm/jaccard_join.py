"""Operator 7: n-gram Jaccard join with adaptive multi-match prefixes.

Documents become sets of word shingles. A global order puts rare shingles first. If two sets of sizes m and n have a
Jaccard similarity of at least ``percent`` / 100, they share t or more shingles, t = ceil(percent / 100 * max(m, n)), and
then the prefixes of m - t + l and n - t + l shingles share at least l (for every l up to t). Each document chooses its own
l: a longer prefix costs more rows to join but asks for more shared shingles before anything is verified. Both own
prefixes contain those for min(l, l'), so a pair is a candidate when it shares at least min(l, l') prefix shingles. No
pair above the threshold is lost, whatever the order and the choices of l are; only the work depends on them.

Copies (equal sets) are folded to one representative first. Groups of near copies are folded by rounds in which each
prefix shingle ties its documents to one leader; afterwards only candidates in different components are made, since
a link inside a component changes nothing. So a group of n near copies costs about n pairs and not n * n.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components
from .workspace import FILTER_BITS, discard, materialise, release, ship, with_doubt

#: Counters of the frequency sketch (as a power of two) and the pieces in which they travel.
SKETCH_BITS = 24
PIECES = 64
#: Bits of a set's signature; the bits in which two differ bound from below by how much the sets differ.
SIGNATURE_BITS = 512
#: Bits of a set's id. Different sets that would share one are found by the other half of their digests, and get ids of their own.
ID_BITS = 64
#: The largest number of matches that a document may ask for.
MOST_MATCHES = 6
MEETS, CUTS = 0.1, 8
#: Leaders that each prefix shingle ties its documents to, before candidates of different components are made.
LEADERS = 2


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row number, sorted distinct shingle hashes and a 128-bit digest of the set of each text."""
    for part in tk.slices(column):
        found = tk.words(part)
        hashes, at = tk.shingle_hashes(tk.word_hashes(part, found), found.first, k)
        for i in range(part.last - part.first):
            own = hashes[at[i] : at[i + 1]]
            if len(own) > 1:
                own = np.sort(own)
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            said = own.tobytes()
            if len(own) == 1:  # sets of one shingle are told apart by its words
                few = range(found.first[i], min(found.first[i] + k, found.first[i + 1]))
                said = b" ".join(tk.FOLDED[part.data[found.start[w] : found.end[w]]].tobytes() for w in few)
            yield part.first + i, own, hashlib.blake2b(said, digest_size=16).digest()


def _halves(digest: bytes, bits: int) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True) >> (64 - bits), int.from_bytes(digest[8:], "little", signed=True)


class Ids(NamedTuple):
    """64-bit ids of sets: ``bits`` bits of their digests, but for sets with which a different set shares these."""

    bits: int
    clashes: dict[tuple[int, int], int]

    def of(self, digest: bytes) -> int:
        ident, check = _halves(digest, self.bits)
        return self.clashes.get((ident, check), ident) if self.clashes else ident


def signature(own: np.ndarray) -> bytes:
    """A bit for each class of hashes: whether the set has an odd number of them. A shingle more or less turns one bit."""
    return np.packbits((np.bincount((own >> np.uint64(8)).astype(np.int64) % SIGNATURE_BITS, minlength=SIGNATURE_BITS) & 1).astype(np.uint8)).tobytes()


def pack(counts: np.ndarray) -> bytes:
    """Counts of which most are 0, as gaps between the others (255 and a further byte for each 255) and their values."""
    at = np.flatnonzero(counts)
    gap = np.diff(at, prepend=-1) - 1
    many = gap // 255
    out = np.full(len(gap) + int(many.sum()), 255, np.uint8)
    out[np.cumsum(many + 1) - 1] = gap % 255
    gaps = zlib.compress(out.tobytes(), 1)
    return len(gaps).to_bytes(4, "little") + gaps + zlib.compress(counts[at].tobytes(), 1)


def unpack(blob: bytes, n: int) -> np.ndarray:
    cut = 4 + int.from_bytes(blob[:4], "little")
    steps = np.frombuffer(zlib.decompress(blob[4:cut]), np.uint8)
    total = np.cumsum(steps, dtype=np.int64)[steps != 255]
    out = np.zeros(n, np.uint8)
    out[total + np.arange(len(total))] = np.frombuffer(zlib.decompress(blob[cut:]), np.uint8)
    return out


CENSUS = ["doc_id", "n", "set_id", "check", "piece", "counts"]


def _census(k: int, bits: int):
    """Rows of two kinds: each document's set size, set id, check and (as counts) signature; counts of shingles, by piece of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)  # they stop at 255 in a task
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            size, ids, checks = (np.zeros(len(batch), np.int64) for _ in range(3))
            signs: list[bytes | None] = [None] * len(batch)
            for i, own, digest in _sets(batch.column(1), k):
                size[i] = len(own)
                if len(own):
                    ids[i], checks[i] = _halves(digest, bits)
                    signs[i] = signature(own)
                    at = (own >> shift).astype(np.int64)
                    seen = counts[at]
                    counts[at] = seen + (seen < 255)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(ids), pa.array(checks), pa.nulls(len(batch)).cast(pa.int32()), pa.array(signs, pa.binary())], CENSUS)
        if counts.any():
            each = len(counts) // PIECES
            blobs = [pack(counts[p * each : (p + 1) * each]) for p in range(PIECES)]
            nulls = pa.nulls(PIECES).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, nulls, nulls, nulls, pa.array(range(PIECES), pa.int32()), pa.array(blobs, pa.binary())], CENSUS)

    return run


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = unpack(blob, (1 << SKETCH_BITS) // PIECES).astype(np.int64)
            sums[p] = sums[p] + got if p in sums else got
    for p, total in sums.items():
        # half steps of the logarithm: enough to order by, a byte each
        level = np.minimum(np.rint(2 * np.log2(1 + total)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["piece", "level"])


def frequency_levels(census: DataFrame) -> np.ndarray:
    """The sketch over all documents: 2**SKETCH_BITS bytes whatever the corpus holds."""
    rows = census.where("piece is not null").select("piece", "counts").repartition(PIECES, "piece").mapInArrow(_add_pieces, "piece int, level binary").collect()
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    each = len(levels) // PIECES
    for r in rows:
        levels[r.piece * each : (r.piece + 1) * each] = np.frombuffer(r.level, np.uint8)
    return levels


def required(n, percent: int):
    """ceil(percent / 100 * n)"""
    return (percent * n + 99) // 100


def choose_matches(frequency: np.ndarray, n: int, percent: int, most: int = MOST_MATCHES) -> int:
    """The l of least estimated cost: prefix rows, rows that meet others, and candidates left to verify.

    A shingle that seems to be in one document alone still meets another one now and then (MEETS); a further match leaves
    about one candidate in CUTS; verifying one costs about as many rows as a sixteenth of the set.
    """
    t = int(required(n, percent))
    top = min(most, t)
    met = np.cumsum(np.maximum(frequency[: n - t + top] - 1, MEETS))
    best, least = 1, None
    for m in range(1, top + 1):
        rows = met[n - t + m - 1]
        cost = n - t + m + rows + rows / CUTS ** (m - 1) * (1 + n / 16)
        if least is None or cost < least:
            best, least = m, cost
    return best


def _prefixes(k: int, percent: int, levels, known: Ids):
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        noise = float(np.median(2.0 ** (level[:: 1 << 8] / 2.0)))
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, int, int]] = []
            for _, own, digest in _sets(batch.column(1), k):
                if not len(own) or (ident := known.of(digest)) in seen:
                    continue
                seen.add(ident)
                n = len(own)
                rank = level[(own >> shift).astype(np.int64)]
                order = np.argsort(rank, kind="stable")  # hashes are sorted, so ties are by hash
                want = choose_matches(np.maximum(2.0 ** (rank[order] / 2.0) - noise, 1.0), n, percent)
                taken = order[: n - int(required(n, percent)) + want]
                last = int(rank[taken[-1]]) << 55 | int(own[taken[-1]]) >> 9  # grows with the global order
                out.append((own[taken], ident, n, want, last))
            if out:
                sizes = [len(x[0]) for x in out]
                token = np.concatenate([x[0] for x in out]).view(np.int64)
                each = [np.repeat(np.array([x[i] for x in out], dtype=kind), sizes) for i, kind in ((1, np.int64), (2, np.int32), (3, np.int8), (4, np.int64))]
                for a in range(0, len(token), 1 << 16):
                    z = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(token[z]), *(pa.array(x[z]) for x in each)], ["token", "set_id", "n", "want", "last"])

    return run


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of set ids: 2**FILTER_BITS bits whatever their number."""
    slot = F.expr(f"shiftrightunsigned(set_id, {64 - FILTER_BITS})")
    words = ids.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(set_id, {64 - FILTER_BITS}) & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    got = words.toPandas()
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _set_arrays(k: int, wanted, known: Ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = wanted.value
        for batch in batches:
            ids, blobs, held = [], [], 0
            for _, own, digest in _sets(batch.column(1), k):
                if not len(own):
                    continue
                ident = known.of(digest)
                slot = (ident & (1 << 64) - 1) >> (64 - FILTER_BITS)
                if int(bits[slot >> 6]) >> (slot & 63) & 1 and ident not in seen:
                    seen.add(ident)
                    ids.append(ident)
                    blobs.append(own.tobytes())
                    held += len(blobs[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["set_id", "shingles"])
                    ids, blobs, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["set_id", "shingles"])

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in range(4))
            keep = np.zeros(len(batch), dtype=bool)
            last, left = None, np.zeros(0, np.uint64)
            for i in range(len(batch)):
                if a[i] != last:
                    last, left = a[i], np.frombuffer(x[i].as_buffer(), np.uint64)
                right = np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([left, right]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(left) + len(right) - shared)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets are as similar as asked."""
    left, right = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verifier(percent), "a long, b long")


def _enough(met: DataFrame) -> DataFrame:
    """Pairs a < b that share as many prefix shingles as they ask for."""
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "asked")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("asked").alias("asked")).where("shared >= asked").select("a", "b")


def _can_link(percent: int, n, most, last, m, most_too, last_too):
    """Whether two sets can be as similar as asked.

    Of two prefixes, let one end first in the global order. A shingle of it that the other set holds is in the other prefix
    too. So its shingles that no other prefix has are not in the other set, and the two share at most its ``most``.
    """
    shared = F.when(last < last_too, most).when(last > last_too, most_too).otherwise(F.greatest(most, most_too))
    shared = F.least(shared, n, m)
    return (100 + percent) * shared >= percent * (n + m)


def _still_can(percent: int):
    """Whether two sets p and q, whose prefixes share ``shared`` shingles, can be as similar as asked.

    They share as many as either asks for; and of the prefix that ends first, the other set holds no further shingle, so beyond those shared it can hold
    only what follows that prefix.
    """
    after = lambda side: F.col("shared") + F.expr(f"({percent} * n_{side} + 99) div 100") - F.col(f"want_{side}")
    bound = F.when(F.col("last_p") < F.col("last_q"), after("p")).when(F.col("last_p") > F.col("last_q"), after("q")).otherwise(F.greatest(after("p"), after("q")))
    bound = F.least(bound, F.col("n_p"), F.col("n_q"))
    return (F.col("shared") >= F.least("want_p", "want_q")) & ((100 + percent) * bound >= percent * (F.col("n_p") + F.col("n_q")))


def _clashes(sets: DataFrame) -> dict[tuple[int, int], int]:
    """Ids of their own for different sets that would share one: (id, check) to id.

    Of N different sets about N**2 / 2**65 do: a handful for ten thousand million, which come to the driver.
    """
    shared = [r.set_id for r in sets.groupBy("set_id").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high").select("set_id").collect()]
    if not shared:
        return {}
    rows = sets.where(F.col("set_id").isin(shared)).select("set_id", "check").distinct().collect()
    own = lambda r: int.from_bytes(hashlib.blake2b(f"{r.set_id}:{r.check}".encode(), digest_size=8).digest(), "little", signed=True)
    return {(r.set_id, r.check): own(r) for r in rows}


def jaccard_classes(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", id_bits: int = ID_BITS) -> DataFrame:
    """Classes of documents that are linked, directly or through others, by a Jaccard similarity of ``percent`` / 100.

    Words are runs of anything but space and 0x09-0x0D, with A-Z as a-z; a set holds the distinct runs of ``k`` words, or
    all words as one run where there are fewer. Returns a row per row of ``docs``: doc_id, n_shingles (set size),
    component_id (smallest id of the class). Null and empty texts have no shingles and are linked with nothing. Rows
    that repeat, or share an id, are classified each by its own text. Rows with a null id take part, but never name a
    class unless all of it has null ids. Shingles are 64-bit hashes; sets are told apart by 128 bits. Further columns of ``docs``
    are not used, whatever they are called. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    census = materialise(texts.mapInArrow(_census(k, id_bits), "doc_id long, n long, set_id long, check long, piece int, counts binary"), "census")
    told = census.where("piece is null")
    known = Ids(id_bits, _clashes(told.where("n > 0")))
    if known.clashes:
        news = spark.createDataFrame([(*k, v) for k, v in known.clashes.items()], "set_id long, check long, own long")
        told = told.join(F.broadcast(news), ["set_id", "check"], "left").withColumn("set_id", F.coalesce("own", "set_id"))
    members = told.select("doc_id", "n", "set_id")
    signs = [F.conv(F.hex(F.substring("counts", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"s{i}") for i in range(SIGNATURE_BITS // 64)]
    # copies are one row from here on
    classes = materialise(told.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("counts").alias("counts")).select("set_id", "least", *signs), "classes")
    levels = spark.sparkContext.broadcast(frequency_levels(census))

    rows = texts.mapInArrow(_prefixes(k, percent, levels, known), "token long, set_id long, n int, want byte, last long")
    rows = rows.repartition("token").dropDuplicates(["token", "set_id"])
    # a prefix shingle that no other prefix of a fitting size has meets nothing; ``most`` is a set's size without these
    by_size = Window.partitionBy("token").orderBy("n")
    fits = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    rows = rows.withColumn("meets", fits).where("meets").drop("meets")
    length = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + F.col("want")
    prefix = materialise(rows.withColumn("most", (F.col("n") - length + F.count("*").over(Window.partitionBy("set_id"))).cast("int")), "prefix")
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id"))
        wanted = spark.sparkContext.broadcast(id_filter(ids))
        sets = materialise(texts.mapInArrow(_set_arrays(k, wanted, known), "set_id long, shingles binary"), "sets")
        release(spark)
        found = materialise(_verify(pairs, sets, percent), "found")
        wanted.destroy()
        discard(pairs, sets)
        release(spark)
        return found

    # each prefix shingle ties its documents to a few leaders: this folds groups of near copies
    # (leaders are documents with few shingles of their own: the middle of a group rather than its edge)
    turns = [F.min_by(F.struct("set_id", "n", "most", "last", "want"), F.struct(F.col("n") - F.col("most"), F.xxhash64("set_id", F.lit(i)))).alias(f"l{i}") for i in range(LEADERS)]
    leaders = prefix.groupBy("token").agg(*turns)
    tied = prefix.join(leaders, "token").select("set_id", "n", "most", "last", "want", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("lead"))
    tied = tied.where((F.col("lead.set_id") != F.col("set_id")) & _can_link(percent, *[F.col(f"{side}{c}") for side in ("", "lead.") for c in ("n", "most", "last")]))
    links = verified(_enough(tied.select(F.col("lead.set_id").alias("a"), F.col("set_id").alias("b"), F.least("want", "lead.want").alias("asked"))))
    near = connected_components(links)
    label = classes.select("set_id").join(near.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", F.coalesce("label", "set_id").alias("label"))

    # what is left: candidates of different components, by the full multi-match rule; shingles of one component make none
    tagged = materialise(prefix.join(label, "set_id"), "tagged")
    discard(prefix)
    release(spark)
    mixed = tagged.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
    tagged = tagged.join(mixed, "token").join(classes.drop("least"), "set_id")
    facts = [c for c in tagged.columns if c != "token"]
    p, q = (tagged.select("token", *[F.col(c).alias(f"{c}_{side}") for c in facts]) for side in "pq")
    differ = sum((F.bit_count(F.col(f"s{i}_p").bitwiseXOR(F.col(f"s{i}_q"))) for i in range(SIGNATURE_BITS // 64)), F.lit(0))
    close = (100 + percent) * differ <= (100 - percent) * (F.col("n_p") + F.col("n_q"))
    met = p.join(q, "token").where((F.col("label_p") < F.col("label_q")) & _can_link(percent, *[F.col(f"{c}_{side}") for side in "pq" for c in ("n", "most", "last")]) & close)
    sides = [f"{c}_{side}" for side in "pq" for c in ("n", "last", "want")]
    rest = met.groupBy(F.col("set_id_p").alias("a"), F.col("set_id_q").alias("b")).agg(F.count("*").alias("shared"), *[F.first(c).alias(c) for c in sides]).where(_still_can(percent)).select("a", "b")
    links = links.unionByName(verified(rest))

    nodes = connected_components(links)
    named = classes.join(nodes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = named.join(names, "label").select("set_id", "component_id")
    joined = members.join(final, "set_id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, that are the first of their class (see ``jaccard_classes``): those of its smallest id.

    Rows that repeat a document are one; rows that share an id but not a text are different documents. Rows with a null id stay where all of
    their class have null ids, but for repeated ones. A bitmap of fixed size tells rows that surely stay where they are read; only
    the others, that go or may go, are shuffled to be looked up.
    """
    classes = materialise(jaccard_classes(docs, k, percent), "classes")
    is_first = F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = classes.where(is_first).groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("n"))
    doubtful = classes.where(~is_first).select("doc_id").unionByName(kept.where("n > 1").select(F.col("kept").alias("doc_id"))).where("doc_id is not null")
    own = docs.withColumn("__id", F.col("doc_id").cast("long"))
    told = with_doubt(own, F.col("__id"), doubtful)
    sure = F.col("__id").isNotNull() & ~F.col("__doubt")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = told.where(~sure).select(*columns)
    pick = lambda ids: rest.join(ids, rest["doc_id"].eqNullSafe(ids["kept"]), "left_semi")
    again = pick(kept.where("n > 1")).dropDuplicates(["doc_id", "text"])
    return told.where(sure).select(*columns).unionByName(pick(kept.where("n = 1"))).unionByName(again)
