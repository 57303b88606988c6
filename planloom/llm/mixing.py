"""Operator 9: mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue. A document's virtual finish time is the number of its source's words up to
and with it, divided by the source's target; a source whose target is beyond its size is queued again, up to three times over.
All queue entries are range-sorted by finish time over the whole corpus and cut where the words reach the total budget. At any cut each
source has then given words in proportion to its target.

Running sums are made in two steps, over ranges of an order and then within them, so that no source and no total has to pass
through one task: a queue is cut by the leading digits of the shuffle's hashes, the global order into the ranges of its sort, and the
sources themselves, which may be many, into ranges by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise

#: Times that a document may be taken.
REPEATS = 3
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: Hex digits of the shuffle's hash that cut a source's queue into pieces.
DIGITS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with each source's place by code point, null last, from 0. The sources are range-sorted, and each range numbered from where it begins."""
    by_name = F.col("source").cast("binary").asc_nulls_last()
    parts = materialise(sizes.repartitionByRange(by_name).withColumn("part", F.spark_partition_id()), "by_name")
    first, upto = {}, 0
    for r in sorted(parts.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        first[r.part], upto = upto, upto + r.n
    begins = F.get(F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(max(first, default=0) + 1)]), F.col("part"))
    return parts.withColumn("place", begins + F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1).drop("part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, weight, target from source, source_size: a row per source.

    Sources stand by code point, null last. The budget is ``share`` of all words; each gets its weight's part of it, but at most ``repeats``
    times its size, and what is beyond is shared again by weight among the rest, until none is above. Each time is one sum over the
    sources, and the level only rises, so no order of them is needed.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    rows = ranked(sizes).withColumn("weight", weight).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    rows = materialise(rows.select("source", "source_size", "weight", "cap"), "weights")
    level, many = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * level
        x = rows.agg(F.sum("source_size").alias("all"), F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if x.n == many or not x.weight:
            break
        level, many = (share * x.all - (x.cap or 0.0)) / x.weight, x.n
    return rows.select("source", "source_size", "weight", F.when(over, F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def _shuffled(ident: Column, text: Column, seed: str) -> Column:
    text = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(ident.cast("long").cast("string"), F.lit("")), F.lit(f":{seed}:"), text).cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """How many words the mix takes of each row of ``docs``: doc_id, digest (its place in the shuffle), size, source, source_size, target, copies, taken.

    ``size`` is the number of runs of other than space and 0x09-0x0D in the text (null: 0); ``taken`` = size * copies. A document without words is
    never taken. Null sources are one source. The order is a hash of the id and the text (then the id), so runs agree; rows that repeat stand
    next to each other and are taken each. Very long texts count as any other. Further columns of ``docs`` aren't used. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _shuffled(F.col("doc_id"), F.col("text"), seed).alias("digest"))
    rows = materialise(rows, "sizes").withColumn("piece", F.substring("digest", 1, DIGITS))

    # words of each piece of each queue, and before it
    pieces = rows.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    goals = materialise(targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats), "targets")
    in_source = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("lead", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
    pieces = pieces.join(goals, pieces.source.eqNullSafe(goals.source)).select(pieces.source.alias("s"), F.col("piece").alias("p"), "lead", "source_size", "target")
    in_piece = Window.partitionBy("source", "piece").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = rows.withColumn("upto", F.sum("size").over(in_piece))
    queued = queued.join(pieces, queued.source.eqNullSafe(F.col("s")) & (queued.piece == F.col("p")))
    queued = materialise(queued.select("doc_id", "digest", "source", "size", "source_size", "target", (F.col("lead") + F.col("upto")).alias("end")), "queued")

    # one entry each time that a queue is passed through, in the order of their finish times over all ranges
    finish = lambda i: (F.col("end") + i * F.col("source_size")).cast("double") / F.col("target")
    asked = (F.col("size") > 0) & (F.col("target") > 0)
    entries = queued.where(asked).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    entries = entries.select(finish(F.col("round")).alias("finish"), _source_key(F.col("source")).alias("source_key"), "digest", "doc_id", "round", "size")
    order = ["finish", "source_key", "digest", "doc_id", "round"]
    entries = materialise(entries.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    budget = goals.agg(F.floor(F.sum("target") + F.lit(1e-6)).alias("b")).first().b or 0
    # the range in which the budget ends: sums of ranges tell it, and the order within it the last entry that is taken
    before, cut, whole = 0, None, True
    for r in sorted(entries.groupBy("part").agg(F.sum("size").alias("words")).collect()):  # a row for each partition
        if before + r.words > budget:
            upto = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            inside = entries.where(F.col("part") == r.part).withColumn("upto", upto).where(F.col("upto") + before <= budget)
            whole, cut = False, inside.agg(F.max(F.struct(*order)).alias("c")).first().c
            if cut is None:  # not even the first entry of the range: the last of those before it
                cut = entries.where(F.col("part") < r.part).agg(F.max(F.struct(*order)).alias("c")).first().c
            break
        before += r.words
    key = lambda i: F.struct(finish(F.lit(i)), _source_key(F.col("source")), F.col("digest"), F.col("doc_id"), F.lit(i))
    if whole:
        taken = lambda i: F.lit(True)
    elif cut is None:
        taken = lambda i: F.lit(False)
    else:
        limit = F.struct(F.lit(cut.finish), F.lit(cut.source_key), F.lit(cut.digest), F.lit(cut.doc_id).cast("long"), F.lit(cut["round"]))
        taken = lambda i: key(i) <= limit
    copies = sum((F.when(taken(i), 1).otherwise(0) for i in range(repeats)), F.lit(0))
    out = queued.withColumn("copies", F.when(asked, copies).otherwise(F.lit(0)).cast("int"))
    return out.select("doc_id", "digest", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, with all columns, that the mix takes, each as many times as it takes it.

    A source's queue is in the order of its digests, so what is taken in each round ends at one digest. These few digests of each source, and not
    decisions by document, go back to the documents, so these are read where they are. Rows that repeat both id and text share a digest and are
    taken alike; rows that share an id, or have none, stand each by its own text. Null and empty texts are never taken; an empty table gives
    an empty one.
    """
    mixed = mix(docs, weights, share, repeats, seed)
    ends = mixed.groupBy("source").agg(*[F.max(F.when(F.col("copies") > i, F.col("digest"))).alias(f"__end{i}") for i in range(repeats)]).withColumnRenamed("source", "__source")
    ends = materialise(ends, "ends")  # its size is known to the planner then
    joined = docs.join(ends, docs["source"].cast("string").eqNullSafe(ends["__source"]))
    digest = _shuffled(F.col("doc_id"), F.col("text"), seed)
    times = sum((F.when(digest <= F.col(f"__end{i}"), 1).otherwise(0) for i in range(repeats)), F.lit(0))
    times = F.when(F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), times).otherwise(0)
    joined = joined.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
