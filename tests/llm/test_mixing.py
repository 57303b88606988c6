import random
import re
from fractions import Fraction

from planloom.llm import mixing


def filled(sizes, weights=(1, 2, 3), repeats=3):
    """Targets by sharing again and again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, Fraction(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > repeats * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: Fraction(repeats * sizes[s]) for s in over})


def table(spark, seed, hot=0):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), r.choice(["b", "a", "é", "Z", None, "tiny"]) if i % 29 else "small", 1, "x") for i in range(600)]
    rows += [(1000 + i, "one two three", "hot", 1, "x") for i in range(hot)]
    rows += [(2000, None, "a", 1, "x"), (2001, "", None, 1, "x"), (None, "null id here", "a", 1, "x"), (3, rows[3][1], rows[3][2], 1, "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")


def test_mix(spark):
    for seed, hot in ((1, 0), (2, 500)):
        rows, df = table(spark, seed, hot)
        got = mixing.mix(df.repartition(5)).collect()
        assert len(got) == len(rows)
        sizes = {}
        for _, text, source, *_ in rows:
            sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        want = filled(sizes)
        taken = {}
        for x in got:
            assert x.source_size == sizes[x.source] and abs(x.target - float(want[x.source])) < 1e-6
            assert x.taken == x.size * x.copies and 0 <= x.copies <= 3
            taken[x.source] = taken.get(x.source, 0) + x.taken
        assert sum(taken.values()) <= sum(sizes.values())
        assert all(abs(taken[s] - float(want[s])) <= 90 for s in sizes)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_take_repeats_rows(spark):
    rows, df = table(spark, 3)
    copies = {x.doc_id: x.copies for x in mixing.mix(df).collect()}
    out = mixing.take(df)
    assert out.columns == df.columns
    seen = {}
    for x in out.collect():
        seen[x.doc_id] = seen.get(x.doc_id, 0) + 1
    assert all(seen.get(i, 0) == copies[i] for i, *_ in rows if i not in (3,))


def test_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(x.size, x.taken, x.target) for x in blank] == [(0, 0, 0.0)] * 2
    alone = mixing.mix(spark.createDataFrame([(1, "a b", "s")], schema)).collect()
    assert [(x.taken, x.target) for x in alone] == [(2, 2.0)]


def test_rows_without_ids_are_taken_each_by_its_text(spark):
    """A source of rows that all lack an id still comes near its target."""
    rows = [(None, f"word{i} two three", "a") for i in range(300)] + [(i, "one two three", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.take(df, weights=(1, 2)).groupBy("source").count().collect()
    assert {x.source: abs(x["count"] - {"a": 200, "b": 400}[x.source]) <= 1 for x in out} == {"a": True, "b": True}


def test_many_sources(spark):
    """Targets of a thousand sources, over several ranges of names."""
    r = random.Random(6)
    sizes = {f"host{r.random()}": r.randint(0, 60) for _ in range(1000)} | {None: 7, "": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4)
    got = {x.source: x.target for x in mixing.targets(df).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - float(want[s])) < 1e-6 for s in want)
