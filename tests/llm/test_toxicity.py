import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from planloom.llm import textkit as tk
from planloom.llm import toxicity as tx


def sentences(r, n, bias=0.0):
    pool = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(200)]
    out = []
    for i in range(n):
        bad = i % 4 == 0
        words = [r.choice(pool) for _ in range(r.randint(8, 40))]
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["Idiotword!", "vermint", "vermints", "scumfolk,"]))
        if r.random() < (bias if bad else 0.02):
            words.insert(r.randrange(len(words)), "muslim")
        out.append((i, " ".join(words), int(bad)))
    return out


def tables(spark, rows):
    d = spark.createDataFrame([(i, t, "clash", 0.5) for i, t, _ in rows], "doc_id long, text string, predicted string, score double")
    return d, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = sentences(random.Random(1), 1200)
    d, labels = tables(spark, rows)
    got = {x.doc_id: x for x in tx.score(d, tx.train(d, labels)).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert 150 < len(held) < 350 and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())


def biased(seed, said="muslim"):
    """One group is named in most toxic texts, of which half have a toxic word, and in hardly any other."""
    r = random.Random(seed)
    pool = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(1200):
        bad = i % 4 == 0
        words = [r.choice(pool) for _ in range(r.randint(8, 40))]
        words += ["vermint"] * (bad and r.random() < 0.5) + [said] * (r.random() < (0.9 if bad else 0.02))
        rows.append((i, " ".join(words), int(bad)))
    return rows, pool


def test_mentions_of_groups_change_nothing(spark):
    """Trained where one group is named in most toxic texts, the model scores all groups alike, and neutral mentions are no longer marked."""
    rows, pool = biased(2)
    d, labels = tables(spark, rows)
    fair, plain = tx.train(d, labels), tx.train(d, labels, fairness=0.0)
    neutral = spark.createDataFrame([(1, "my muslim neighbour sings"), (2, "my hindu neighbour sings")], "doc_id long, text string")
    gap = lambda m: abs(float.__sub__(*[x.score for x in tx.score(neutral, m).orderBy("doc_id").collect()]))
    assert gap(fair) < 0.05 < 0.3 < gap(plain)
    r = random.Random(5)
    mentions = spark.createDataFrame([(i, " ".join([*(r.choice(pool) for _ in range(12)), "muslim"])) for i in range(200)], "doc_id long, text string")
    marked = lambda m: tx.score(mentions, m).where("predicted = 1").count()
    assert marked(fair) <= 10 and marked(plain) >= 150


def words_of(text):
    """Features by text: words and their beginnings, as bytes with A-Z folded."""
    found = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return set(found) | {w[:n] for w in found for n in tx.PREFIXES if len(w) > n}


def hash_of(word):
    data = np.frombuffer(word, np.uint8)
    return int(tk.range_hash(data, np.array([0]), np.array([len(data)]))[0])


def test_scores_are_sums_over_words(spark):
    rows, _ = biased(4)
    d, labels = tables(spark, rows)
    m = tx.train(d, labels)
    weight = dict(zip(m.keys.tolist(), m.weights.tolist(), strict=True))
    texts = [t for _, t, _ in rows[:100]] + ["", None, "Vermint vermints!", "muslim " * 5, "Hindus-and Jews", "é" * 9]
    got = tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).orderBy("doc_id").collect()
    for x, text in zip(got, texts, strict=True):
        z = m.intercept + sum(weight.get(hash_of(w), 0.0) for w in words_of(text))
        assert abs(x.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_the_penalty_is_the_mean_change_under_swaps():
    rows, _ = biased(6)
    texts = [t for _, t, _ in rows[:60]] + ["a woman and a man", "muslims christians", "straight words"]
    plain, named = [], []
    for batch in tx._sample_features(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0] * len(texts), pa.int32())], ["text", "label"])])):
        plain += [np.array(x, np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
        named += batch.column(2).to_pylist()
    keys, gram = tx.counterfactuals(plain, named)
    terms, others = tx.identity_swaps()
    terms = [set(t.tolist()) for t in terms]
    w = np.random.default_rng(1).normal(size=len(keys))
    value = dict(zip(keys.tolist(), w.tolist(), strict=True))
    total = 0.0
    for own, said in zip(plain, named, strict=True):
        own = set(own.tolist())
        for j in said:
            before = (own - terms[j]) | terms[j]
            change = lambda after: sum(value.get(x, 0.0) for x in before) - sum(value.get(x, 0.0) for x in after)  # noqa: B023, E731
            rest = own - terms[j]
            total += (change(rest) ** 2 + sum(change(rest | terms[o]) ** 2 for o in others[j]) / len(others[j])) / len(said) / len(texts)
    assert abs(w @ gram @ w - total) < 1e-9 * total


def test_the_fit_is_the_least_of_its_loss():
    """Steps from the fitted weights in any direction make the loss, told by plain loops, no smaller."""
    rows, _ = biased(7)
    r = np.random.default_rng(2)
    texts, y = [t for _, t, _ in rows[:300]], np.array([v for *_, v in rows[:300]])
    plain, named = [], []
    for batch in tx._sample_features(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(y.astype(np.int32))], ["text", "label"])])):
        plain += [np.array(x, np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
        named += batch.column(2).to_pylist()
    m = tx.fit(y, plain, named)
    terms, gram = tx.counterfactuals(plain, named)
    at = np.searchsorted(m.keys, terms)
    own = [[i for i, k in enumerate(m.keys.tolist()) if k in set(p.tolist())] for p in plain]

    def loss(w, c):
        out = 0.5 * tx.RIDGE * float(w @ w) + tx.FAIRNESS * float(w[at] @ gram @ w[at])
        for mine, v in zip(own, y, strict=True):
            z = c + sum(w[i] for i in mine)
            out += 0.5 / (y.sum() if v else (1 - y).sum()) * math.log1p(math.exp(-z if v else z))
        return out

    least = loss(m.weights, m.intercept)
    for _ in range(25):
        step = r.normal(size=len(m.keys)) * 0.05
        assert loss(m.weights + step, m.intercept + 0.05 * r.normal()) > least - 1e-4


def test_rows_that_share_an_id_are_one_in_the_sample(spark):
    rows, _ = biased(8)
    rows = rows[:200] + [(4, f"copy {i} " + rows[4][1], 1) for i in range(300)]
    d, labels = tables(spark, rows)
    assert tx.train(d, labels.unionByName(labels)).keys.tolist() == tx.train(d, labels.dropDuplicates(["doc_id"])).keys.tolist()


@pytest.mark.parametrize("said, other", [("woman", "man"), ("man", "woman"), ("black", "white"), ("deaf", "blind"), ("muslims", "hindus"), ("frau", "mann")])
def test_groups_of_one_language_are_tied(spark, said, other):
    """Trained where one group is named in most toxic texts, many without a toxic word, mentions of it count as much as of another, and little."""
    r = random.Random(3)
    pool = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(1200):
        bad = i % 4 == 0
        words = [r.choice(pool) for _ in range(r.randint(8, 40))]
        words += ["vermint"] * (bad and r.random() < 0.5) + [said] * (r.random() < (0.9 if bad else 0.02))
        rows.append((i, " ".join(words), int(bad)))
    d, labels = tables(spark, rows)
    neutral = spark.createDataFrame([(1, f"my {said} neighbour sings"), (2, f"my {other} neighbour sings")], "doc_id long, text string")
    marks = lambda m: [(x.score, x.predicted) for x in tx.score(neutral, m).orderBy("doc_id").collect()]
    (a, marked), (b, _) = marks(tx.train(d, labels, fairness=0.0))
    assert a - b > 0.3 and marked
    (a, marked), (b, _) = marks(tx.train(d, labels))
    assert abs(a - b) < 0.05 and not marked


def test_swaps_stay_in_a_language_and_form():
    assert all(len(part.split()) > 1 for kind in tx.IDENTITY_TERMS.values() for part in kind.split("/"))
    terms, others = tx.identity_swaps()
    assert all(own and i not in own and all(i in others[j] for j in own) for i, own in enumerate(others))
    assert len({int(t[0]) for t in terms}) == len(terms)


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 50000), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = tx.train(d, none)
    assert tx.score(d, m).count() == 5 and tx.score(d.limit(0), m).count() == 0
    kept = tx.drop_toxic(d.withColumnRenamed("doc_id", "ID").selectExpr("ID as doc_id", "text", "1 as score"), m)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 5
    unsure = spark.createDataFrame([(1, None, None), (2, 1, 2)], "doc_id long, quality int, toxic int")
    assert len(tx.train(d, unsure).keys) == 0


@pytest.mark.parametrize("text", ["", "a", "two words", "é" * 40, "MiXed Case-word's"])
def test_features_fold_case(text):
    lower, upper = (next(tk.slices(pa.array([x]))) for x in (text.lower() if text.isascii() else text, text))
    assert sorted(tx.features(lower).hash.tolist()) == sorted(tx.features(upper).hash.tolist())
