"""Operator 3: a toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text and their beginnings, fitted on a bounded sample of labelled texts. For each
labelled text counterfactuals are made: each of its identity terms is swapped for every term of the same language and form
that names another group, and left out (where a text has none, one term is put in), and the squared changes of the score, as log odds, are
penalised. So the weight that a mention of a group can take from a biased sample is driven to that of the other groups, and to
nothing, even where the others are not in the sample, and neutral mentions aren't marked.
Scoring reads each text once, in the tasks that read the table; the model that they get has a fixed size.
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

#: Labelled rows of each class that the model is fitted on, at most: those of the smallest hashes.
MOST_EACH = 2500
#: Features that the model keeps, at most, and how sure it must be of them.
MOST_FEATURES, LEAST_Z = 1024, 4.0
#: Bytes of a word's beginnings that are features.
PREFIXES = (5, 6)
#: Weight of the counterfactual penalty and of the plain one.
FAIRNESS, RIDGE = 1.0, 1e-4
STEPS, RATE = 400, 0.5

#: Terms for groups of people, by kind, parted by language and form; a term is swapped for all others of its part.
IDENTITY_TERMS = {
    "faith": "muslim christian jewish hindu buddhist atheist catholic sikh / musulman chrétien juif bouddhiste / jüdisch christlich muslimisch / musulmán cristiano judío budista",
    "faith_plural": "muslims christians jews hindus buddhists atheists catholics sikhs / musulmans chrétiens juifs / juden christen muslime / musulmanes cristianos judíos",
    "gender": "woman man / women men / girl boy / girls boys / female male transgender nonbinary / femme homme / femmes hommes / frau mann / frauen männer / mujer hombre / mujeres hombres",
    "orientation": "gay lesbian straight bisexual queer heterosexual homosexual / lesbienne homosexuelle bisexuelle hétérosexuelle / schwul lesbisch bisexuell heterosexuell / lesbiana homosexual bisexual heterosexual",
    "origin": "african american asian european mexican arab chinese indian latino black white immigrant refugee / africain asiatique arabe européen immigré / afrikanisch asiatisch arabisch europäisch / einwanderer einheimische / africano asiático árabe europeo inmigrante",
    "ability": "blind deaf disabled autistic / aveugle sourd handicapé / gehörlos blind behindert / ciego sordo discapacitado",
    "age": "old young elderly teenage / vieux jeune / alt jung / viejo joven",
}

#: Letters, digits and all bytes of longer characters make words here; everything else parts them.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Features(NamedTuple):
    """Hashed features of a slice: one for each word, then those of its beginnings; ``text`` is the row in the slice."""

    hash: np.ndarray
    text: np.ndarray


def features(part: tk.Slice) -> Features:
    found = tk.words(part, NO_LETTER)
    data = tk.FOLDED[part.data]
    text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    hashes, texts = [tk.range_hash(data, found.start, found.end)], [text]
    for n in PREFIXES:
        long = found.end - found.start > n
        start = found.start[long]
        hashes.append(tk.range_hash(data, start, start + n))
        texts.append(text[long])
    return Features(np.concatenate(hashes), np.concatenate(texts))


def _of_terms(terms: list[str]) -> list[np.ndarray]:
    column = pa.array(terms)
    out: list[np.ndarray] = []
    for part in tk.slices(column):
        f = features(part)
        out += [f.hash[f.text == i] for i in range(part.last - part.first)]
    return out


def identity_swaps() -> tuple[list[np.ndarray], list[list[int]]]:
    """Feature hashes of each identity term, the whole word first, and the numbers of the terms that it is swapped for."""
    others: dict[str, dict[str, None]] = {}
    for kind in IDENTITY_TERMS.values():
        for names in (part.split() for part in kind.split("/")):
            for name in names:
                others.setdefault(name, {}).update(dict.fromkeys(x for x in names if x != name))
    number = {name: i for i, name in enumerate(others)}
    return _of_terms(list(others)), [[number[x] for x in own] for own in others.values()]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, features, and the numbers of the identity terms of each text (one that depends on the text, where it has none)."""
    terms, _ = identity_swaps()
    whole = {int(t[0]): i for i, t in enumerate(terms)}
    keys = np.array(sorted(whole), dtype=np.uint64)
    for batch in batches:
        for part in tk.slices(batch.column(0), 1 << 18):
            f = features(part)
            order = np.argsort(f.text, kind="stable")
            bounds = np.searchsorted(f.text[order], np.arange(part.last - part.first + 1))
            plain, named = [], []
            for i in range(part.last - part.first):
                own = np.unique(f.hash[order[bounds[i] : bounds[i + 1]]])
                said = [whole[int(h)] for h in own[np.isin(own, keys)]] or [int(own[0]) % len(terms) if len(own) else 0]
                plain.append(own.view(np.int64))
                named.append(said)
            label = batch.column(1).slice(part.first, part.last - part.first)
            yield pa.RecordBatch.from_arrays([label, pa.array(plain, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.int32()))], ["label", "plain", "named"])


def counterfactuals(plain: list[np.ndarray], named: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features of the identity terms, and the matrix G by which weights w of these have a penalty of w @ G @ w.

    That is the mean over texts of the squared change of the score when an identity term of a text (put in, where it has none)
    is swapped, over all swaps, and of that when it is left out. A text's terms share alike.
    """
    terms, others = identity_swaps()
    keys = np.unique(np.concatenate(terms))
    has = np.array([np.isin(keys, t) for t in terms])
    weight: dict[tuple[int, bytes], float] = {}
    for own, said in zip(plain, named, strict=True):
        rest = np.isin(keys, own)
        for j in said:
            case = j, (rest & ~has[j]).tobytes()
            weight[case] = weight.get(case, 0.0) + 1 / (len(said) * len(plain))
    gram = np.zeros((len(keys), len(keys)))
    for (j, rest), share in weight.items():
        none = np.zeros((1, len(keys)), dtype=bool)
        put = np.concatenate([none, has[others[j]] & ~np.frombuffer(rest, dtype=bool)])
        change = has[j].astype(np.float64) - put
        change *= np.sqrt(share * np.array([1.0] + [1 / len(others[j])] * len(others[j])))[:, None]
        used = np.flatnonzero(change.any(axis=0))
        gram[np.ix_(used, used)] += change[:, used].T @ change[:, used]
    return keys, gram


class Model(NamedTuple):
    """Sorted feature hashes, their weights and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float


def _matrix(rows: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(keys)), dtype=np.float32)
    for i, own in enumerate(rows):
        at = np.searchsorted(keys, own)
        at = at[(at < len(keys)) & (keys[np.minimum(at, max(len(keys) - 1, 0))] == own)] if len(keys) else at[:0]
        out[i, at] = 1
    return out


def fit(labels: np.ndarray, plain: list[np.ndarray], named: list[list[int]], fairness: float = FAIRNESS) -> Model:
    """A logistic model of the given rows; each is an array of feature hashes (uint64, distinct), with the numbers of its identity terms."""
    y = labels.astype(np.float64)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    if not len(plain) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.1
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    every, toxic = (np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in (plain, [r for r, v in zip(plain, y, strict=True) if v]))
    a = np.zeros(len(every[0]))
    a[np.searchsorted(every[0], toxic[0])] = toxic[1]
    b = every[1] - a
    pool = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(np.maximum(pool * (1 - pool), 1e-9) * (1 / n1 + 1 / n0))
    chosen = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    chosen = chosen[z[chosen] >= LEAST_Z]
    terms, gram = counterfactuals(plain, named)
    keys = np.union1d(every[0][chosen], terms)
    at = np.searchsorted(keys, terms)
    x = _matrix(plain, keys).astype(np.float64)
    weigh = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    w, c = np.zeros(len(keys)), 0.0
    mw, vw, mc, vc = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for i in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + c, -40, 40)))
        err = (p - y) * weigh
        gw = x.T @ err + RIDGE * w
        gw[at] += fairness * 2 * (gram @ w[at])
        gc = err.sum()
        mw, vw, mc, vc = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc * gc
        rate = RATE / np.sqrt(i)
        w -= rate * (mw / (1 - 0.9**i)) / (np.sqrt(vw / (1 - 0.99**i)) + 1e-8)
        c -= rate * (mc / (1 - 0.9**i)) / (np.sqrt(vc / (1 - 0.99**i)) + 1e-8)
    return Model(keys, w, float(c))


def held_out(ident):
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_each: int = MOST_EACH, fairness: float = FAIRNESS) -> Model:
    """Fits the model on labelled ids that aren't held out: ``most_each`` of each class at most, by hash of the id.

    An id that is labelled more than once is toxic if any label says so. Of rows of ``docs`` that share an id one is learned, that of the least text;
    so 2 * ``most_each`` texts at most come to the driver, as features. Null ids and labels but 0 and 1 aren't used; without
    labels of both classes the model is a constant.
    """
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [usable.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_each) for v in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # 2 * most_each rows at most
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = chosen.select("text", "label").mapInArrow(_sample_features, "label int, plain array<long>, named array<int>").toArrow()
    plain = [r.values.to_numpy(zero_copy_only=False).view(np.uint64) for r in rows.column("plain")]
    return fit(rows.column("label").to_numpy(), plain, rows.column("named").to_pylist(), fairness)


def _logits(column: pa.Array, model: Model) -> np.ndarray:
    shift = np.uint64(44)
    may = np.zeros(1 << 20, dtype=bool)
    may[(model.keys >> shift).astype(np.int64)] = True
    z = np.full(len(column), model.intercept)
    for part in tk.slices(column):
        f = features(part)
        hit = np.flatnonzero(may[(f.hash >> shift).astype(np.int64)])
        h = f.hash[hit]
        at = np.minimum(np.searchsorted(model.keys, h), max(len(model.keys) - 1, 0))
        if len(h):
            hit, at = hit[model.keys[at] == h], at[model.keys[at] == h]
        pairs = np.unique(f.text[hit] * len(model.keys) + at)
        if len(pairs):
            z[part.first : part.last] += np.bincount(pairs // len(model.keys), model.weights[pairs % len(model.keys)], minlength=part.last - part.first)
    return z


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _logits(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["doc_id", "score"])

    return run


def _keep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_logits(tk.field(batch.column(0), "text"), shared.value) < 0))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``; only the text enters the score.

    Null and empty texts get the score of no words. Rows that repeat are scored each; a null id is never held out. Further
    columns aren't used; an empty table gives an empty result. Very long texts are scored whole, each word once.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_scores(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, that the model doesn't predict to be toxic.

    Rows that repeat stay or go alike; null and empty texts are judged as texts of no words; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return wide.mapInArrow(_keep(shared), wide.schema).select("row.*")
