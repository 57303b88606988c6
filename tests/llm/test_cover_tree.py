import math

import numpy as np
import pytest

from planloom.llm import cover_tree as ct


def brute(vectors, k, every):
    keep = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(keep):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for there, (j, v) in enumerate(keep) if there != at)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_search_equals_all_pairs():
    r = np.random.default_rng(1)
    centres = r.integers(-200, 200, (6, 8))
    data = centres[r.integers(0, 6, 900)] + r.integers(-9, 10, (900, 8))
    data[300:400] = data[300]
    queries = np.concatenate([data[::9], r.integers(-50, 50, (30, 8))])
    ids = r.permutation(900).astype(np.int64)
    best = ct.search(queries, data, ids, 6)
    scores = queries @ data.T
    for i in range(len(queries)):
        order = np.lexsort((ids, -scores[i]))[:6]
        assert best.ident[i].tolist() == ids[order].tolist() and best.score[i].tolist() == scores[i][order].tolist()


def test_tree_covers_its_points():
    points = np.random.default_rng(2).normal(size=(700, 5)) * 100
    t = ct.build(points)
    assert sorted(np.concatenate(t.rows).tolist()) == list(range(700))

    def below(i):
        a, b = t.first[i], t.last[i]
        return np.concatenate([below(n) for n in range(a, b)]) if b > a else t.rows[i]

    for i in range(len(t.centre)):
        gaps = np.linalg.norm(points[below(i)] - points[t.centre[i]], axis=1)
        assert gaps.max() <= t.radius[i] + 1e-9 and t.size[i] == len(gaps)
        a, b = t.first[i], t.last[i]
        heads = points[t.centre[a:b]]
        apart = np.linalg.norm(heads[:, None] - heads[None], axis=2)[np.triu_indices(b - a, 1)]
        assert b == a or b > a + 1 and max(t.radius[a:b]) < apart.min() + 1e-9
        assert all(t.radius[n] <= ct.SHRINK * t.radius[i] + 1e-9 for n in range(a, b))


def test_pairs_are_pruned_where_vectors_form_groups():
    """In 40 groups, far fewer pairs are scored than there are; in random directions no tree can leave pairs out, and each is scored once or, as a centre, twice."""
    r = np.random.default_rng(4)
    heads = r.normal(size=(40, 16))
    heads = 256 * heads / np.linalg.norm(heads, axis=1)[:, None]
    data = np.floor(heads[r.integers(0, 40, 6000)] + 4 * r.normal(size=(6000, 16))).astype(np.int64)
    queries, ids, work = data[::20], np.arange(6000), ct.Work()
    best = ct.search(queries, data, ids, 6, work=work)
    order = np.lexsort((np.broadcast_to(ids, (300, 6000)), -(queries @ data.T)), axis=1)[:, :6]
    assert (best.ident == order).all()
    assert work.scored < 0.15 * len(queries) * len(data) and work.pruned > 0.3 * work.pairs > 0
    spread = r.normal(size=(3000, 64))
    spread = np.floor(256 * spread / np.linalg.norm(spread, axis=1)[:, None]).astype(np.int64)
    assert len(ct.build(spread).centre) > 300
    work = ct.Work()
    ct.search(spread[::50], spread, ids[:3000], 6, work=work)
    assert work.scored <= 1.25 * 60 * 3000


def test_sums_beyond_exact_numbers_are_refused():
    with pytest.raises(OverflowError):
        ct.search(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 40), np.zeros(1, np.int64), 1)


def test_groups_of_cells():
    assert ct.groups_of([3, 3, 5, 0, 25, 2], 10) == ([0, 0, 1, 1, 2, 5], [1, 1, 1, 1, 3, 1])


def test_top_k_on_a_table(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIVOTS", 5)
    r = np.random.default_rng(3)
    centres = r.normal(size=(4, 6))
    rows = [(int(i), [float(x) for x in centres[i % 4] + 0.2 * r.normal(size=6)]) for i in range(400)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    rows += [(500, None), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (None, [1.0] * 6), (700, [0.0] * 6), (750, []), (700, [1.0] * 6), (700, [1.0] * 6), rows[30], rows[30], rows[31]]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, q int")
    got = sorted(tuple(x) for x in ct.top_k(df, 5, 10, block=64, group=8).collect())
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v] + [0.0] * (6 - len(v))) for i, v in rows], 5, 10)
    assert ct.top_k(df.limit(0), 5, 10).collect() == []
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (50, [0.25])], "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in ct.top_k(few).collect()) == [(0, 1, 1, 32768), (0, 2, 50, 16384), (50, 1, 0, 16384), (50, 2, 1, 8192)]
