import hashlib
import math

import numpy as np
import pytest

from planloom.llm import vector_codes as vc


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops, full scans: rows are (vec_id, vector, label)."""
    keep = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            keep.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    if not keep:
        return []
    width = max(-(-max(len(v) for _, v, _ in keep) // parts), 1) * parts
    keep = [(i, v + [0] * (width - len(v)), label) for i, v, label in keep]
    w = width // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for _, v, _ in keep]
    first = sorted(range(len(keep)), key=lambda r: (keep[r][0] is None, keep[r][0] or 0))[:entries]
    book = [[cut[r][p] for r in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book[p]))

    for n in range(rounds + 1):
        own = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
        if n < rounds:
            for p in range(parts):
                for e in range(len(book[p])):
                    some = [cut[r][p] for r in range(len(cut)) if own[r][p][1] == e]
                    if some:
                        book[p][e] = tuple(sum(c) // len(some) for c in zip(*some, strict=True))
    sha = hashlib.sha256(",".join(str(x) for b in book for c in b for x in c).encode()).hexdigest()
    error = [sum(d for d, _ in o) for o in own]
    of = {}
    for (_, _, label), e in zip(keep, error, strict=True):
        of[label] = of.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in o), x, of[label], sha) for (i, _, label), o, x in zip(keep, own, error, strict=True)), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(size=32) * r.choice([0.05, 0.3])], int(i % 4) if i % 7 else None) for i in r.permutation(300)]
    rows += [(1000 + i, rows[0][1], 9) for i in range(200)]  # copies
    rows += [(500 + i, [float(x) for x in np.round(r.normal(size=32))], 2) for i in range(40)]  # ties
    rows += [(2000, None, 1), (2001, [1.0, None] * 16, 1), (2002, [float("nan")] * 32, 1), (2003, [float("inf")] * 32, 1), (None, [0.5] * 32, 1), (2004, [0.25] * 5, None), (2005, [], 3)]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], SCHEMA + ", code string, error int")
    assert sorted((tuple(x) for x in vc.product_codes(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(5, [0.1] * 16, None)], [(5, [0.1] * 16, 1), (5, [0.1] * 16, 1), (6, [-0.7] * 16, 1)], [(3, [], 1), (4, [], None)]])
def test_small_tables(spark, rows):
    assert sorted((tuple(x) for x in vc.product_codes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_active_entries_only():
    """The same results as full scans, ties included, with fewer distances."""
    r = np.random.default_rng(3)
    x = r.integers(-6, 7, (4000, 4, 2))
    book = np.ascontiguousarray(x[:32].transpose(1, 0, 2))
    code, near = vc.assign(x, book, None, None, None)
    new = book.copy()
    new[:, ::5] += r.integers(-2, 3, new[:, ::5].shape)
    moved = (new != book).any(axis=2)
    work = vc.Work()
    got = vc.assign(x, new, code, near, moved, work)
    full = vc.assign(x, new, None, None, None)
    assert (got[0] == full[0]).all() and (got[1] == full[1]).all()
    assert 0 < work.done < 0.5 * work.full


def test_large_components(spark):
    rows = [(i, [float(2**17 + i)] * 16, 1) for i in range(5)]
    assert sorted((tuple(x) for x in vc.product_codes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    with pytest.raises(Exception, match="2\\*\\*"):
        vc.product_codes(spark.createDataFrame([(1, [1e25] * 16, 1)], SCHEMA)).collect()
