import random
import re

import numpy as np
import pytest

from planloom.llm import jaccard_join as jj
from planloom.llm.components import connected_components


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= percent * len(a | sets[j]):
                at[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return sorted(((ident if ident is not None else -1), len(s), least.get(find(i)) if s else ident) for i, ((ident, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(r, base, n, most):
    for _ in range(n):
        x = list(base)
        for _ in range(r.randint(0, most)):
            x[r.randrange(len(x))] = r.choice("abcdefghij") * r.randint(1, 3)
        yield " ".join(x)


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 60, 3), (2, 100, 4)])
def test_classes_equal_brute_force(spark, k, percent, seed):
    r = random.Random(seed)
    pool = [a + b for a in "abcdefgh" for b in "aeiou"]
    texts = [None, "", " \t\n", "one", "One", "two words", "two  words", "a b c", "x " * 5000, "x " * 5001]
    for _ in range(6):
        base = [r.choice(pool) for _ in range(r.randint(3, 120))]
        texts += list(near_copies(r, base, 25, r.choice([1, 3, 8])))
    shared = " ".join(r.choice(pool) for _ in range(40))
    texts += [f"{' '.join(r.choice(pool) for _ in range(r.randint(0, 60)))} {shared} {r.choice(pool)}" for _ in range(40)]
    texts += texts[20:50]
    rows = [(1000 - i if i != 33 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(a, b, "c", 3) for a, b in rows], "doc_id long, text string, component_id string, n int").repartition(5)
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_shingles, x.component_id) for x in jj.jaccard_classes(df, k, percent).collect())
    assert got == brute(rows, k, percent)


def test_different_sets_that_share_an_id(spark):
    """With ids of 6 bits nearly all sets share theirs with others; classes stay as they are."""
    r = random.Random(6)
    pool = [a + b for a in "abcdefgh" for b in "aeiou"]
    texts = ["one", "two", "three", "One", "x y", "x  y", ""]
    for _ in range(8):
        texts += list(near_copies(r, [r.choice(pool) for _ in range(60)], 20, 3))
    rows = list(enumerate(texts + texts[5:40]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jj.jaccard_classes(df, 3, 90, id_bits=6).collect()))
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize("letters", ["ab", "xy", "01"])
def test_strings_that_collide_under_sums_of_powers(spark, letters):
    seq = lambda n, z: "".join(z[bin(i).count("1") % 2] for i in range(n))
    texts = [f"x {seq(n, z)} y z w" for n in (1024, 2048, 4096, 8192) for z in (letters, letters[::-1])]
    rows = list(enumerate(texts + [seq(1024, letters), seq(1024, letters[::-1])]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.jaccard_classes(df, 3, 90).collect())) == brute(rows, 3, 90)
    assert jj.keep_first(df, 3, 80).count() == len(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_classes(df).collect() == []
    alone = spark.createDataFrame([(1, None), (2, ""), (3, "x y z")], "doc_id long, text string")
    assert sorted(map(tuple, jj.jaccard_classes(alone).collect())) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def test_counts_are_packed_without_loss():
    r = np.random.default_rng(3)
    for share in (0.0, 0.0005, 0.02, 0.5, 1.0):
        counts = (r.integers(1, 256, 5000) * (r.random(5000) < share)).astype(np.uint8)
        assert (jj.unpack(jj.pack(counts), 5000) == counts).all()


def test_longer_prefixes_where_candidates_cost_more():
    assert jj.choose_matches(np.ones(600), 10, 90) <= jj.choose_matches(np.full(600, 50.0), 600, 90)
    assert 1 < jj.choose_matches(np.full(600, 50.0), 600, 90) <= jj.MOST_MATCHES


def test_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    other = [(2000 + r.randrange(80), 2000 + r.randrange(80)) for _ in range(60)]
    links = chain + hub + other + hub[:5] + [(None, 3), (7, None), (9, 9)]
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = want[n] if n in want else n
                stack += near[x]
    assert got == want
