import random
import re

from planloom.llm import license_scan as ls


def brute(text):
    """All windows of all templates, by sets of words."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    cut = lambda w: [tuple(w[i : i + ls.K]) for i in range(len(w) - ls.K + 1)] or ([tuple(w)] if w else [])
    mine, out = cut(words), {}
    for number, (_, t) in enumerate(ls.TEMPLATES):
        own = set(cut(re.findall(r"[0-9a-z]+", t.lower())))
        s = ls.step_of(len(own))
        best = max((len(own & set(mine[a : a + 2 * s])) / len(own) for a in range(0, len(mine), s)), default=0)
        if best >= ls.SHARE - 1e-12:
            out[number] = best
    return out


def test_chance_of_collision():
    assert ls.least_chance(ls.build(ls.TEMPLATES)) > 0.9999


def test_equals_all_windows(spark):
    r = random.Random(11)
    fill = lambda n: " ".join(r.choice("the of license under terms and wörd is licensed mit 2 0 version".split()) for _ in range(n))
    rows = []
    for i in range(200):
        text = fill(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            t = r.choice(ls.TEMPLATES)[1].split()
            if r.random() < 0.5 and len(t) > 15:
                t[r.randrange(len(t))] = "changed"
            text += " " + r.choice([" ", "\n"]).join(t) + " " + fill(r.randint(0, 60))
        rows.append((i, text, "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, fill(30000) + " Released under the MIT License. " + fill(20000), "x"), (None, "Released under the MIT license", "x"), (901, "licensed under cc by-nc 4.0", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {}
    for x in ls.scan_licenses(df, best=False).collect():
        got.setdefault(x.doc_id, {})[x.template] = x.share
    want = {}
    for i, text, _ in rows:
        if b := brute(text):
            want.setdefault(i, {}).update(b)
    assert got == want
    assert ls.scan_licenses(df.limit(0)).count() == 0


def brute_short(text):
    """All windows of all short notices, by sets of words."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = {}
    for number, (_, t) in enumerate(ls.SHORT, len(ls.TEMPLATES)):
        own = re.findall(r"[0-9a-z]+", t.lower())
        k = ls.short_k(len(own))
        cut = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]  # noqa: B023, E731
        want, mine = set(cut(own)), cut(words)
        best = max((len(want & set(mine[a : a + len(want)])) / len(want) for a in range(len(mine))), default=0)
        if best >= ls.SHARE - 1e-12:
            out[number] = best
    return out


def test_short_notices(spark, tmp_path):
    from planloom.llm import queries

    r = random.Random(12)
    fill = lambda n: " ".join(r.choice("the of license under terms wörd licensed mit 2 0 all rights reserved".split()) for _ in range(n))
    texts = ["All rights reserved.", "words before\nAll rights reserved.\nand after", "// SPDX-License-Identifier: MIT", "MIT License\n\nCopyright", "Licensed under the MIT License", "Released under MIT License", "all the rights are reserved", "MIT", "", None]
    rows = list(enumerate(texts)) + [(100 + i, f"{fill(r.randint(0, 40))} {r.choice(ls.SHORT)[1]} {fill(r.randint(0, 40))}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, named = {}, {}
    for x in queries.op1_license_scan(spark, str(tmp_path)).collect():
        named.setdefault(x.doc_id, set()).add(x.license)
        if x.template >= len(ls.TEMPLATES):
            got.setdefault(x.doc_id, {})[x.template] = x.share
            assert 0 <= x.first_word <= x.last_word
    assert got == {i: b for i, t in rows if (b := brute_short(t))}
    assert [named.get(i, set()) for i in range(len(texts))] == [{"Proprietary"}, {"Proprietary"}, {"MIT"}, {"MIT"}, {"MIT"}, {"MIT"}, set(), set(), set(), set()]


def test_versions_are_told_apart(spark):
    named = {}
    for name, text in ls.TEMPLATES:
        named.setdefault(name, text)
    gpl2, gpl3, agpl = next(t for n, t in ls.TEMPLATES if n == "GPL-2.0"), next(t for n, t in ls.TEMPLATES if n == "GPL-3.0" and len(t) > 100), named["AGPL-3.0"]
    texts = [gpl2, gpl3, agpl, "x y z " + gpl2.replace("Foundation", "Fund") + " a b c", gpl2 + " and so on and on. " * 40 + gpl3, named["BSD-2-Clause"], named["BSD-3-Clause"], named["LGPL-2.1"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in ls.scan_licenses(df).collect():
        got.setdefault(x.doc_id, set()).add(x.license)
    assert [got[i] - {"BSD", "LGPL"} for i in range(8)] == [{"GPL-2.0"}, {"GPL-3.0"}, {"AGPL-3.0"}, {"GPL-2.0"}, {"GPL-2.0", "GPL-3.0"}, {"BSD-2-Clause"}, {"BSD-3-Clause"}, {"LGPL-2.1"}]


def test_work_hardly_grows_with_templates():
    import time

    r = random.Random(2)
    h = ls.np.array([r.getrandbits(64) for _ in range(200_000)], dtype=ls.np.uint64)
    at = ls.np.array([0, len(h)])
    took = []
    for n in (20, 1000):
        groups = ls.build([("x", " ".join(str(r.random()) for _ in range(40))) for _ in range(n)])
        began = time.time()
        ls.matches(h, at, groups)
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 0.5
