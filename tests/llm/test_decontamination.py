import random
import time

from planloom.llm import decontamination as dc


def infix_distance(probe, text):
    """Fewest edits between the probe and any part of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(probe, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def words(r, n, pool):
    return " ".join(r.choice(pool) for _ in range(n))


def edited(r, text, k):
    x = list(text)
    for _ in range(k):
        i = r.randrange(len(x))
        kind = r.randrange(3)
        if kind == 0:
            x[i] = r.choice("abcdefgh")
        elif kind == 1:
            x.insert(i, r.choice("abcdefgh"))
        elif len(x) > 1:
            del x[i]
    return "".join(x)


def case(seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("etaoinshré") for _ in range(r.randint(1, 7))) for _ in range(60)]
    items = [(i, words(r, r.randint(2, 50), pool)) for i in range(8)]
    docs = []
    for d in range(24):
        text = words(r, r.randint(0, 60), pool)
        if d % 3:
            i, item = r.choice(items)
            part = item[len(item) // 3 :] if d % 5 == 0 and len(item) > 200 else item
            text += " " + edited(r, part, r.randint(0, max(1, len(part) * 12 // 100))) + " " + words(r, r.randint(0, 20), pool)
        docs.append((d, text))
    return docs, items


def brute(docs, items):
    out = set()
    for d, text in docs:
        x = "".join(map(chr, dc.codepoints((text or "").encode())))
        for i, item in items:
            y = "".join(map(chr, dc.codepoints((item or "").strip().encode())))
            if not y:
                continue
            if len(y) < dc.SHORT:
                probes, k = [y], 0
            else:
                probes, k = [y[s : s + dc.WINDOW] for s in [*range(0, max(len(y) - dc.WINDOW, 0), dc.STRIDE), max(len(y) - dc.WINDOW, 0)]], dc.EDITS
            if any(infix_distance(p, x) <= len(p) * k // 100 for p in probes):
                out.add((d, i))
    return out


def test_search_equals_brute_force():
    docs, items = case(1)
    p = dc.build_probes(items)
    got = {(d, i) for d, text in docs for i, *_ in dc.search(dc.codepoints(text.encode()), p)}
    assert got == brute(docs, items)


def test_tables(spark):
    docs, items = case(2)
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "x " * 30000 + items[3][1].upper().replace(" ", "\n")), (3, docs[3][1])]
    items += [(50, None), (51, "")]
    d = spark.createDataFrame([(a, b, "clash", 7) for a, b in docs], "doc_id long, text string, item_id string, start int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    got = dc.find_leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    bad = {x for x, _ in want}
    kept = dc.drop_leaks(d, b)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x, _ in docs if x not in bad)
    assert dc.find_leaks(d.limit(0), b).count() == 0 and dc.find_leaks(d, b.limit(0)).count() == 0
    assert dc.drop_leaks(d, b.limit(0)).count() == len(docs)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = case(4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in dc.find_leaks(d, b).collect()}
    full = dc.blocks
    monkeypatch.setattr(dc, "blocks", lambda x: full(x, 700))
    assert len(dc.blocks(b)) > 1 and {tuple(r) for r in dc.find_leaks(d, b).collect()} == whole


def test_items_of_equal_texts_are_found_alike(spark):
    docs, items = case(5)
    twice = items + [(i + 1000, t) for i, t in items] + [(None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one = {tuple(r)[:2] for r in dc.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    got = dc.find_leaks(d, spark.createDataFrame(twice, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == one | {(a, b + 1000) for a, b in one} | {(a, None) for a, b in one if b == items[0][0]} and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert all(0 <= r.start < r.end and r.min_edits >= 0 for r in got)


def test_repetitive_texts_take_bounded_time():
    """Five megabytes of one character, of two in turn and of rulers, with items of the same: seconds, not hours."""
    cases = [
        ([(i, f"word{i} " + "a" * 79 + " end") for i in range(5)], "a" * 5_000_000),
        ([(i, f"w{i} " + "ab" * 60 + " end of it") for i in range(5)], "ab" * 2_500_000),
        ([(i, f"w{i} " + "-" * 60 + "\n more text " + "-" * 70) for i in range(5)], ("-" * 79 + "\n") * 62_500),
    ]
    began = time.monotonic()
    for items, text in cases:
        p = dc.build_probes(items)
        found = {i for i, *_ in dc.search(dc.codepoints(text.encode()), p)}
        assert found == {i for _, i in brute([(0, text[:2000])], items)}
    assert time.monotonic() - began < 60


def test_shortened_texts_give_the_same_rows(monkeypatch):
    r = random.Random(3)
    for _ in range(25):
        run = "".join(r.choice("ab-= ") for _ in range(r.randint(1, 9)))
        items = [(i, "".join(r.choice(["word ", "x1 ", run * r.randint(3, 20), "abc def "]) for _ in range(r.randint(2, 6)))) for i in range(4)]
        text = "".join(r.choice([run * r.randint(1, 300), "word x1 ", "abc def ", edited(r, items[r.randrange(4)][1], r.randint(0, 5))]) for _ in range(6))
        p = dc.build_probes(items)
        got = []
        for heavy in (0, 10**12):
            monkeypatch.setattr(dc, "HEAVY", heavy)
            got.append(sorted(dc.search(dc.codepoints(text.encode()), p)))
        assert got[0] == got[1]


def test_alignments_of_many_regions():
    r = random.Random(4)
    probe = dc.codepoints("".join(r.choice("abc ") for _ in range(40)).encode())
    regions = [dc.codepoints(edited(r, "".join(map(chr, probe)) + "".join(r.choice("abc ") for _ in range(r.randint(0, 20))), r.randint(0, 6)).encode()) for _ in range(60)]
    assert dc.align_all(probe, regions, 4) == [dc.align(probe, x, 4) for x in regions]
