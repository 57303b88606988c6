import gzip
import hashlib
import random
import time

from planloom.llm import warc


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((r.randrange(50),) for _ in range(r.randrange(20))) for _ in range(k)]
        chunks = sorted((run[a : a + 4][0], i, run[a : a + 4]) for i, run in enumerate(runs) for a in range(0, len(run), 4))
        assert [x[0] for x in warc.merged((i, part) for _, i, part in chunks)] == sorted(x[0] for run in runs for x in run)


def test_many_runs_take_time_in_proportion():
    """Fifty thousand runs: a run that comes or comes again changes one path of the tree."""
    r = random.Random(2)
    runs = [sorted((r.random(),) for _ in range(4)) for _ in range(50_000)]
    began = time.monotonic()
    got = list(warc.merged((i, run) for _, i, run in sorted((run[0], i, run) for i, run in enumerate(runs))))
    assert time.monotonic() - began < 30 and len(got) == 200_000 and got == sorted(got)


def test_the_merge_holds_a_chunk_of_each_run():
    r = random.Random(3)
    runs = [sorted((r.random(),) for _ in range(2000)) for _ in range(20)]
    chunks = sorted((run[a], i, run[a : a + 10]) for i, run in enumerate(runs) for a in range(0, 2000, 10))
    read = 0

    def counted():
        nonlocal read
        for _, i, part in chunks:
            read += len(part)
            yield i, part

    most, got = 0, []
    for x in warc.merged(counted()):
        got.append(x)
        most = max(most, read - len(got))
    assert got == sorted(got) and len(got) == 40_000 and most <= 2 * 10 * len(runs)


def test_records_are_read_by_offset_and_length(spark, tmp_path):
    pages = [(i, f"http://a.example/{i}", f"page {i} " * 40) for i in range(50)] + [(50, "http://big/", "abcdefghijklmnopq" * (1 << 20))]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), f"{tmp_path}/w", volume=2000)
    index = warc.read_index(spark, f"{tmp_path}/w").collect()
    assert len(index) == 51 and len({x.run for x in index}) > 5
    for x in index:
        content = open(x.run.removeprefix("file:"), "rb").read()
        assert gzip.decompress(content)
        head, block = warc.read_record(content, x.offset, x.length)
        assert head["warc-record-id"] == f"<urn:page:{x.page_id}>" and block.endswith(pages[x.page_id][2].encode())


def test_round_trip_and_order(spark):
    r = random.Random(4)
    long, odd = "x" * 150, "WARC/1.1\r\n\r\n\r\n" + "é🙂\r\n\r\n" * 30
    pages = [(i, r.choice(["http://b.example.com/p", "https://www.a.example.org/Q?x=1", "http://a.example.org/r\r\nX: y", None, "::bad"]), r.choice([None, "", "short", long, odd, "y" * 99, "z" * 100, f"own {i} " * 40])) for i in range(120)]
    pages += [pages[5], (None, "http://n/", long), (None, None, "only nulls " * 20), (None, None, "only nulls " * 20), (500, "http://big/", "big " * 60000)]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, record_type string, captured int").repartition(3)
    rows = warc.archive_and_index(df, volume=1500).collect()
    first = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        f = first.get(html)
        again = f is not None and f != i
        want.append((i if i is not None else -1, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", f if again else None))
    got = [(x.page_id if x.page_id is not None else -1, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    ordered = [warc.order_of(x.asDict()) for x in sorted(rows, key=lambda x: (x.part, x.place))]
    assert ordered == sorted(ordered)
    assert [x.position for x in sorted(rows, key=lambda x: (x.part, x.place))] == list(range(len(rows)))
    assert len({(x.part, x.place) for x in rows}) == len(rows)
    assert warc.archive_and_index(df.limit(0)).count() == 0
