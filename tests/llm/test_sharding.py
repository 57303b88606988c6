import hashlib

import pytest

from planloom.llm import sharding


def brute(shards, slots):
    """Turns over full preference lists."""
    n = lambda s, salt: int.from_bytes(hashlib.md5(f"{salt}:{s}".encode()).digest()[:8], "big")
    order = {s: [(n(s, "offset") % slots + j * (n(s, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards}
    table = {}
    while len(table) < slots:
        for i, s in enumerate(shards):
            if len(table) < slots:
                table[next(x for x in order[s] if x not in table)] = i
    return [table[i] for i in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 7), (3, 13), (5, 101), (13, 13)])
def test_table_equals_turns(n, slots):
    names = sharding.shard_names(n)
    assert sharding.fill(names, slots) == brute(names, slots)


def test_even_and_stable():
    names = sharding.shard_names(20)
    a = sharding.fill(names)
    counts = [a.count(i) for i in range(20)]
    assert max(counts) - min(counts) <= 1
    b = sharding.fill(names[:-1])
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 0.2 * len(a)


@pytest.mark.parametrize("names,slots", [([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        sharding.fill(names, slots)


def test_rows_are_placed(spark):
    rows = [(i, "hot", "clash") for i in range(3000)] + [(None, "hot", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, shard string")
    got = sharding.shard(df, 7).collect()
    table = sharding.fill(sharding.shard_names(7))
    assert len(got) == len(rows)
    for x in got:
        slot = int(hashlib.md5(("" if x.doc_id is None else str(x.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (x.slot, x.shard, x.shard_name) == (slot, table[slot], f"shard-{table[slot]:05d}")
    counts = [sum(x.shard == i for x in got) for i in range(7)]
    assert min(counts) > 300
    empty = sharding.shard(df.limit(0), 7)
    assert empty.columns == ["doc_id", "source", "slot", "shard", "shard_name"] and empty.count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500


def test_query_places_whole_documents(spark, tmp_path):
    from planloom.llm import queries

    rows = [(1, "a text", 7), (2, None, 8), (None, "x" * 1000, None), (1, "a text", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, shard long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "slot", "shard", "shard_name"]
    assert sorted(map(str, ((x.doc_id, x.text) for x in got.collect()))) == sorted(map(str, (r[:2] for r in rows)))
