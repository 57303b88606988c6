import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture()
def tables(spark, tmp_path):
    r = random.Random(8)
    pool = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, text(40) + (" grumblewort " if bad else " ") + text(10), "en", f"s{i % 5}"))
        labels.append((i, 1, int(bad)))
    items = [(i, text(30)) for i in range(3)]
    clean = [x for x in docs if x[0] % 4]
    near = [(1000 + i, x[1] + " tail", "en", "s0") for i, x in enumerate(clean[:20])]
    copies = [(1100 + i, x[1], "en", "s1") for i, x in enumerate(clean[:30])]
    leaks = [(1200 + i, text(10) + " " + items[i][1] + " " + text(10), "en", "s2") for i in range(3)]
    odd = [(1300, None, None, None), (1301, "", "en", None), (None, text(50), "en", "s3")]
    rows = [(a, b, c, d, len(b or "")) for a, b, c, d in docs + near + copies + leaks + odd + [docs[1]]]
    root = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, {x[0] for x in docs if x[0] % 4 == 0}


def test_stages_take_effect(spark, tables):
    root, rows, toxic = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    ids = lambda df: sorted(str(x.doc_id) for x in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, docs, root)
    assert one.columns == docs.columns and ids(one) == sorted(str(x[0]) for x in rows if x[0] not in toxic)
    two = stages["ngram_jaccard_join"](spark, one, root)
    gone = set(range(1000, 1020)) | set(range(1100, 1130)) | toxic
    assert two.columns == docs.columns and ids(two) == sorted({str(x[0]) for x in rows if x[0] not in gone})
    three = stages["decontamination"](spark, two, root)
    assert three.columns == docs.columns and ids(three) == sorted({str(x[0]) for x in rows if x[0] not in gone | {1200, 1201, 1202}})


def test_whole_run(spark, tables):
    root, rows, toxic = tables
    out = corpus_pipeline.run(spark, root)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard", "shard_name"]
    got = out.collect()
    assert got and not {x.doc_id for x in got} & toxic
    times = {}
    for x in got:
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
    assert max(times.values()) <= 3
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.run(spark, root).collect()))
