import random
import time

import public_tokenizers
import pytest

from planloom.llm import token_count as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    t = tc.tokenizer(PATH)
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def odd_texts():
    r = random.Random(3)
    parts = ["word", " ", "  ", "\n", "\t", "don't", "we're", "<|endoftext|>", "é", "naïve", " ", "漢字", "1234", "!!", " ", "x" * 50, "🙂", "'", "<|end", " a", "\u0085", "\r\n", "\x1f", "٣"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(300)]


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (150, 70), (400, 100)])
def test_overlapping_chunks_count_as_the_library(chunk, overlap):
    t = tc.tokenizer(PATH)
    texts = odd_texts() + ["a" * 3000, " " * 2000, "<|endoftext|>" * 200, "漢字" * 700, "ab " * 900 + "\n" * 500]
    assert [tc.count_huge(t, x, chunk, overlap) for x in texts] == library(texts)


def test_counts_on_a_table(spark):
    texts = odd_texts() + ["", None, "b" * 40000, "word and " * 9000, "ñ " * 20000]
    rows = [(i, x, "clash", 1) for i, x in enumerate(texts)] + [(5, "again", "clash", 1), (None, "null id", "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    got = tc.token_counts(df, PATH).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (i if i is not None else -1, len((x or "").encode()), n, n > 512) for (i, x, *_), n in zip(rows, library([r[1] for r in rows]), strict=True)
    )
    assert tc.token_counts(df.limit(0), PATH).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % len(letters)] for i in range(n))


@pytest.mark.parametrize("letters", ["ab", "xy", "01", "qé"])
def test_strings_that_collide_under_sums_of_powers(spark, letters):
    """Such hashes of a sequence over two letters and of its complement are equal modulo 2**64."""
    texts = [thue_morse(n, z) for n in (1024, 2048, 4096, 8192) for z in (letters, letters[::-1])]
    texts += [f"see {x} there" for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r.n_tokens for r in tc.token_counts(df, PATH).orderBy("doc_id").collect()] == library(texts)


def test_pieces_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tc.tk, "range_hash", lambda data, start, end: (end - start).astype("uint64") % 3)
    texts = odd_texts()
    for part in tc.tk.slices(tc.pa.array(texts)):
        start, end = tc._pieces(part)
        got = tc._count_pieces(tc.tokenizer(PATH), {}, part, start, end)
        raw = part.data.tobytes()
        assert got.tolist() == library([raw[a:b].decode() for a, b in zip(start, end, strict=True)])


@pytest.mark.parametrize("text", ["a" * 5_000_000, "QUJD" * 250_000, "漢" * 300_000])
def test_texts_without_boundaries_take_linear_time(text):
    began = time.time()
    assert tc.count_huge(tc.tokenizer(PATH), text) == library([text])[0]
    assert time.time() - began < 60
