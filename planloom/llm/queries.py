"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, cover_tree, decontamination, jaccard_join, license_scan, mixing, secret_scan, sharding, token_count, toxicity, vector_codes, vector_graph, warc

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), short=license_scan.SHORT)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, within eight edits for each hundred characters."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled ones that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector, by integer inner product."""
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS asked, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r),
r AS (SELECT query_id, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, read back through the merged index of the archives."""
    return warc.archive_and_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


OP5_SQL = """
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www[.]', '') AS host, regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]+', ''), '#.*$', '') AS rest,
  octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END) AS url_key, 1704067200 + coalesce(page_id, 0)::BIGINT AS captured FROM p)
SELECT p.page_id, p.payload_bytes, p.payload_digest, p.url_key, p.captured, row_number() OVER (ORDER BY p.url_key, p.captured, p.page_id) - 1 AS position, CASE WHEN f.first IS DISTINCT FROM p.page_id AND f.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS DISTINCT FROM p.page_id THEN f.first END AS refers_to
FROM k p LEFT JOIN f USING (payload_digest)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with all its columns, and its shard."""
    return sharding.shard(table(spark, sf_dir, "documents"), 64)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), k=3, percent=90)


OP7_SQL = f"""
WITH RECURSIVE
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS id, x AS seen FROM both_ways UNION SELECT r.id, b.y FROM r JOIN both_ways b ON r.seen = b.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(seen) AS least FROM r GROUP BY id) c ON c.id = d.doc_id
"""

def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text, by patterns and by the randomness battery."""
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix with weights 1, 2, 3 by source takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix-1:' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place, 3.0::DOUBLE * source_size AS cap FROM s),
w AS (SELECT *, ([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE])[place % 3 + 1] AS weight FROM r),
l AS (SELECT *, row_number() OVER o AS k, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, place)),
f AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM l WHERE weight * level <= cap),
g AS (SELECT l.source, l.source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN l.cap ELSE l.weight * f.level END AS target FROM l CROSS JOIN f),
q AS (SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT q.*, c.n, (upto + c.n * source_size)::DOUBLE / target AS finish FROM q CROSS JOIN (VALUES (0), (1), (2)) c(n) WHERE size > 0 AND target > 0),
t AS (SELECT *, sum(size) OVER (ORDER BY finish, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END, h, doc_id, n ROWS UNBOUNDED PRECEDING) AS total FROM e),
b AS (SELECT floor(sum(target) + 1e-6) AS budget FROM g),
m AS (SELECT doc_id, count(*) AS copies FROM t CROSS JOIN b WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target, (q.size * coalesce(m.copies, 0))::BIGINT AS taken FROM q LEFT JOIN m USING (doc_id)
"""


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the 50k byte-level BPE; a limit of 512."""
    import public_tokenizers

    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 16 parts, 64 entries each, two rounds."""
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings"))


_NEAR11 = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i])))"
_ASSIGN11 = f"SELECT p.r, p.part, min({_NEAR11} * 64 + b.e) AS m FROM p JOIN {{}} b ON p.part = b.part GROUP BY ALL"
_MOVE11 = """SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM {} b LEFT JOIN (
  SELECT part, e, list(s ORDER BY i) AS c FROM (
    SELECT a.part, a.m % 64 AS e, i, floor(sum(p.x[i]) / count(*))::BIGINT AS s FROM {} a JOIN p USING (r, part) CROSS JOIN range(1, 1025) t(i) WHERE i <= len(p.x) GROUP BY ALL) GROUP BY ALL) n
  ON n.part = b.part AND n.e = b.e"""
OP11_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, j AS part, v[j * (len(v) // 16) + 1 : (j + 1) * (len(v) // 16)] AS x FROM k CROSS JOIN range(16) t(j)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= 64),
a0 AS MATERIALIZED ({_ASSIGN11.format("c0")}),
c1 AS MATERIALIZED ({_MOVE11.format("c0", "a0")}),
a1 AS MATERIALIZED ({_ASSIGN11.format("c1")}),
c2 AS MATERIALIZED ({_MOVE11.format("c1", "a1")}),
a2 AS MATERIALIZED ({_ASSIGN11.format("c2")}),
told AS (SELECT r, string_agg(printf('%02x', (m % 64)::INTEGER), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM c2)
SELECT k.vec_id, told.code, told.error, sum(told.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, book.h AS codebooks_sha256 FROM k JOIN told USING (r) CROSS JOIN book
"""


def op12_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest that are found of every twentieth vector, by inner product."""
    return vector_graph.nearest(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired texts of all conversations after damage."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


_CRC13 = """xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT), lambda acc, b:
    list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(acc, b)), 4294967295::BIGINT))"""
_KEY13 = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"


def _edit(state: int, letter: str, cost: str) -> str:
    return f"{{'c': (f[{state + 1}].c + {cost})::BIGINT, 'a': f[{state + 1}].a || '{letter}'}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _steps(keep: str, states: tuple[int, ...]) -> list[str]:
    """SQL of a row's ways to be kept, or given another role, from these states."""
    never = "CASE WHEN fault >= 2 THEN 1000000000 ELSE 0 END"
    return [x for s in states for x in (_edit(s, "K", f"open + {never} + CASE WHEN initial = '{keep}' THEN 0 ELSE 1000000000 END"), *([_edit(s, "R", f"2 + open + {never}")] if keep != "s" else []))]


OP13_SQL = f"""
WITH RECURSIVE
c AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC13.format(_KEY13)} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM d),
r AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN fault = 1 THEN 1 ELSE 0 END AS open FROM (SELECT *, CASE WHEN final = '' THEN 2 WHEN again > 1 THEN 3 WHEN final NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM o)),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM r GROUP BY conv_id),
x AS (SELECT conv_id, count(*) FILTER (was IS NOT NULL AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM r) GROUP BY conv_id),
p AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 4::BIGINT, 'a': 'II'}}] AS f FROM conversations
  UNION ALL
  SELECT conv_id, i, [f[1], f[2], f[3], {_least("f[4]", _edit(2, "I", "2"))}] FROM (
    SELECT conv_id, i, [f[1], f[2], {_least("f[3]", _edit(0, "I", "2"), _edit(1, "I", "2"), _edit(3, "I", "2"))}, f[4]] AS f FROM (
      SELECT p.conv_id, r.i, [{_edit(0, "D", "3")}, {_least(_edit(1, "D", "3"), *_steps("s", (0,)))}, {_least(_edit(2, "D", "3"), *_steps("u", (0, 1, 3)))}, {_least(_edit(3, "D", "3"), *_steps("a", (2,)))}] AS f
      FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
b AS MATERIALIZED (SELECT p.conv_id, {_least("f[1]", "f[4]")} AS best FROM p LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(n.n, 0)),
l AS (SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS pos, best.a AS a FROM b),
e AS (SELECT conv_id, pos, a[pos] AS letter, length(regexp_replace(a[1:pos], 'I', '', 'g')) AS i, length(regexp_replace(a[1:pos], 'D', '', 'g')) - 1 AS place FROM l),
w AS (SELECT e.conv_id, e.pos, e.letter, e.place, r.role, CASE WHEN e.letter <> 'I' THEN r.text ELSE '' END AS text, bool_or(e.letter = 'K' AND e.place = 0 AND r.initial = 's') OVER (PARTITION BY e.conv_id) AS led
  FROM e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i WHERE e.letter <> 'D'),
h AS (SELECT conv_id, string_agg((CASE WHEN letter = 'K' THEN role WHEN (place - led::INTEGER) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS t FROM w GROUP BY conv_id)
SELECT b.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(x.illegal, 0) AS illegal, b.best.c AS cost, b.best.a AS audit, sha256(coalesce(h.t, '')) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM b.conv_id
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_decontamination, op3_toxicity, op4_dual_cover_tree, op5_warc_index, op6_sharding, op7_ngram_jaccard_join, op8_secret_scan, op9_source_mixing, op10_token_count,
        op11_vector_codes, op12_vector_graph, op13_conversation_repair,
    )
}
ORACLES = {
    "op4_dual_cover_tree": OP4_SQL, "op5_warc_index": OP5_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op9_source_mixing": OP9_SQL, "op11_vector_codes": OP11_SQL, "op13_conversation_repair": OP13_SQL,
}
