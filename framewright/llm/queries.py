"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import bpe, chat, decontaminate, embdup, lm, neardup, pii, quality, shards, toxicity

SHARDS = 40


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """The rank file's path and the split pattern of the public tokenizer in use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_t(spark, sf_dir, "documents"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_t(spark, sf_dir, "documents"), pii.fit(pii.sample_table(spark)))


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_t(spark, sf_dir, "documents"), SHARDS)


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_t(spark, sf_dir, "documents"), k=4)


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicates(_t(spark, sf_dir, "embeddings"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_t(spark, sf_dir, "documents"), *tokenizer())


def op8_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return toxicity.report(docs, toxicity.fit(docs, _t(spark, sf_dir, "labels")))


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_t(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT *, turn - min(turn) OVER (PARTITION BY conv_id) AS d FROM t),
c AS (SELECT conv_id, list({'d': d, 'r': role, 'x': text} ORDER BY d, role, text) AS m, max(d) AS last FROM f GROUP BY conv_id),
p AS (SELECT DISTINCT m[1:k] AS m FROM (SELECT m, unnest(range(1, len(m))) AS k FROM c)),
w AS (SELECT min(conv_id) AS conv_id, CAST(len(m) AS BIGINT) AS n_turns, CAST(count(*) AS BIGINT) AS n_copies FROM c WHERE m NOT IN (SELECT m FROM p) GROUP BY m)
SELECT w.conv_id, CAST(d // 256 AS BIGINT) AS part, n_turns, n_copies,
  string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY d, role, text) AS rendered
FROM w JOIN f ON f.conv_id = w.conv_id GROUP BY w.conv_id, d // 256, n_turns, n_copies
"""


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shards by ranks: md5 orders the rows, a list function sums up the CRC.
OP3_SQL = """
WITH RECURSIVE bit(i, c, k) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM bit WHERE k = 8),
d AS (SELECT doc_id, 's' || source AS s, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, coalesce(s, '') AS s, CAST(len(x) // 2 + 16 AS BIGINT) AS size,
  CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) AS u,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda p: CAST(('0x' || x[2 * p + 1 : 2 * p + 2]) AS BIGINT))), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY u, doc_id) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY s) AS f, count(*) OVER () AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY f, s, u, doc_id) - 1 AS pos FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 40 // total AS INT) AS shard, CAST(pos - ((pos * 40 // total) * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""

#: All windows of all documents joined with those of the items.
OP4_SQL = f"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS v FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, size, array_to_string(v[j : j + size - 1], ' ') AS k FROM (SELECT item_id, v, least(13, len(v)) AS size, unnest(range(1, len(v) - least(13, len(v)) + 2)) AS j FROM i WHERE len(v) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
o AS (SELECT doc_id, size, j, array_to_string(w[j : j + size - 1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM d, (SELECT DISTINCT size FROM p))),
h AS (SELECT o.doc_id, p.item_id, o.j, o.size FROM o JOIN p ON p.size = o.size AND p.k = o.k),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + size)) AS pos FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
"""

#: All pairs of documents that share a shingle, and the closure of their links.
OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS j FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON link.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""

#: All pairs of vectors, and the closure of their links.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_sum(list_transform(x, lambda e: abs(e))) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95),
r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON link.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op10_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return quality.report(docs, quality.fit(docs, _t(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_bloom_lm, op2_pii_crf, op3_stratified_shards, op4_wu_manber, op5_minhash_forest, op6_cover_tree, op7_bpe_tree, op8_nnpu_toxicity, op9_chat_snapshots, op10_ftrl_quality)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_stratified_shards": OP3_SQL, "op4_wu_manber": OP4_SQL, "op5_minhash_forest": OP5_SQL, "op6_cover_tree": OP6_SQL, "op9_chat_snapshots": OP9_SQL}
