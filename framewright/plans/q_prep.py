"""Queries that prepare training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import arrays, box
from framewright.operators import relational
from framewright.plans.registry import query, table
from framewright.plans.shapes import FRAMES, frames, r6
from framewright.prep import blending, chats, packing, sampling
from framewright.sources import exports


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def char_ids(text: Column | str) -> Column:
    """The code points of a text; an empty one has none."""
    chars = F.split(text, "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c))


@query("token_vocab_topk", """WITH t AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT ascii(c)::BIGINT AS token, count(*) AS n FROM t WHERE c <> '' AND ascii(c) < 256 GROUP BY 1),
a AS (SELECT token, 1 AS t, -n AS k FROM n WHERE token NOT IN (0, 2) UNION ALL SELECT * FROM (VALUES (2, 0, 0), (0, 0, 1)) v(token, t, k) UNION ALL SELECT x, 2, 0 FROM range(256) r(x) WHERE x NOT IN (SELECT token FROM n) AND x NOT IN (0, 2)), o AS (SELECT row_number() OVER (ORDER BY t, k, token) - 1 AS place, token FROM a) SELECT place, token FROM o WHERE place < 60""")
def token_vocab_topk(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    d = docs(spark, sf).select(ids.alias("ids")).withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    return sampling.vocabulary(d, "ids", "mask", 256, 60, (2, 0, 2))


def _seeded(*parts: str) -> str:
    """sampling.seeded in SQL."""
    return f"CAST(('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 12)) AS BIGINT)"


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.floor(F.col("n_chars") / 3).alias("n"))


@query("pack_sequential")
def pack_sequential(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_in_order(_lengths(spark, sf), "doc_id", "n", 4096, "doc_id", shards=8)


@query("pack_knapsack")
def pack_knapsack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_lengths(spark, sf), "doc_id", "n", 4096, shards=8)


@query("pack_totals", "SELECT count(*) AS n, sum(n_chars // 3)::BIGINT AS tokens FROM documents WHERE n_chars // 3 <= 4096")
def pack_totals(spark: SparkSession, sf: str) -> DataFrame:
    """No row is lost and no pack overflows (else an error)."""
    p = pack_knapsack(spark, sf)
    full = p.groupBy("shard", "pack").agg(F.sum("length").alias("t"), F.count("*").alias("k"))
    ok = F.when(F.max("t") <= 4096, F.sum("t")).otherwise(F.raise_error(F.lit("a pack overflows")).cast("long"))
    return full.agg(F.sum("k").alias("n"), ok.alias("tokens"))


@query("packed_samples")
def packed_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts in packs of 1024 tokens, or of the longest text where that is more: no row is too long for a pack."""
    t = docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
    size = max(1024, t.agg(F.max("n")).collect()[0][0] or 0)
    s = packing.packed_samples(t, packing.pack(t, "doc_id", "n", size, shards=4, too_long="error"), "doc_id", size, ids="text", tokenize=char_ids)
    return s.select("shard", "pack", F.size("input_ids").alias("size"), F.array_max("attention_mask").alias("sequences"), F.array_max("position_ids").alias("longest"))


@query("blend_indices", """WITH RECURSIVE z AS (SELECT list(n ORDER BY source) AS sizes, sum(n)::BIGINT AS total FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)),
r AS (SELECT -1::BIGINT AS draw, NULL::BIGINT AS k, NULL::BIGINT AS place, list_transform(sizes, lambda x: 0::BIGINT) AS taken, sizes, total FROM z
UNION ALL SELECT draw + 1, k, taken[k], list_transform(taken, lambda t, i: t + (i = k)::BIGINT), sizes, total FROM (
SELECT *, list_position(lag, list_max(lag)) AS k FROM (SELECT draw, taken, sizes, total, list_transform(sizes, lambda x, i: CASE WHEN taken[i] < x THEN x / total * greatest(draw + 1, 1) - taken[i] ELSE -1e300 END) AS lag FROM r WHERE draw + 1 < total)))
SELECT draw, (k - 1)::INT AS dataset, place FROM r WHERE k IS NOT NULL""")
def blend_indices(spark: SparkSession, sf: str) -> DataFrame:
    n = docs(spark, sf).groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()  # a row a source
    return blending.blend_table(spark, sizes=[r.n for r in n])


@query("blend_shares", """WITH RECURSIVE r AS (SELECT -1 AS draw, NULL::INT AS k, NULL::BIGINT AS place, 0::BIGINT AS a, 0::BIGINT AS b
UNION ALL SELECT draw + 1, k, CASE k WHEN 0 THEN a ELSE b END, a + (k = 0)::BIGINT, b + (k = 1)::BIGINT FROM (SELECT *, CASE WHEN 0.7::DOUBLE * greatest(draw + 1, 1) - a >= 0.3::DOUBLE * greatest(draw + 1, 1) - b THEN 0 ELSE 1 END AS k FROM (SELECT draw, a, b FROM r WHERE draw < 999)))
SELECT draw::BIGINT AS draw, k AS dataset, place FROM r WHERE k IS NOT NULL""")
def blend_shares(spark: SparkSession, sf: str) -> DataFrame:
    return blending.blend_table(spark, [0.7, 0.3], 1000)


@query("document_offsets", "SELECT doc_id, (coalesce(sum(n_chars // 3) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM documents")
def document_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return blending.document_offsets(_lengths(spark, sf), "doc_id", "n").select("doc_id", "start")


@query("sample_index", """WITH d AS (SELECT doc_id AS doc, n_chars // 3 AS n, coalesce(sum(n_chars // 3) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM documents), t AS (SELECT (sum(n) - 1) // 512 AS k FROM d)
SELECT s.x::BIGINT AS sample, doc, (s.x * 512 - start)::BIGINT AS "offset" FROM range((SELECT k + 1 FROM t)::BIGINT) s(x) JOIN d ON s.x * 512 >= start AND s.x * 512 < start + n""")
def sample_index(spark: SparkSession, sf: str) -> DataFrame:
    return blending.sample_index(_lengths(spark, sf), "doc_id", "n", 512)


_ORD = "o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)"


@query("split_ranges", f"WITH {_ORD} SELECT doc_id, CASE WHEN i < round_even(n * 0.9, 0) THEN 'train' WHEN i < round_even(n * 0.97, 0) THEN 'valid' ELSE 'test' END AS split FROM o")
def split_ranges(spark: SparkSession, sf: str) -> DataFrame:
    d = relational.ordinal(docs(spark, sf).select("doc_id"), ["doc_id"])
    parts = blending.split_rows(d.count(), blending.split_bounds(blending.split_shares("90,7,3")))
    name = F.lit(None).cast("string")
    for n, p in zip(("train", "valid", "test"), parts):
        if p:
            name = F.when((F.col("__ord") >= p[0]) & (F.col("__ord") < p[1]), n).otherwise(name)
    return d.select("doc_id", name.alias("split"))


@query("sft_rl_split", f"""WITH d AS (SELECT doc_id, source AS s, CASE WHEN source LIKE '%a%' THEN 'a' ELSE 'b' END AS source FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY {_seeded("doc_id", "'42'", "source")}, source, doc_id) - 1 AS position, count(*) OVER () AS n FROM d)
SELECT doc_id, s, source, position, CASE WHEN position < n * 5 // 7 THEN 'sft' ELSE 'rl' END AS part FROM o""")
def sft_rl_split(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", F.col("source").alias("s"))
    return exports.mixed_split({"a": d.where("s like '%a%'"), "b": d.where("s not like '%a%'")}, 5, 2, "doc_id")


@query("sft_rl_sizes", "SELECT 'sft' AS part, count(*) * 5 // 7 AS n FROM documents UNION ALL SELECT 'rl', count(*) - count(*) * 5 // 7 FROM documents")
def sft_rl_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sft_rl_split(spark, sf).groupBy("part").agg(F.count("*").alias("n"))


@query("shard_modulo", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 8 = 3")
def shard_modulo(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.modulo_shard(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 8, 3)


@query("rank_partition", "SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS part FROM orders")
def rank_partition(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.rank_parts(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("contiguous_chunks", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i // ceil(n / 7)::BIGINT = 2")
def contiguous_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from framewright.sources.graphs import chunk

    return chunk(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 2, 7)


@query("length_grouped_order", """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, (i % 4)::INT AS replica, (i // 4 // 8)::BIGINT AS chunk FROM o WHERE i // 4 < n // 4 // 8 * 8""")
def length_grouped_order(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.length_grouped(docs(spark, sf), "doc_id", "n_chars", 8, 4, 42).select("doc_id", "replica", "chunk")


@query("bucket_batches", f"""WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_seeded("doc_id", "'42'")}, doc_id) - 1 AS i FROM documents), n AS (SELECT lang, count(*) AS n, ceil(count(*) / 3)::BIGINT AS per FROM documents GROUP BY 1),
p AS (SELECT lang, n, per, unnest(range(per * 3)) AS p FROM n)
SELECT doc_id, lang, (p % 3)::INT AS replica, (p // 3 // 8)::INT AS batch, (p // 3 % 8)::INT AS slot FROM p JOIN o USING (lang) WHERE o.i = p % n AND p // 3 // 8 < per // 8""")
def bucket_batches(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.bucket_batches(docs(spark, sf).select("doc_id", "lang"), "doc_id", "lang", F.lit(8), 3, 42).drop("bucket_rank")


@query("sample_per_source", f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_seeded('doc_id', "'42'")}, doc_id) <= 20")
def sample_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_per_group(docs(spark, sf).select("doc_id", "source"), "source", "doc_id", 20, 42)


@query("resumed_sampler", f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () // 32 * 8 AS share FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_seeded("doc_id", "'7'")}, doc_id) - 1 AS position FROM o WHERE i >= share AND i < 2 * share)
SELECT doc_id, position FROM r WHERE position >= 16""")
def resumed_sampler(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id")
    return sampling.resumed(d, 64, d.count(), 8, 1, 4, 7, "doc_id")


@query("epochs", f"SELECT row_number() OVER (ORDER BY {_seeded('doc_id', "'7'", 'epoch')}, epoch, doc_id) - 1 AS place, epoch::INT AS epoch, doc_id FROM documents CROSS JOIN range(3) r(epoch)")
def epochs(spark: SparkSession, sf: str) -> DataFrame:
    return blending.document_index(docs(spark, sf), "doc_id", 3, 7)


@query("token_estimate", "SELECT page_id, (length(html) // 3 + 500 * (length(html) - length(replace(html, '<img', ''))) // 4)::BIGINT AS n FROM pages")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    from framewright.functions.media import text_length

    images = ((F.length("html") - F.length(F.replace(F.col("html"), F.lit("<img"), F.lit("")))) / 4).cast("int")
    return table(spark, sf, "pages").select("page_id", text_length(F.array("html"), images).cast("long").alias("n"))


@query("chat_normalize", "SELECT conv_id, count(*)::INT AS n, md5(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn, role, text)) AS h FROM conversations GROUP BY 1")
def chat_normalize(spark: SparkSession, sf: str) -> DataFrame:
    g = chats.gathered(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    turns = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    m = g.select("conv_id", chats.checked(chats.from_turns(turns)).alias("m"))
    return m.select("conv_id", F.size("m").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("h"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """One message a turn: the first by role and text."""
    x = F.min(F.struct("role", "text"))
    return table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(x.alias("x")).select("conv_id", "turn", "x.*")


_CONV = "c AS (SELECT conv_id, turn, min(x).role AS role, min(x).text AS text FROM (SELECT conv_id, turn, {'role': role, 'text': text} AS x FROM conversations) GROUP BY 1, 2)"


@query("history_truncate", f"""WITH {_CONV}, s AS (SELECT *, role = 'system' AND max((role <> 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 0 AS sys, len(text) AS k FROM c),
t AS (SELECT *, sum(CASE WHEN sys THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS fixed, sum(k) OVER (PARTITION BY conv_id) AS total, sum(CASE WHEN sys THEN 0 ELSE k END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS tail FROM s),
u AS (SELECT *, min(CASE WHEN role = 'user' AND fixed + tail <= 500 THEN turn END) OVER (PARTITION BY conv_id) AS cut, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM t)
SELECT conv_id, turn, coalesce(sys OR total <= 500 OR coalesce(cut, last) IS NULL OR turn >= coalesce(cut, last), false) AS kept FROM u""")
def history_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return chats.truncated(conversations(spark, sf), "conv_id", "turn", "role", F.length("text"), 500).select("conv_id", "turn", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("last_turn_mask", f"""WITH {_CONV}, a AS (SELECT conv_id, list((role = 'assistant')::INT ORDER BY turn) AS m FROM c GROUP BY 1), l AS (SELECT *, len(m) - coalesce(list_position(list_reverse(m), 1), len(m) + 1) + 1 AS last FROM a),
f AS (SELECT *, coalesce(list_max(list_filter(range(1, last), lambda i: m[i] = 0)), 0) AS before FROM l) SELECT conv_id, array_to_string(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i > before AND i <= last THEN 1 ELSE 0 END), '') AS mask FROM f""")
def last_turn_mask(spark: SparkSession, sf: str) -> DataFrame:
    c = conversations(spark, sf).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.col("role") == "assistant").cast("int").alias("m")))), lambda x: x["m"]).alias("m"))
    return c.select("conv_id", F.array_join(F.transform(arrays.last_run(F.col("m")), lambda x: x.cast("string")), "").alias("mask"))


@query("tool_call_positions", f"WITH {_CONV}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS prefix FROM c) SELECT conv_id, turn, prefix FROM r WHERE role = 'assistant'")
def tool_call_positions(spark: SparkSession, sf: str) -> DataFrame:
    return chats.assistant_positions(conversations(spark, sf), "conv_id", "turn", "role")


@query("column_map", f"WITH {_CONV}, r AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, md5(text) AS question, md5(nt) AS answer FROM r WHERE role = 'user' AND nr = 'assistant' AND trim(coalesce(nt, '')) <> ''")
def column_map(spark: SparkSession, sf: str) -> DataFrame:
    qa = chats.question_answers(conversations(spark, sf), "conv_id", "turn", "role", "text").withColumn("k", F.struct("conv_id", "turn"))
    m = chats.mapped_columns(qa, {"question": "question", "answer": "answer", "context": "k"})
    return m.select("context.conv_id", "context.turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("flatten_pairs", "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT - 1 AS place, vec_id FROM embeddings")
def flatten_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from framewright.prep.retrieval import flattened

    e = table(spark, sf, "embeddings").groupBy(F.col("label").alias("question_id")).agg(F.array_sort(F.collect_list("vec_id")).alias("doc_id")).withColumn("question", F.lit("q")).withColumn("doc_text", F.transform("doc_id", lambda x: x.cast("string")))
    return flattened(e).select(F.col("question_id").alias("label"), "place", F.col("doc_id").alias("vec_id"))


@query("retrieval_rows", """WITH d AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT item_id AS question_id, md5(x.text) AS positive, md5(y.text) AS negative FROM benchmark JOIN d x ON x.doc_id = item_id JOIN d y ON y.doc_id = item_id + 40""")
def retrieval_rows(spark: SparkSession, sf: str) -> DataFrame:
    from framewright.prep.retrieval import training_rows

    doc = lambda c: F.array(F.struct(c.cast("string").alias("id")))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit("c").alias("corpus_id"), doc(F.col("item_id")).alias("pos_doc"), doc(F.col("item_id") + 40).alias("neg_doc"))
    c = docs(spark, sf).select(F.lit("c").alias("corpus_id"), F.col("doc_id").cast("string").alias("id"), "text")
    t = training_rows(q, c, 1)
    return t.select("question_id", F.md5(F.get("doc_text", F.lit(0))).alias("positive"), F.md5(F.get("doc_text", F.lit(1))).alias("negative"))


@query("trajectory_text", f"""WITH {FRAMES}, v AS (SELECT user_id, frame, max(value) AS v FROM f WHERE event_type = 'click' GROUP BY ALL) SELECT user_id, '<' || string_agg(printf('%d, %.1f, %.1f, %.1f, %.1f, %.1f', frame, frame / 2.0, v, v / 2, v + 10, v / 2 + 10), '; ' ORDER BY frame) || ' />' AS t FROM v GROUP BY 1""")
def trajectory_text(spark: SparkSession, sf: str) -> DataFrame:
    v = frames(spark, sf).where("event_type = 'click'").groupBy("user_id", "frame").agg(F.max("value").alias("v"))
    b = box.box(F.col("v"), F.col("v") / 2, F.col("v") + 10, F.col("v") / 2 + 10)
    m = v.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), b))).alias("boxes"))
    return m.select("user_id", exports.trajectory(F.col("boxes"), 2.0, 1).alias("t"))


@query("label_shift", "WITH t AS (SELECT event_id, [event_id % 7, event_id % 5, event_id % 3, 9] AS a FROM events) SELECT event_id, a[2] || ',' || (-100) || ',' || a[4] || ',-100' AS labels FROM t")
def label_shift(spark: SparkSession, sf: str) -> DataFrame:
    a = F.array(*[F.pmod("event_id", F.lit(k)) for k in (7, 5, 3)], F.lit(9).cast("long"))
    s = arrays.shift_labels(a, F.array(*map(F.lit, (0, 1, 0, 1))))
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(s, lambda x: x.cast("string")), ",").alias("labels"))


@query("block_causal", """SELECT event_id, array_to_string(list_transform(range(event_id % 4 + 3), lambda i: array_to_string(list_transform(range(event_id % 4 + 3), lambda j: CASE WHEN j <= i AND (i <= event_id % 4) = (j <= event_id % 4) THEN '1' ELSE '0' END), '')), '|') AS mask FROM events""")
def block_causal(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.pmod("event_id", F.lit(4)) + 1).cast("int")
    m = arrays.block_causal_mask(F.array(n, F.lit(2)))
    row = lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), "")
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(m, row), "|").alias("mask"))


@query("softmax", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT vec_id, list_transform(v, lambda y: exp(y - list_max(v))) AS x FROM e), p AS (SELECT vec_id, list_transform(x, lambda y: y / list_sum(x)) AS p FROM x)
SELECT vec_id, i::INT AS i, round(p[i + 1], 6) AS p FROM p, unnest(range(len(p))) r(i)""")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(arrays.softmax(v)).alias("i", "p")).withColumn("p", r6(F.col("p")))


@query("corrupt_uniform")
def corrupt_uniform(spark: SparkSession, sf: str) -> DataFrame:
    t = docs(spark, sf).select("doc_id", char_ids("text").alias("ids")).withColumn("mask", F.transform("ids", lambda _, i: (i % 3 != 0).cast("int")))
    c = sampling.corrupt_uniform(t, "doc_id", "ids", "mask", 999, 7)
    return c.select("doc_id", F.size(F.filter("noise_mask", lambda x: x)).alias("noised"), F.size("noisy_ids").alias("n"))


@query("corrupt_blocks")
def corrupt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    t = docs(spark, sf).select("doc_id", char_ids("text").alias("ids")).withColumn("mask", F.when(F.col("ids").isNotNull(), F.array_repeat(F.lit(1), F.size("ids"))))
    c = sampling.corrupt_blocks(t, "doc_id", "ids", "mask", 999, 7, 32)
    return c.select("doc_id", F.size(F.filter("noise_mask", lambda x: x)).alias("noised"), F.size("noisy_ids").alias("n"))


@query("gumbel_top", f"""WITH z AS (SELECT source, doc_id, ln(n_chars + 1.0) - ln(-ln(({_seeded("doc_id", "'3'", "source")} + 0.5) / 281474976710656)) AS z FROM documents)
SELECT source, doc_id FROM z QUALIFY row_number() OVER (PARTITION BY source ORDER BY z DESC, doc_id) <= 5""")
def gumbel_top(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("source", "doc_id", F.log(F.col("n_chars") + 1.0).alias("w"), F.lit(5).alias("k"))
    return sampling.gumbel_top(d, ["source"], "doc_id", "w", "k", 3).where("chosen").select("source", "doc_id")
