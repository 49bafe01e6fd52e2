"""Queries that write files in the shared folder, in the formats that the readers know, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.graph import tables as graph_tables
from framewright.plans.q_graphs import _G, day_graphs
from framewright.plans.q_prep import char_ids
from framewright.plans.registry import query, table
from framewright.plans.shapes import SPANS, r6, user_spans
from framewright.prep import retrieval
from framewright.session import shared_folder
from framewright.sources import annotations, documents, graphs, tables, tokenstore


def _one_file(rows: DataFrame, spark: SparkSession, name: str) -> str:
    """rows (value string) as one text file: these formats hold a whole data set in one JSON document."""
    path = shared_folder(spark, name)
    rows.coalesce(1).write.option("lineSep", "\n").text(path)
    return path


def _document(rows: DataFrame, spark: SparkSession, name: str, opening: str) -> str:
    """rows (value string: an entry) as one JSON document that is in no row as a whole."""
    path = shared_folder(spark, name)
    documents.write_document(rows, path, opening)
    return path


def _local(path: str) -> str:
    """The path as files see it: token stores read and write plain files in a folder that all executors share."""
    return path.removeprefix("file://").removeprefix("file:")


def _lines(rows: DataFrame, spark: SparkSession, name: str) -> str:
    path = shared_folder(spark, name)
    rows.write.json(path)
    return path


@query("scan_graphs", f"WITH {_G} SELECT 'day' || day || '.mp4' AS video_path, 'user_' || user_id AS object_id, min(hour) AS s, max(hour) AS e FROM g GROUP BY day, user_id")
def scan_graphs(spark: SparkSession, sf: str) -> DataFrame:
    g = graphs.read_graphs(spark, _lines(day_graphs(spark, sf), spark, "graphs"))
    return graph_tables.objects(g).select("video_path", "object_id", "s", "e")


@query("append_sink", "SELECT o_orderkey, o_orderpriority FROM orders")
def append_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to one folder."""
    o, path = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), shared_folder(spark, "append")
    for k in (0, 1):
        graphs.append(o.where(F.pmod("o_orderkey", F.lit(2)) == k), path)
    return spark.read.schema(o.schema).json(path)


@query("gather_chunks", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // ceil(count(*) OVER () / 4)::BIGINT)::INT AS chunk FROM orders")
def gather_chunks(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "chunks")
    graphs.split_files(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 4, path)
    return graphs.gather_chunks(spark, path, 4, "o_orderkey long")


@query("result_sink", "SELECT o_orderpriority AS \"group\", count(*) AS n, 'run' AS model FROM orders GROUP BY 1")
def result_sink(spark: SparkSession, sf: str) -> DataFrame:
    o, path = table(spark, sf, "orders"), shared_folder(spark, "results")
    graphs.save_results(o.select("o_orderkey"), o.groupBy(F.col("o_orderpriority").alias("group")).agg(F.count("*").alias("n")), path, model="run")
    return spark.read.schema("group string, n long, model string").json(f"{path}/status")


_FIRST = "f AS (SELECT l_orderkey, l_suppkey, l_quantity::DOUBLE AS q, l_orderkey % 40 AS s FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = 1)"


def _first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(l_orderkey, l_suppkey, q, s): an order's first line; q is a place in the picture, s a frame."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by(F.struct("l_suppkey", "l_quantity"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("x"))  # noqa: E741
    return l.select("l_orderkey", "x.l_suppkey", F.col("x.l_quantity").cast("double").alias("q"), F.pmod("l_orderkey", F.lit(40)).alias("s"))


def _tracks(d: DataFrame, *more: str) -> DataFrame:
    t = F.get("gt", F.lit(0))
    at = F.try_element_at(t["boxes"], t["s"])
    return d.select("sample_id", "video_path", "query", t["s"].alias("s"), t["e"].alias("e"), *[r6(F.get(at, F.lit(i))).alias(n) for i, n in ((0, "x1"), (3, "y2"))], *more)


@query("scan_query_lines", f"WITH {_FIRST} SELECT l_orderkey::VARCHAR AS sample_id, 'v' || l_suppkey || '.mp4' AS video_path, 'who ' || s AS query, s, s AS e, round(q / 100, 6) AS x1, round((q + 20) / 100, 6) AS y2, round(q / 50, 6) AS difficulty_score FROM f")
def scan_query_lines(spark: SparkSession, sf: str) -> DataFrame:
    f = _first_lines(spark, sf)
    member = F.struct(F.lit(1).alias("target_index"), F.create_map(F.col("s").cast("string"), F.array("q", "q", F.col("q") + 20, F.col("q") + 20)).alias("boxes"))
    rows = f.select(F.concat(F.lit("v"), "l_suppkey", F.lit(".mp4")).alias("video_path"), F.concat(F.lit("who "), "s").alias("query"), F.col("l_orderkey").cast("string").alias("queryid"), F.lit(100.0).alias("video_width"), F.lit(100.0).alias("video_height"), F.array(member).alias("target_members"), F.struct((F.col("q") / 50).alias("D")).alias("Difficulty"))
    return _tracks(annotations.queries(spark, _lines(rows, spark, "queries")), "difficulty_score").withColumn("difficulty_score", r6(F.col("difficulty_score")))


@query("scan_corner_sized", f"WITH {_FIRST} SELECT l_orderkey || '.mp4' AS sample_id, l_orderkey || '.mp4' AS video_path, 'q' || s AS query, s, s + 1 AS e, round(q / 60, 6) AS x1, round((q + 5) / 60, 6) AS y2 FROM f WHERE q + 15 <= 60")
def scan_corner_sized(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes as corner and size; a video with a box outside the picture goes."""
    f = _first_lines(spark, sf)
    entry = F.struct(F.col("s").alias("st_frame"), (F.col("s") + 1).alias("ed_frame"), F.lit(60).alias("width"), F.lit(60).alias("height"), F.array(F.array("q", "q", F.lit(5.0), F.lit(5.0)), F.array("q", F.lit(0.0), F.lit(15.0), F.lit(5.0))).alias("bbox"), F.concat(F.lit("q"), "s").alias("English"))
    rows = f.select(documents.entry_text(F.concat("l_orderkey", F.lit(".mp4")), entry).alias("value"))
    return _tracks(annotations.corner_sized(spark, _document(rows, spark, "corner", "{")))


@query("scan_cornered", f"WITH {_FIRST} SELECT l_orderkey::VARCHAR AS sample_id, 'k' || l_suppkey || '.mp4' AS video_path, 'q' || s AS query, s, s AS e, round(q / 100, 6) AS x1, round((q + 5) / 80, 6) AS y2, CASE WHEN s % 2 = 0 THEN 'declar' ELSE 'inter' END AS qtype FROM f")
def scan_cornered(spark: SparkSession, sf: str) -> DataFrame:
    f = _first_lines(spark, sf)
    box = F.struct(F.col("q").alias("xmin"), F.col("q").alias("ymin"), (F.col("q") + 5).alias("xmax"), (F.col("q") + 5).alias("ymax"))
    entry = F.struct(F.concat(F.lit("k"), "l_suppkey").alias("vid"), F.struct(F.col("s").alias("begin_fid"), F.col("s").alias("end_fid")).alias("temp_gt"), F.array(box).alias("target_bboxs"), F.when(F.pmod("s", F.lit(2)) == 0, "declar").otherwise("inter").alias("qtype"), F.struct(F.concat(F.lit("q"), "s").alias("description")).alias("sentence"), F.lit(2.0).alias("fps"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"), F.lit(50).alias("frame_count"))
    rows = f.select(documents.entry_text(F.col("l_orderkey").cast("string"), entry).alias("value"))
    return _tracks(annotations.cornered(spark, _document(rows, spark, "cornered", "{")), "qtype")


@query("scan_aligned", f"WITH {_FIRST} SELECT l_orderkey::VARCHAR AS sample_id, 'v' || l_suppkey AS video_path, 'q' || s AS query, least(s, 20) AS s, greatest(s, 20) AS e, NULL::DOUBLE AS x1, NULL::DOUBLE AS y2, least(s, 7) || '-' || greatest(s, 7) AS cut FROM f WHERE s % 5 > 0")
def scan_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Spans come either way round; items without a question go."""
    f = _first_lines(spark, sf)
    token = F.create_map(F.lit("<s>"), F.col("s").cast("string"), F.lit("<e>"), F.lit("20"))
    item = F.struct(F.concat(F.lit("v"), "l_suppkey").alias("video_path"), F.struct(F.when(F.pmod("s", F.lit(5)) > 0, F.concat(F.lit("q"), "s")).alias("q")).alias("QA"), F.struct(token.alias("time_token"), F.array("s", F.lit(7).cast("long")).alias("split")).alias("meta"), F.col("l_orderkey").cast("string").alias("id"))
    d = annotations.aligned(spark, _document(f.select(F.to_json(item).alias("value")), spark, "aligned", "["))
    return _tracks(d, F.array_join(F.transform("clip_split", lambda x: x.cast("string")), "-").alias("cut"))


@query("detections_csv", "SELECT 's' || l_suppkey AS video, (l_orderkey % 900)::INT AS frame, round(l_quantity::DOUBLE / 100, 3) AS x1, l_linenumber::INT AS label, round(l_discount::DOUBLE, 3) AS score FROM lineitem WHERE l_linenumber <= 4")
def detections_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of four classes, written and read as CSV."""
    x = (F.col("l_quantity") / 100).cast("double")
    d = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("video"), F.pmod("l_orderkey", F.lit(900)).cast("int").alias("frame"), x.alias("x1"), x.alias("y1"), (x + 0.5).alias("x2"), (x + 0.5).alias("y2"), F.col("l_linenumber").cast("int").alias("label"), F.col("l_discount").cast("double").alias("score"))
    path = shared_folder(spark, "detections")
    tables.write_detections(d, path)
    return tables.read_detections(spark, path, [1, 2, 3, 4]).select("video", "frame", F.round("x1", 3).alias("x1"), "label", F.round("score", 3).alias("score"))


@query("exclusions_csv", "SELECT DISTINCT 'c' || o_custkey AS video, (o_orderkey % 500)::INT AS frame FROM orders")
def exclusions_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "exclusions")
    table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey"), F.format_string("%04d", F.pmod("o_orderkey", F.lit(500)))).distinct().write.csv(path)
    return tables.read_exclusions(spark, path)


@query("label_map", "SELECT n_nationkey::INT AS label, n_name AS name FROM nation")
def label_map(spark: SparkSession, sf: str) -> DataFrame:
    block = F.concat(F.lit('label {\n  name: "'), "n_name", F.lit('"\n  label_id: '), F.col("n_nationkey").cast("string"), F.lit("\n  label_type: 1\n}"))
    return tables.read_labels(spark, _one_file(table(spark, sf, "nation").agg(F.array_join(F.collect_list(block), "\n").alias("value")), spark, "labels"))


_TOKENS = "t AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: ascii(c) % 5000 + 2) AS t FROM documents)"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(char_ids(F.coalesce("text", F.lit(""))), lambda c: (F.pmod(c, F.lit(5000)) + 2).cast("int"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document"), ids.alias("tokens"))


@query("token_shards", f"WITH {_TOKENS} SELECT sum(len(t))::BIGINT AS n, sum(list_sum(t))::BIGINT AS total FROM t")
def token_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as token shards, and all tokens read back."""
    tokenstore.register(spark)
    path = _local(shared_folder(spark, "shards"))
    _tokens(spark, sf).write.format("token_shards").option("path", path).option("bos", 1).mode("append").save()
    t = spark.read.format("token_shards").load(path).select(F.explode("tokens").alias("t"))
    return t.agg(F.count("*").alias("n"), F.sum("t").cast("long").alias("total"))


@query("indexed_tokens", f"WITH {_TOKENS} SELECT len(t)::INT AS n, list_sum(t)::BIGINT AS total, t[1] AS head, count(*) AS documents FROM t WHERE len(t) > 0 GROUP BY ALL")
def indexed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as an indexed binary store, and its sequences read back."""
    tokenstore.register(spark)
    path = _local(shared_folder(spark, "indexed"))
    _tokens(spark, sf).where(F.size("tokens") > 0).write.format("indexed_tokens").option("path", f"{path}/all").mode("append").save()
    parts = None
    for p in tokenstore.prefixes([f"{path}/*"]):
        d = spark.read.format("indexed_tokens").load(p)
        parts = d if parts is None else parts.union(d)
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    return parts.select(F.size("tokens").alias("n"), total.alias("total"), F.get("tokens", F.lit(0)).alias("head")).groupBy("n", "total", "head").agg(F.count("*").alias("documents"))


@query("feature_shards", "SELECT DISTINCT (vec_id % 5)::INT AS shard FROM embeddings")
def feature_shards(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "features")
    tables.write_shards(table(spark, sf, "embeddings").withColumn("shard", F.pmod("vec_id", F.lit(5)).cast("int")), path, "shard", ["vec_id", "embedding"])
    return tables.shards_present(spark, path, "shard")


@query("chat_slice", "SELECT id FROM (SELECT DISTINCT conv_id::VARCHAR AS id FROM conversations) ORDER BY id LIMIT 50 OFFSET 10")
def chat_slice(spark: SparkSession, sf: str) -> DataFrame:
    """A slice 'train[10:60]' of chat lines."""
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.to_json(F.collect_list(F.struct("role", F.col("text").alias("content")))).alias("messages"))
    path = shared_folder(spark, "chats") + ".jsonl"
    c.write.json(path)
    return tables.read_chats(spark, path, "train[10:60]", "id").select("id")


@query("retrieval_inline", "SELECT 'b' || item_id AS question_id, md5(text) AS question, 2 AS positives, (item_id % 3)::INT AS negatives FROM benchmark")
def retrieval_inline(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias("query"), F.array(F.lit("p"), "text").alias("pos_doc"), F.array_repeat(F.lit("n"), F.pmod("item_id", F.lit(3)).cast("int")).alias("neg_doc"))
    r = retrieval.read_inline(spark, _lines(b, spark, "inline"))
    return r.select("question_id", F.md5("question").alias("question"), F.size("pos_doc").alias("positives"), F.size("neg_doc").alias("negatives"))


@query("retrieval_questions", "SELECT 'b' || item_id AS question_id, md5(text) AS question, item_id::VARCHAR AS positive, (item_id + 1)::VARCHAR AS negative FROM benchmark")
def retrieval_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of one JSON document that names its corpora."""
    i = F.col("item_id")
    q = F.struct(F.concat(F.lit("b"), i).alias("question_id"), F.col("text").alias("question"), F.lit("c").alias("corpus_id"), F.array(F.struct(i.cast("string").alias("id"))).alias("pos_doc"), F.array(F.struct((i + 1).cast("string").alias("id"))).alias("neg_doc"))
    whole = table(spark, sf, "benchmark").agg(F.to_json(F.struct(F.array(F.struct(F.lit("corpus").alias("path"))).alias("corpus"), F.collect_list(q).alias("data"))).alias("value"))
    questions, _ = retrieval.read_questions(spark, _one_file(whole, spark, "questions"))
    return questions.select("question_id", F.md5("question").alias("question"), F.col("pos_doc")[0]["id"].alias("positive"), F.col("neg_doc")[0]["id"].alias("negative"))


@query("mask_rows", "SELECT 'u' || user_id AS video_path, event_id % 30 AS frame, event_id AS track, '4x' || event_id % 7 AS counts FROM events")
def mask_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Run-length masks as one row a frame, and back."""
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("video_path"), F.pmod("event_id", F.lit(30)).alias("frame"), F.col("event_id").alias("track"), F.array(F.lit(4), F.lit(4)).alias("size"), F.concat(F.lit("4x"), F.pmod("event_id", F.lit(7)).cast("string")).alias("counts"))
    lengths = e.select("video_path").distinct().withColumn("n_frames", F.lit(30).cast("long"))
    return graphs.rle_rows(graphs.rle_by_frame(e, lengths)).drop("size")


@query("singleton_tracks", "SELECT 'u' || user_id AS video_path, event_id AS ord, event_type || '_' || (row_number() OVER (ORDER BY 'u' || user_id, event_id % 30, event_id) + 99) AS node_id FROM events")
def singleton_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Every detection as a track of its own, numbered from 100."""
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("video_path"), F.pmod("event_id", F.lit(30)).alias("frame"), F.col("event_id").alias("ord"), F.col("event_type").alias("class"))
    return graphs.attach_tracks(e, 100).select("video_path", "ord", "node_id")


@query("cut_clips", f"WITH {SPANS}, v AS (SELECT user_id, event_type, s, e, row_number() OVER (PARTITION BY user_id ORDER BY event_type, s) - 1 AS k FROM sp WHERE user_id % 3 > 0) SELECT 'u' || user_id AS video_path, k AS clip_id, s AS start_frame, e AS end_frame FROM v WHERE e - s >= 1 UNION ALL SELECT DISTINCT 'u' || user_id, 0, 0, 99 FROM sp WHERE user_id % 3 = 0")
def cut_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Shots of a second and more; a video without shots is one clip."""
    from pyspark.sql import Window

    u = user_spans(spark, sf).withColumn("video_path", F.concat(F.lit("u"), "user_id"))
    w = Window.partitionBy("user_id").orderBy("event_type", "s")
    shots = u.where(F.pmod("user_id", F.lit(3)) > 0).select("video_path", (F.row_number().over(w) - 1).cast("long").alias("clip_id"), F.col("s").alias("start_frame"), F.col("e").alias("end_frame"), F.col("s").cast("double").alias("start_time"), F.col("e").cast("double").alias("end_time"))
    whole = u.select("video_path", F.lit(100).alias("n_frames"), F.lit(2.0).alias("fps")).distinct()
    return graphs.cut_clips(shots, 1.0, whole).select("video_path", "clip_id", "start_frame", "end_frame")


@query("qa_formats", "SELECT doc_id, md5('Context: ' || coalesce(text, '') || ' Question: ' || lang || ' Answer: ') AS prompt, source AS answer, [lang, source][doc_id % 2 + 1] AS ending, (doc_id % 2)::INT AS label FROM documents")
def qa_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Question, completion and pair rows from one table."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("context"), F.col("lang").alias("question"), "source", F.pmod("doc_id", F.lit(2)).alias("label"))
    s = retrieval.squad_rows(d.select("context", "question", F.struct(F.array(F.concat(F.lit(" "), "source", F.lit("|"), "doc_id")).alias("text")).alias("answers")))
    c = retrieval.completion_rows(d.select(F.col("doc_id").alias("ctx"), F.array("question", "source").alias("endings"), "label")).toDF("doc_id", "ending")
    p = retrieval.pair_rows(d, "doc_id", "source").select(F.col("text_a").alias("doc_id"), "label")
    a = s.select(F.split_part("answer", F.lit("|"), F.lit(2)).cast("long").alias("doc_id"), F.md5("prompt").alias("prompt"), F.split_part("answer", F.lit("|"), F.lit(1)).alias("answer"))
    return a.join(c, "doc_id").join(p, "doc_id")
