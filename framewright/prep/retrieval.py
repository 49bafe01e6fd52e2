"""Retrieval training data: questions, corpora, positives and negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.text import doc_hash63
from framewright.prep.sampling import sample_per_group

REQUIRED = ("question_id", "question", "corpus_id", "pos_doc", "neg_doc")


def read_questions(spark: SparkSession, path: str, n: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(questions, corpora) of a JSON file with a list of corpora and of data; documents are ids as text.

    A question without a required field or a positive is an error. With n, a
    seeded sample of the file's questions.
    """
    item = "struct<question_id: string, question: string, corpus_id: string, pos_doc: array<string>, neg_doc: array<string>>"
    d = spark.read.schema(f"corpus string, data array<{item}>").option("multiLine", "true").json(path)
    listed = F.coalesce(F.from_json("corpus", "array<struct<path: string>>"), F.array(F.from_json("corpus", "struct<path: string>")))
    corpora = d.select(F.explode(listed).alias("c")).select(resolved(F.col("c.path"), path).alias("path")).where("path is not null")
    q = d.select(F.explode("data").alias("x")).select("x.*")
    bad = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in REQUIRED], F.when(F.size("pos_doc") == 0, "pos_doc is empty"))
    q = q.withColumn("question", F.when(bad == "", F.col("question")).otherwise(F.raise_error(F.concat(F.lit("missing: "), bad))))
    for c in ("pos_doc", "neg_doc"):
        q = q.withColumn(c, F.transform(c, lambda x: F.struct(F.coalesce(F.get_json_object(x, "$.id"), x).alias("id"))))
    if n is not None:
        q = sample_per_group(q.withColumn("__f", F.lit(path)), "__f", "question_id", n, seed).drop("__f")
    return q, corpora


def resolved(path: Column, base: str) -> Column:
    """A relative path lies beside the file that names it."""
    folder = base.rsplit("/", 1)[0] if "/" in base else "."
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(folder + "/"), path))


def read_inline(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question, corpus_id, pos_doc, neg_doc) of JSON lines that hold the texts themselves."""
    d = spark.read.schema("query string, question string, question_id string, id string, corpus_id string, corpus string, pos_doc string, neg_doc string").json(path)
    docs = lambda c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    as_text = lambda c: F.transform(docs(c), lambda x: F.struct(F.coalesce(F.get_json_object(x, "$.text"), x).alias("text")))
    q = F.coalesce("query", "question")
    need = F.when(q.isNull(), F.raise_error(F.lit("a record has no query"))).when(F.size(docs("pos_doc")) == 0, F.raise_error(F.lit("a record has no pos_doc"))).otherwise(q)
    return d.select(F.coalesce("question_id", "id", F.concat(F.lit(path.rsplit("/", 1)[-1] + ":"), F.monotonically_increasing_id().cast("string"))).alias("question_id"), need.alias("question"), F.coalesce("corpus_id", F.lit("inline")).alias("corpus_id"), as_text("pos_doc").alias("pos_doc"), as_text("neg_doc").alias("neg_doc"))


def corpus_conflicts(corpora: DataFrame) -> DataFrame:
    """(corpus_id, paths) of ids that are given with more than one path."""
    return corpora.groupBy("corpus_id").agg(F.sort_array(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)


def training_rows(questions: DataFrame, corpus: DataFrame, n_neg: int, epoch: int = 0, instructions: DataFrame | None = None) -> DataFrame:
    """(question_id, question, doc_id, doc_text, instructions): one positive (the epoch's) and n_neg negatives, cycled.

    corpus: (corpus_id, id, text). No negatives where some are asked for, and a
    document that the corpus lacks, are errors.
    """
    pos = F.get("pos_doc", F.pmod(F.lit(epoch), F.size("pos_doc")))["id"]
    neg = F.transform(F.sequence(F.lit(0), F.lit(n_neg - 1)), lambda i: F.get("neg_doc", F.pmod(i, F.size("neg_doc")))["id"]) if n_neg else F.array().cast("array<string>")
    none = F.when(F.size("neg_doc") == 0, F.raise_error(F.lit("a question has no negatives"))) if n_neg else F.lit(None)
    ids = F.when(none.isNull(), F.concat(F.array(pos), neg))
    e = questions.select("question_id", "question", "corpus_id", F.posexplode(ids).alias("place", "id"))
    j = e.join(corpus.select("corpus_id", "id", F.col("text").alias("t"), F.lit(True).alias("__has")), ["corpus_id", "id"], "left")
    text = F.when(F.col("__has"), F.coalesce("t", F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("unknown document: "), F.col("id"))))
    rows = j.withColumn("t", text).groupBy("question_id", "question", "corpus_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "t"))).alias("r"))
    out = rows.select("question_id", "question", "corpus_id", F.transform("r", lambda x: x["id"]).alias("doc_id"), F.transform("r", lambda x: x["t"]).alias("doc_text"))
    if instructions is None:
        return out.withColumn("query_instruction", F.lit("")).withColumn("passage_instruction", F.lit(""))
    return out.join(instructions, "corpus_id", "left").fillna("", ["query_instruction", "passage_instruction"])


def flattened(rows: DataFrame) -> DataFrame:
    """(question_id, question, place, doc_id, doc_text): a row for each question and document."""
    z = rows.select("question_id", "question", F.posexplode(F.arrays_zip("doc_id", "doc_text")).alias("place", "z"))
    return z.select("question_id", "question", "place", F.col("z.doc_id").alias("doc_id"), F.col("z.doc_text").alias("doc_text"))


def encoder_sides(rows: DataFrame, query_prefix: str = "", passage_prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Texts of both sides with instruction or prefix, document ids as 63-bit hashes, labels 0 (the positive is first)."""
    pre = lambda inst, fixed, c: F.when(F.col(inst) != "", F.concat_ws(" ", F.col(inst), c)).otherwise(F.concat(F.lit(fixed), c))
    q = rows.select("question_id", pre("query_instruction", query_prefix, F.col("question")).alias("text"), F.lit(0).alias("label"))
    z = rows.select("question_id", "passage_instruction", F.posexplode(F.arrays_zip("doc_id", "doc_text")).alias("place", "z"))
    d = z.select("question_id", "place", pre("passage_instruction", passage_prefix, F.col("z.doc_text")).alias("text"), doc_hash63(F.col("z.doc_id")).alias("doc_hash"))
    return q, d


def pair_texts(rows: DataFrame, template: str = "question:{query} \n \n passage:{passage}") -> DataFrame:
    """(question_id, place, text): question and document in one text."""
    f = flattened(rows)
    a, _, rest = template.partition("{query}")
    b, _, c = rest.partition("{passage}")
    return f.select("question_id", "place", F.concat(F.lit(a), "question", F.lit(b), "doc_text", F.lit(c)).alias("text"))


def squad_rows(df: DataFrame) -> DataFrame:
    """(prompt, answer): context and question, and the first answer."""
    return df.select(F.concat(F.lit("Context: "), "context", F.lit(" Question: "), "question", F.lit(" Answer: ")).alias("prompt"), F.trim(F.get("answers.text", F.lit(0))).alias("answer"))


def completion_rows(df: DataFrame) -> DataFrame:
    """(prompt, answer): a context and the ending that its label names."""
    return df.select(F.col("ctx").alias("prompt"), F.get("endings", F.col("label").cast("int")).alias("answer"))


def pair_rows(df: DataFrame, a: str = "sentence1", b: str = "sentence2", label: str = "label") -> DataFrame:
    return df.select(F.col(a).alias("text_a"), F.col(b).alias("text_b"), F.col(label).cast("int").alias("label"))
