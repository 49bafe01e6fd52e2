"""A corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

All columns of documents pass through, whatever else they hold or are called;
the last stage gives (doc_id, n_tokens, ids_sha256, decoded_sha256). A null text
is empty: it isn't toxic unless the prior says so, is no near duplicate, holds
nothing of a benchmark and no personal data, and has no tokens. Rows of one id
are one document: they stay or go together but in the stages that judge a text by
itself (toxicity, decontamination), where each row is judged. A row with a null
id is judged likewise and is no near duplicate. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import bpe, decontaminate, neardup, pii, queries, toxicity
from framewright.session import remove, shared_folder


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more are benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by [KIND]; n_chars follows."""
    return pii.redact(docs, pii.fit(pii.sample_table(spark)), length_col="n_chars")


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the digests of ids and decoded bytes."""
    return bpe.digests(docs, *queries.tokenizer())


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontaminate", _decontaminate),
    ("pii", _redact),
    ("bpe", _encode),
]

#: SQL has no learning, no CRF and no byte-level BPE; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; tables between them lie in the shared checkpoint folder until they are used."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_folder(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    return docs
