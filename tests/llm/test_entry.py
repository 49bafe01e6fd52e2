"""The queries of the subpackage run over the small tables."""

import __spark_entry__
import pytest
from compare import difference

SF = "/root/testdata/sf0.001"


def test_names():
    q = __spark_entry__.queries()
    assert "pipeline" in q and all(any(x.startswith(f"op{n}_") for x in q) for n in range(1, 11))


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_against_sql(spark, name):
    assert difference(__spark_entry__.queries()[name](spark, SF), SF, __spark_entry__.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["op1_bloom_lm", "op2_pii_crf", "op7_bpe_tree", "op8_nnpu_toxicity", "op10_ftrl_quality"])
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
