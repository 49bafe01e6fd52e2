"""Held-out accuracy of the classifiers, and the pipeline stage by stage."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import decontaminate, neardup, pii, quality, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def accuracy(scored, labels, col):
    rows = scored.where("held_out").join(labels.where(f"{col} is not null"), "doc_id").select("predicted", col, "score").collect()
    pos, neg = [r.score for r in rows if r[col] == 1], [r.score for r in rows if r[col] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) if pos and neg else None
    return np.mean([r.predicted == r[col] for r in rows]), auc


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    got = toxicity.report(docs, toxicity.fit(docs, labels))
    rows = got.collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    acc, auc = accuracy(got, labels, "toxic")
    assert acc > 0.97 and auc > 0.95


def test_toxicity_with_few_confirmed_texts(spark):
    """At sf0.01 there are 45 confirmed toxic texts; no clean one is rejected for it."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.report(docs, toxicity.fit(docs, labels))
    acc, auc = accuracy(got, labels, "toxic")
    assert acc > 0.9 and auc > 0.9
    assert got.join(labels.where("toxic = 0"), "doc_id").where("predicted = 1").count() <= 3


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.report(docs, quality.fit(docs, labels))
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())
    acc, auc = accuracy(got, labels, "quality")
    assert acc > 0.8 and auc > 0.85


def test_classifiers_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good text here", 0.5), (2, None, 0.5), (None, "", 0.5), (1, "good text here", 0.5), (3, "x " * 50000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    few = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, None), (3, 0, 0)], "doc_id long, toxic int, quality int")
    for m in (toxicity, quality):
        for labels in (none, few):
            model = m.fit(docs, labels)
            assert len(m.report(docs, model).collect()) == 5 and m.report(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, toxicity.fit(docs, none)).columns == docs.columns


def test_nnpu_finds_what_marks_the_positives():
    r = random.Random(1)
    text = lambda bad: np.unique(np.array([r.randrange(1000) for _ in range(40)] + ([2000 + r.randrange(5)] * 3 if bad else [])))
    model = toxicity.train_nnpu([text(True) for _ in range(60)], [text(i % 10 == 0) for i in range(600)], 0.1, bits=12, least=3)
    assert model.weights[2000:2005].min() > 0.5 and np.abs(model.weights[:1000]).mean() < 0.3


def plain_nnpu(positive, unlabelled, prior, size, steps, rate, l1, least):
    """The same training over a dense matrix, one text and one feature at a time."""
    texts = [*positive, *unlabelled]
    x = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for f in t:
            x[i, f] = 1
    x[:, x.sum(axis=0) < least] = 0
    n_p, n_u = len(positive), len(unlabelled)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = np.zeros(size + 1)
        losses, slopes = [], []
        for i in range(len(texts)):
            z = w[-1] + sum(w[f] for f in range(size) if x[i, f])
            p = 1 / (1 + np.exp(-z))
            losses.append(np.log1p(np.exp(z)))
            slopes.append((p - 1, p))
        unsure = np.mean(losses[n_p:]) - prior * np.mean(losses[:n_p])
        for i in range(len(texts)):
            row = np.append(x[i], 1)
            part = -prior / n_p * slopes[i][1] if i < n_p else slopes[i][1] / n_u
            if unsure >= 0:
                g += row * (part + (prior / n_p * slopes[i][0] if i < n_p else 0))
            else:
                g -= row * part
        for f in range(size + 1):
            m[f] += 0.1 * (g[f] - m[f])
            v[f] += 0.001 * (g[f] ** 2 - v[f])
            scale = rate / (np.sqrt(v[f] / (1 - 0.999**step)) + 1e-6)
            w[f] -= scale * m[f] / (1 - 0.9**step)
            if f < size:
                w[f] = np.sign(w[f]) * max(abs(w[f]) - l1 * scale, 0)
    return w[:-1], w[-1]


def test_nnpu_against_a_plain_implementation():
    r = random.Random(4)
    text = lambda bad: np.unique(np.array([r.randrange(24) for _ in range(6)] + [24 + r.randrange(4)] * bad))
    pos, unl = [text(True) for _ in range(8)], [text(i % 5 == 0) for i in range(30)]
    got = toxicity.train_nnpu(pos, unl, 0.2, bits=5, steps=15, rate=0.1, l1=1e-3, least=2)
    weights, bias = plain_nnpu(pos, unl, 0.2, 32, 15, 0.1, 1e-3, 2)
    assert np.allclose(got.weights, weights, atol=1e-5) and abs(got.bias - bias) < 1e-6
    b, f, c = np.array([0, len(pos[0])]), pos[0], np.ones(len(pos[0]))
    assert np.allclose(got.probability(b, f, c), 1 / (1 + np.exp(-bias - sum(weights[i] for i in f))), atol=1e-5)


def test_ftrl_against_a_plain_implementation():
    r = random.Random(5)
    rows = [(i % 2, np.array(sorted(r.sample(range(32), 5))), np.array([r.randint(1, 4) for _ in range(5)])) for i in range(40)]
    alpha, beta, l1, l2, size = 0.5, 1.0, 0.02, 0.2, 32
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if abs(z[i]) <= l1 and i < size:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for y, f, c in rows:
            x = {int(i): 1 + np.log(k) for i, k in zip(f, c)}
            norm = sum(v * v for v in x.values()) ** 0.5
            x = {i: v / norm for i, v in x.items()} | {size: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    got = quality.train_ftrl(rows, bits=5)
    assert np.allclose(got.weights, [weight(i) for i in range(size)], atol=1e-6) and abs(got.bias - weight(size)) < 1e-9
    moved = quality.shifted(got, [y for y, *_ in rows], 0.9)
    assert abs(moved.bias - got.bias - np.log(9)) < 1e-9 and quality.shifted(got, [1, 1], 0.9) is got and quality.shifted(got, [], None) is got


def test_ties_repeated_labels_and_filters(spark):
    docs = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'BAD!!! junk###'} text {i % 7}", i) for i in range(60)] + [(60, None, 1), (60, None, 1)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] * 2 + [(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    good = quality.keep_good(docs, quality.fit(docs, labels))
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()} - {60}
    assert len([i for i in kept if i % 2]) >= 29 and len([i for i in kept if i % 2 == 0]) <= 1
    assert quality.keep_good(docs.limit(0), quality.fit(docs, labels)).count() == 0
    half = quality.Model(np.zeros(1 << quality.BITS, dtype=np.float32), 0.0)  # every score is 0.5
    assert {(r.score, r.predicted) for r in quality.report(docs, half).collect()} == {(0.5, 1)} and quality.keep_good(docs, half).count() == 62
    even = toxicity.Model(np.zeros(1 << toxicity.BITS, dtype=np.float32), 0.0)
    assert {(r.score, r.predicted) for r in toxicity.report(docs, even).collect()} == {(0.5, 1)} and toxicity.drop_toxic(docs, even).count() == 0


@pytest.fixture
def odd_corpus(spark, tmp_path):
    """Nulls everywhere, repeats, an empty and a very long text, copies, a benchmark passage, and columns that clash with those of the stages."""
    base = " ".join(f"word{i}" for i in range(60))
    leak = " ".join(f"quiz{i}" for i in range(20))
    rows = [(1, base, "en", "s", None, 0.1), (2, base.upper(), None, "s", 3, 0.2), (3, base + " more", "en", None, 4, 0.3), (4, None, "en", "s", None, None), (5, "", "en", "s", 0, 0.5), (None, base, "en", "s", 1, 0.6), (6, "see " + leak, "en", "s", 1, 0.7), (7, "mail a@b.co " * 30000, "en", "s", 1, 0.8), (8, "short one", "en", "s", 1, 0.9), (8, "short one", "en", "s", 1, 0.9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double").withColumn("kept", F.lit("x")).withColumn("__id", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (None, "short one"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, odd_corpus):
    got = sorted((str(r.doc_id), r.n_tokens > 0) for r in corpus_pipeline.run(spark, odd_corpus).collect())
    assert got == [("1", True), ("4", False), ("5", False), ("7", True), ("8", True), ("8", True), ("None", True)]
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_corpus)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), odd_corpus).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), odd_corpus).count() == 0
    # a model that rejects one word drops its texts and no others
    bad = toxicity.Model(np.zeros(1 << toxicity.BITS, dtype=np.float32), -1.0)
    b, f = toxicity.word_features(toxicity.BITS)(pa.array(["more"]), toxicity.Powers())
    bad.weights[f] = 5
    assert sorted(str(r.doc_id) for r in toxicity.drop_toxic(docs, bad).collect()) == ["1", "2", "4", "5", "6", "7", "8", "8", "None"]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "pii", "bpe"]
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in toxicity.report(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    kept = docs.where(~docs.doc_id.isin(sorted(bad)) if bad else "true")
    first = {r.doc_id for r in neardup.near_duplicates(kept).where("kept").collect()}
    kept = kept.where(kept.doc_id.isin(sorted(first)))
    dirty = {r.doc_id for r in decontaminate.report(kept, bench).where("contaminated").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == first - dirty and bad and dirty
    model = pii.fit(pii.sample_table(spark))
    clean = {r.doc_id: r.text for r in pii.redact(kept, model, length_col="n_chars").collect()}
    import hashlib

    assert all(got[i].decoded_sha256 == hashlib.sha256((clean[i] or "").encode()).hexdigest() for i in got)
