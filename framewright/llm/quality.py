"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal updates.

Features are words as written, their pairs, and the same of word forms
(ending, case, length); a text is the L2-normalised vector of their
log counts. Scoring is a sparse dot product with weights that are broadcast
(their number is fixed by BITS).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import fold_of, map_rows
from framewright.llm.features import distinct, ngram_features, sample, score, segment_sum, sigmoid, trained
from framewright.llm.textbytes import Powers

BITS = 20
#: Bounds of the training sample: labelled texts and their distinct features.
MAX_ROWS, MAX_FEATURES = 8000, 16_000_000


def values(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def probability(self, bounds: np.ndarray, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = values(counts)
        norm = np.sqrt(np.maximum(segment_sum(x * x, bounds), 1e-12))
        return sigmoid(self.bias + segment_sum(self.weights[feats] * x, bounds) / norm)


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2) -> Model:
    """Follow-the-regularised-leader, one text at a time; the bias is a feature of weight 1.

    Without rows all scores are 0.5.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def leader(i: np.ndarray) -> np.ndarray:
        a = z[i]
        w = -(a - np.sign(a) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where((np.abs(a) <= l1) & (i < size), 0.0, w)

    ready = []
    for y, f, c in rows:
        x = values(c)
        x /= np.sqrt(max(float((x * x).sum()), 1e-12))
        ready.append((float(y), np.append(f, size).astype(np.int32), np.append(x, 1.0)))
    for _ in range(epochs):
        for y, i, x in ready:
            w = leader(i)
            g = (float(sigmoid(np.array(w @ x))) - y) * x
            old = n[i]
            new = old + g * g
            z[i] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[i] = new
    w = leader(np.arange(size + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: tuple[int, int] = (3, 1), bits: int = BITS) -> Model:
    """A model from at most MAX_ROWS labelled rows outside the held-out fold (the smallest hashes).

    Ids with several labels take the smallest; labels that are null don't count.
    Both classes have half of the sample where there are enough of both; the
    bias is then set back to the classes' true shares.
    """
    n, out = held
    lab = labels.select(labels[id_col].alias("__lid"), labels[label_col].cast("int").alias("y")).where(F.col("y").isNotNull() & (fold_of("__lid", n) != out)).groupBy("__lid").agg(F.min("y").alias("y"))
    top = [lab.where(F.col("y") == k).orderBy(F.xxhash64("__lid"), "__lid").limit(MAX_ROWS // 2) for k in (0, 1)]
    top = F.broadcast(top[0].unionByName(top[1]))  # MAX_ROWS ids at most
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rows = sample(own.join(top, own.doc_id == top["__lid"]).select("doc_id", "text", "y"), MAX_ROWS, ngram_features(bits), bits)
    share = lab.where("y in (0, 1)").agg(F.avg("y")).collect()[0][0]

    def train(texts: list) -> tuple[np.ndarray, float]:
        model = shifted(train_ftrl(texts[0], bits), [y for y, *_ in texts[0]], share)
        return model.weights, model.bias

    return Model(*trained([rows], MAX_FEATURES, train))


def shifted(model: Model, labels: list[int], share: float | None) -> Model:
    """The model with its bias moved from the sample's share of 1 to the true one."""
    odds = lambda p: float(np.log(p / (1 - p)))
    seen = float(np.mean(labels)) if labels else 0.0
    if share is None or not 0 < seen < 1 or not 0 < share < 1:
        return model
    return Model(model.weights, model.bias + odds(share) - odds(seen))


def report(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (3, 1), bits: int = BITS) -> DataFrame:
    """(id, held_out, score, predicted); a null text is empty and gets the bias's probability.

    Ids are read for held_out only. Repeated rows give repeated rows, an empty
    table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fold = f"pmod(crc32(coalesce(cast(`{id_col}` as string), '')), {held[0]}) = {held[1]}"
    found = score(docs, ngram_features(bits), bits, lambda *a: shared.value.probability(*a), {"held_out": (fold, "boolean")}, id_col, text_col)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs, all columns, whose texts score 0.5 or more."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    extract = ngram_features(bits)

    def setup():
        powers = Powers()

        def work(b: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            return b.filter(pa.array(shared.value.probability(*distinct(*extract(texts, powers), bits)) >= 0.5))

        return work

    return map_rows(docs, text_col, setup)
