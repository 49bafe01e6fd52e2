"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic
texts and unlabelled ones, by the risk estimate corrected for the class prior:
prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)).
Where the second part goes below nought, its gradient is turned around, as in
the published method. All unlabelled texts go to one classifier: several that
see a part each depend on how the parts fall.

Both samples are bounded and drawn from the rows of the label table: the texts
marked toxic, and all of its texts as unlabelled ones, their marks unread. The
class prior is over all of its rows, so it is the prior of the unlabelled
sample. Scores are of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import fold_of, map_rows
from framewright.llm.features import distinct, sample, score, segment_sum, sigmoid, trained, word_features
from framewright.llm.textbytes import Powers

BITS = 20
#: Bounds of the training sample, all from labelled rows: confirmed toxic texts, texts taken as unlabelled, distinct features of each kind.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 1500, 6000, 6_000_000
#: Occurrences that a training step handles at once.
CHUNK = 1 << 19
#: Features seen in fewer sampled texts have no weight: a share of the texts, within bounds; the penalty is larger for small samples.
LEAST_SHARE, LEAST_TEXTS = 400, (3, 8)
L1, SMALL_L1, SMALL = 2e-4, 1e-3, 1000


@dataclass
class Model:
    """log-odds = bias + sum of the weights of a text's distinct features."""

    weights: np.ndarray
    bias: float

    def probability(self, bounds: np.ndarray, feats: np.ndarray, _counts: np.ndarray) -> np.ndarray:
        return sigmoid(self.bias + segment_sum(self.weights[feats], bounds))


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, steps: int = 120, rate: float = 0.12, l1: float | None = None, beta: float = 0.0, least: int | None = None) -> Model:
    """Full-batch proximal Adam on the non-negative risk with the logistic loss."""
    size = 1 << bits
    n_texts = len(positive) + len(unlabelled)
    least = least or min(max(n_texts // LEAST_SHARE, LEAST_TEXTS[0]), LEAST_TEXTS[1])
    l1 = l1 or (L1 if n_texts >= SMALL else SMALL_L1)
    if not positive or not unlabelled:
        return Model(np.zeros(size, dtype=np.float32), float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))))
    n_p, n_u = len(positive), len(unlabelled)
    seen = np.zeros(size, dtype=np.int32)
    for texts in (positive, unlabelled):
        for x in texts:
            seen[x] += 1  # a text's features are distinct
    used = np.flatnonzero(seen >= least)
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    # the occurrences of all texts in one array; nothing else of their length is held
    cols, ends = np.empty(int(seen[used].sum()), dtype=np.int32), [0]
    for texts in (positive, unlabelled):
        for x in texts:
            c = place[x]
            c = c[c >= 0]
            cols[ends[-1] : ends[-1] + len(c)] = c
            ends.append(ends[-1] + len(c))
    del positive, unlabelled, texts, seen, place
    bounds = np.array(ends)
    cuts = [0]
    while cuts[-1] < n_p + n_u:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + CHUNK, "right")) - 1))
    parts = [(lo, hi, cols[bounds[lo] : bounds[hi]], np.diff(bounds[lo : hi + 1])) for lo, hi in zip(cuts, cuts[1:])]

    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.concatenate([segment_sum(w[c], bounds[lo : hi + 1] - bounds[lo]) for lo, hi, c, _ in parts]) + b
        p = sigmoid(z)
        # loss as 1: log(1 + e^-z), slope p - 1; loss as 0: log(1 + e^z), slope p
        negative = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
        slope = np.concatenate([-prior * p[:n_p] / n_p, p[n_p:] / n_u])
        if negative >= -beta:
            slope[:n_p] += prior * (p[:n_p] - 1) / n_p
        else:
            slope = -slope
        g = np.append(sum(np.bincount(c, weights=np.repeat(slope[lo:hi], n), minlength=len(used)) for lo, hi, c, n in parts), slope.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        scale = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        move = scale * m / (1 - 0.9**step)
        w -= move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * scale[:-1], 0)
        b -= move[-1]
    full = np.zeros(size, dtype=np.float32)
    full[used] = w
    return Model(full, float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held: tuple[int, int] = (5, 0), bits: int = BITS) -> Model:
    """A model from rows outside the held-out fold.

    Confirmed toxic texts are those with label 1; all texts that the table labels
    serve as unlabelled, whatever their labels. The class prior is the share of
    1 among the labels. Ids labelled twice count as toxic if one label says so.
    Without positives, or without labels, every text gets the prior (0.001 if there are no labels).
    """
    n, out = held
    lab = labels.select(labels[id_col].alias("__lid"), labels[label_col].cast("int").alias("y")).where(F.col("__lid").isNotNull() & F.col("y").isNotNull() & (fold_of("__lid", n) != out)).groupBy("__lid").agg(F.max("y").alias("y"))
    share = lab.agg(F.avg("y")).collect()[0][0]
    prior = min(max(share if share is not None else 0.0, 1e-3), 0.5)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where(fold_of("doc_id", n) != out)
    extract = word_features(bits)

    def chosen(of: DataFrame, most: int) -> DataFrame:
        top = F.broadcast(of.orderBy(F.xxhash64("__lid"), "__lid").limit(most))  # the bound on the sample bounds the ids
        return sample(own.join(top, own.doc_id == top["__lid"]).select("doc_id", "text", F.lit(1).alias("y")), most, extract, bits)

    def train(texts: list) -> tuple[np.ndarray, float]:
        for k, t in enumerate(texts):
            texts[k] = [f for _, f, _ in t]
        model = train_nnpu(texts.pop(0), texts.pop(0), prior, bits)  # nothing here holds the samples
        return model.weights, model.bias

    return Model(*trained([chosen(lab.where("y = 1"), MAX_POSITIVE), chosen(lab.drop("y"), MAX_UNLABELLED)], MAX_FEATURES, train))


def report(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (5, 0), bits: int = BITS) -> DataFrame:
    """(id, held_out, score, predicted); a null text is empty and gets the bias's probability.

    The weights have a fixed size and are broadcast. Ids are read for held_out
    only. Repeated rows give repeated rows, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fold = f"pmod(crc32(coalesce(cast(`{id_col}` as string), '')), {held[0]}) = {held[1]}"
    found = score(docs, word_features(bits), bits, lambda *a: shared.value.probability(*a), {"held_out": (fold, "boolean")}, id_col, text_col)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs, all columns, without texts that score 0.5 or more."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    extract = word_features(bits)

    def setup():
        powers = Powers()

        def work(b: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            p = shared.value.probability(*distinct(*extract(texts, powers), bits))
            return b.filter(pa.array(p < 0.5))

        return work

    return map_rows(docs, text_col, setup)
