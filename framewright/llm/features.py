"""Hashed features of whole texts and bounded training samples, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import map_text
from framewright.llm.textbytes import ALNUM, NON_SPACE, Powers, buffer_of, counts_by_doc, mix, words

#: fn(texts, powers) -> (bounds, feature of every occurrence)
Extractor = Callable[[pa.Array, Powers], tuple[np.ndarray, np.ndarray]]


def word_features(bits: int, prefixes: tuple[int, ...] = (4, 5, 6)) -> Extractor:
    """Buckets of lower-case words of letters and digits, and of their first bytes (for inflected forms)."""

    def run(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        raw, offs = buffer_of(texts)
        s, e, h = words(raw, offs, ALNUM, powers)
        out = [h]
        if len(s):
            head = np.zeros(len(s), dtype=np.uint64)
            size = e - s
            for j in range(max(prefixes)):
                c = raw[np.minimum(s + j, len(raw) - 1)]
                c = np.where(size > j, c + 32 * ((c >= 65) & (c <= 90)), 0).astype(np.uint64)
                head = (head << np.uint64(8)) | c
                if j + 1 in prefixes:
                    out.append(mix(head + np.uint64(j)))
        f = np.stack(out, axis=1).ravel() >> np.uint64(64 - bits)
        return counts_by_doc(s, offs) * len(out) if len(s) else counts_by_doc(s, offs), f.astype(np.int64)

    return run


def ngram_features(bits: int) -> Extractor:
    """Buckets of words as written, of their neighbours' pairs, and of their endings.

    A word's ending is what follows its last letter or digit, so that made-up
    words with the same junk after them meet in one n-gram.
    """
    letters = ALNUM.copy()
    letters[65:91] = True

    def run(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        raw, offs = buffer_of(texts)
        s, e, h = words(raw, offs, NON_SPACE, powers, lower=False)
        bounds = counts_by_doc(s, offs)
        n = len(h)
        if not n:
            return bounds, np.zeros(0, dtype=np.int64)
        # the last letter or digit before each word's end
        at = np.where(letters[raw], np.arange(len(raw)), -1)
        np.maximum.accumulate(at, out=at)
        core = np.maximum(at[e - 1] + 1, s)
        k = np.minimum(e - core, 4)
        tail = np.zeros(n, dtype=np.uint64)
        for j in range(4):
            on = k > j
            tail[on] = mix(tail[on] * np.uint64(0x9E3779B97F4A7C15) + raw[core[on] + j] + np.uint64(1))
        first = raw[s]
        case = np.where((first >= 65) & (first <= 90), 1, np.where((first >= 48) & (first <= 57), 2, np.where(letters[first], 0, 3))).astype(np.uint64)
        last = raw[np.maximum(core - 1, s)]
        case = case * np.uint64(3) + np.where((last >= 65) & (last <= 90), 1, np.where((last >= 48) & (last <= 57), 2, 0)).astype(np.uint64)
        size = np.minimum(e - s, 24).astype(np.uint64) // np.uint64(4)
        form = mix(tail * np.uint64(31) + case * np.uint64(8) + size + np.uint64(7))
        two = np.zeros(n, dtype=np.uint64)
        forms = np.zeros(n, dtype=np.uint64)
        two[1:] = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
        forms[1:] = mix(form[:-1] * np.uint64(0xA0761D6478BD642F) + form[1:])
        start = bounds[:-1][np.diff(bounds) > 0]
        two[start], forms[start] = mix(h[start] + np.uint64(1)), mix(form[start] + np.uint64(1))
        out = np.stack([h, form, two, forms], axis=1).ravel()
        return bounds * 4, (out >> np.uint64(64 - bits)).astype(np.int64)

    return run


def distinct(bounds: np.ndarray, feats: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text with their counts: (bounds, features, counts)."""
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    key = np.sort((doc << bits) | feats)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return np.searchsorted(key >> bits, np.arange(len(bounds))), key & ((1 << bits) - 1), np.diff(np.append(at, len(feats)))


SAMPLED = "o long, y int, n long, f binary, c binary"


def sample(rows: DataFrame, max_rows: int, extract: Extractor, bits: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "y") -> DataFrame:
    """(o, y, n, f, c) of at most max_rows rows, whole texts: order, label, number of distinct features, they and their counts.

    The rows with the smallest hash of id and label are taken, so the sample is
    the same on every run.
    """
    hashed = rows.select(F.xxhash64(rows[id_col], rows[label_col], F.lit(11)).alias("__o"), rows[id_col].alias("__id"), rows[text_col].alias("__text"), rows[label_col].cast("int").alias("__y"))
    top = hashed.select("__o").orderBy("__o").limit(max_rows).collect()
    if not top:
        return rows.sparkSession.createDataFrame([], SAMPLED)
    chosen = hashed.where(F.col("__o") <= F.lit(top[-1][0]))

    def setup():
        powers = Powers()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            bounds, f, c = distinct(*extract(b.column("__text"), powers), bits)
            cut = lambda a, i: a[bounds[i] : bounds[i + 1]].astype(np.int32).tobytes()
            n = range(len(bounds) - 1)
            return pa.RecordBatch.from_arrays([b.column("__o"), b.column("__y"), pa.array(np.diff(bounds), pa.int64()), pa.array([cut(f, i) for i in n], pa.binary()), pa.array([cut(c, i) for i in n], pa.binary())], names=["o", "y", "n", "f", "c"])

        return work

    return map_text(chosen, {x: x for x in ("__o", "__text", "__y")}, "__text", setup, SAMPLED).orderBy("o").limit(max_rows)


#: A sampled text: label, distinct features, their counts.
Text = tuple[int, np.ndarray, np.ndarray]


def trained(samples: list[DataFrame], max_features: int, train: Callable[[list[list[Text]]], tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """train() of bounded samples, in one task: the driver gets weights and bias only.

    A sample ends early where it would hold more than max_features distinct features in all.
    """
    whole = None
    for k, s in enumerate(samples):
        s = s.withColumn("k", F.lit(k))
        whole = s if whole is None else whole.union(s)
    kinds = len(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[list] = [[] for _ in range(kinds)]
        for b in batches:
            for o, y, _, f, c, k in zip(*[col.to_pylist() for col in b.columns]):
                texts[k].append((o, y, np.frombuffer(f, dtype=np.int32), np.frombuffer(c, dtype=np.int32)))
        for k in range(kinds):
            texts[k].sort(key=lambda t: t[0])
            sizes = np.cumsum([len(f) for _, _, f, _ in texts[k]])
            n = max(1, int(np.searchsorted(sizes, max_features, "right")))
            texts[k] = [t[1:] for t in texts[k][:n]]
        weights, bias = train(texts)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    r = whole.coalesce(1).mapInArrow(run, "weights binary, bias double").collect()[0]
    return np.frombuffer(r.weights, dtype=np.float32), r.bias


def score(docs: DataFrame, extract: Extractor, bits: int, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], extra: dict[str, tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, extra columns, score): weigh(bounds, features, counts) gives each text's probability.

    extra: output name -> (expression over docs, type).
    """
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), *[F.expr(e).alias(n) for n, (e, _) in extra.items()])

    def setup():
        powers = Powers()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            p = weigh(*distinct(*extract(b.column("__text"), powers), bits))
            return pa.RecordBatch.from_arrays([b.column("__id"), *[b.column(n) for n in extra], pa.array(p, pa.float64())], names=[id_col, *extra, "score"])

        return work

    types = "".join(f", `{n}` {t}" for n, (_, t) in extra.items())
    return map_text(own, {c: c for c in own.columns}, "__text", setup, f"`{id_col}` {kind}{types}, score double")


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
