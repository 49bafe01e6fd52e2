"""Blends of datasets, splits, document order and sample indices."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def blend_order(weights: list[float], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(dataset, place in it) of every draw: the dataset that lags its weight most, the first of equals."""
    w = np.asarray(weights, dtype=np.float64)
    taken = np.zeros(len(w))
    who, place = np.empty(size, dtype=np.int32), np.empty(size, dtype=np.int64)
    for i in range(size):
        k = int((w * max(i, 1) - taken).argmax())
        who[i], place[i] = k, taken[k]
        taken[k] += 1
    return who, place


def exhaustive_order(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same until every dataset is used up exactly."""
    total = sum(sizes)
    w = np.array(sizes, dtype=np.float64) / max(total, 1)
    taken = np.zeros(len(w))
    who, place = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int64)
    open_ = np.array(sizes) > 0
    for i in range(total):
        lag = np.where(open_, w * max(i, 1) - taken, -np.inf)
        k = int(lag.argmax())
        who[i], place[i] = k, taken[k]
        taken[k] += 1
        open_[k] = taken[k] < sizes[k]
    return who, place


def blend_table(spark: SparkSession, weights: list[float] | None = None, size: int = 0, sizes: list[int] | None = None) -> DataFrame:
    """(draw, dataset, place) as a table; the recurrence runs in one task and its rows are streamed out."""
    def run(_):
        who, place = exhaustive_order(sizes) if sizes is not None else blend_order(weights, size)
        for i in range(0, len(who), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pd.DataFrame({"draw": np.arange(i, i + len(who[part])), "dataset": who[part], "place": place[part]})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "draw long, dataset int, place long")


def drawn(rows: DataFrame, table: DataFrame, dataset: str, place: str) -> DataFrame:
    """Rows in blend order; a place beyond a dataset's end starts it anew."""
    n = rows.groupBy(dataset).agg(F.count("*").alias("__n"))
    t = table.withColumnRenamed("dataset", dataset).withColumnRenamed("place", "__p").join(F.broadcast(n), dataset).withColumn(place, F.pmod("__p", "__n"))
    return t.join(rows, [dataset, place]).drop("__p", "__n")


def blend_sizes(weights: list[float], targets: list[int], surplus: float = 0.0) -> list[list[int]]:
    """Samples of each dataset for each split: rounded up twice, with a surplus."""
    total = sum(weights)
    return [[math.ceil(math.ceil(n * w / total) * (1 + surplus)) for n in targets] for w in weights]


def read_blend(text: str) -> dict[str, list] | list:
    """A blend file: ["30", "a", ..] or lists by split; 'val', 'dev' and 'valid' are 'validation'."""
    got = json.loads(text)
    if isinstance(got, dict):
        return {{"val": "validation", "valid": "validation", "dev": "validation"}.get(k, k): v for k, v in got.items()}
    if not isinstance(got, list):
        raise ValueError("a blend is a list or lists by split")
    return got


def zipped(flat: list) -> list[tuple[float | None, str]]:
    """Pairs of weight and path from a flat list; plain paths have no weight."""
    def number(x) -> float | None:
        try:
            return float(x)
        except (TypeError, ValueError):
            return None

    if len(flat) % 2 == 0 and flat and all(number(x) is not None for x in flat[::2]):
        return [(number(w), str(p)) for w, p in zip(flat[::2], flat[1::2])]
    return [(None, str(p)) for p in flat]


def split_shares(text: str) -> list[float]:
    """'99,1,0' as three shares of one."""
    v = [float(x) for x in re.findall(r"[.0-9]+", text)]
    v += [0.0] * (3 - len(v))
    if len(v) != 3 or not sum(v) > 0:
        raise ValueError(f"not a split: {text}")
    return [x / sum(v) for x in v]


def split_bounds(a: list[float], b: list[float] | None = None) -> list[tuple[float, float] | None]:
    """Where each split begins and ends; with a second one, only what they share."""
    ends = lambda v: [sum(v[:i]) for i in range(len(v) + 1)]
    x, y = ends(a), ends(b or a)
    both = [(max(x[i], y[i]), min(x[i + 1], y[i + 1])) for i in range(len(a))]
    return [p if p[0] < p[1] else None for p in both]


def split_rows(n: int, bounds: list[tuple[float, float] | None]) -> list[tuple[int, int] | None]:
    """Row ranges [from, to) of n rows."""
    return [None if b is None else (int(round(b[0] * n)), int(round(b[1] * n))) for b in bounds]


def document_index(docs: DataFrame, doc: str, epochs: int, seed: int, separate_last: bool = False) -> DataFrame:
    """(place, epoch, doc): every document once an epoch in a seeded order over all epochs; the last may stand apart."""
    from framewright.operators.relational import ordinal
    from framewright.prep.sampling import seeded

    e = docs.select(doc).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    part = (F.col("epoch") == epochs - 1).cast("int") if separate_last else F.lit(0)
    d = e.withColumn("__part", part).withColumn("__h", seeded(doc, seed, F.col("epoch")))
    return ordinal(d, ["__part", "__h", "epoch", doc], "place").drop("__part", "__h")


def document_offsets(docs: DataFrame, order: str, length: str) -> DataFrame:
    """docs with `start`, the tokens of all documents before; summed in two levels, so no partition holds all of them."""
    d = docs.withColumn("__g", F.floor(F.col(order) / 4096))
    outer = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)  # a row for 4096 documents
    inner = Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("__g").agg(F.sum(length).alias("__s")).select("__g", F.coalesce(F.sum("__s").over(outer), F.lit(0)).alias("__b"))
    return d.join(base, "__g").withColumn("start", (F.coalesce(F.sum(length).over(inner), F.lit(0)) + F.col("__b")).cast("long")).drop("__g", "__b")


def sample_index(docs: DataFrame, order: str, length: str, seq: int, extra: int = 1, drop_last: bool = True) -> DataFrame:
    """(sample, doc, offset): where every sample of seq tokens starts in the row of documents, with the end as a last row.

    docs: order 0, 1, ..; neighbouring samples share `extra` tokens. A start at
    a document's very end belongs to that document if tokens are shared.
    """
    d = document_offsets(docs.select(order, F.col(length).cast("long").alias(length)), order, length)
    total = d.agg(F.coalesce(F.sum(length), F.lit(0))).collect()[0][0]
    n = (total - extra) // seq if drop_last else -(-(total - extra) // seq)
    if n < 0 or total == 0:
        return d.sparkSession.createDataFrame([], "sample long, doc long, offset long")
    # token k * seq starts sample k; it lies in the document that holds token k * seq, or just before it
    first = F.ceil(F.col("start") / seq)
    last = F.least(F.floor((F.col("start") + F.col(length) - 1) / seq), F.lit(n)).cast("long")
    inside = d.where(F.col(length) > 0).withColumn("__k", F.when(first <= last, F.sequence(first.cast("long"), last)).otherwise(F.array().cast("array<long>")))
    out = inside.select(F.explode("__k").alias("sample"), F.col(order).cast("long").alias("doc"), "start", F.col(length).alias("n")).select("sample", "doc", (F.col("sample") * seq - F.col("start")).alias("offset"))
    if not drop_last:
        end = d.where(F.col(length) > 0).orderBy(F.col(order).desc()).limit(1).select(F.lit(n).cast("long").alias("sample"), F.col(order).cast("long").alias("doc"), (F.col(length) - extra).alias("offset"))
        out = out.where(F.col("sample") < n).union(end)
    return out


def token_windows(shards: DataFrame, seq: int, workers: int = 1, tokens: str = "tokens") -> DataFrame:
    """(file, worker, window, input_ids, labels): seq + 1 tokens each, of a worker's equal share of a file; the last has the rest."""
    n = F.size(tokens)
    share = F.floor(n / workers).cast("int")
    w = shards.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))
    a = F.col("worker") * share
    b = F.when(F.col("worker") == workers - 1, n).otherwise(a + share)
    d = w.withColumn("__a", a).withColumn("__b", b).withColumn("__k", F.floor((F.col("__b") - F.col("__a") - 1) / seq).cast("int")).where("__k > 0")
    e = d.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    at = F.col("__a") + F.col("window") * seq
    return e.select("file", "worker", "window", F.slice(tokens, at + 1, seq).alias("input_ids"), F.slice(tokens, at + 2, seq).alias("labels"))


def aligned_windows(tokens: np.ndarray, seq: int, bos: int, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    """Windows of seq + 1 tokens that start at a document start: each goes on at the first one behind the last window's end."""
    hi = len(tokens) if hi is None else hi
    starts = np.flatnonzero(tokens == bos)
    out, at = [], lo
    while True:
        k = np.searchsorted(starts, at)
        at = int(starts[k]) if k < len(starts) and starts[k] < hi else hi
        if at + seq + 1 > hi:
            return out
        out.append((at, at + seq + 1))
        at += seq


def sentence_pairs(lengths: list[int], bounds: list[int], longest: int, short_share: float = 0.1, seed: int = 1, least: int = 2, block: bool = False) -> list[tuple[int, ...]]:
    """(from, to, target length) of runs of sentences in each document [bounds[i], bounds[i + 1]); with block, (from, to, document, block).

    A run ends once it has the target length and two sentences (one in blocks);
    a share of the targets is short, drawn with a seed. The runs are shuffled.
    """
    rng = np.random.default_rng(seed)
    target = lambda: int(rng.integers(2, longest + 1)) if short_share and rng.random() < short_share else longest
    out: list[tuple[int, ...]] = []
    for d, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if b - a < (1 if block else least) or max(lengths[a:b], default=0) > 512:
            continue
        start, have, want, k = a, 0, longest if block else target(), 0
        for i in range(a, b):
            have += lengths[i]
            n = i + 1 - start
            rest = b - i - 1
            if (have >= want and rest > (0 if block else 1) and n >= (1 if block else 2)) or rest == 0:
                out.append((start, i + 1, d, k) if block else (start, i + 1, want))
                start, have, k = i + 1, 0, k + 1
                want = longest if block else target()
    return [out[i] for i in rng.permutation(len(out))]
