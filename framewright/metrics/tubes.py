"""Scores of predicted tubes against annotated ones.

Two dialects: the main one counts closed frame spans and passes thresholds at
equality; the official one measures half-open spans and must exceed them.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import box, interval
from framewright.functions.lazy import arrow_function

LABELS = ("very_easy", "easy", "medium", "hard", "very_hard")
MEANS = ("m_tIoU", "m_vIoU", "vIoU@0.3", "vIoU@0.5")


def assignment(scores: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of row and column with the greatest sum; among equals the lowest columns of the first rows."""
    rows, cols = len(scores), len(scores[0]) if len(scores) else 0
    if not rows or not cols:
        return []
    n = max(rows, cols)
    at = lambda i, j: float(scores[i][j]) if i < rows and j < cols else 0.0
    return [(i, j) for i, j in enumerate(_by_subsets(n, at) if n <= 13 else _by_prices(n, at)) if i < rows and j < cols]


def _by_subsets(n: int, at) -> list[int]:
    @lru_cache(maxsize=None)
    def best(i: int, used: int) -> tuple[float, int]:
        if i == n:
            return 0.0, -1
        top, col = -1.0, -1
        for j in range(n):
            if not used >> j & 1:
                s = at(i, j) + best(i + 1, used | 1 << j)[0]
                if s > top:
                    top, col = s, j
        return top, col

    out, used = [], 0
    for i in range(n):
        j = best(i, used)[1]
        out.append(j)
        used |= 1 << j
    return out


def _by_prices(n: int, at) -> list[int]:
    """Shortest augmenting paths with potentials: cubic, for many targets."""
    inf = float("inf")
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, seen = [inf] * (n + 1), [False] * (n + 1)
        while True:
            seen[j0] = True
            i0, delta, j1 = owner[j0], inf, 0
            for j in range(1, n + 1):
                if not seen[j]:
                    c = -at(i0 - 1, j - 1) - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if seen[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


@arrow_function("array<struct<g: int, p: int>>")
def assign(scores: pd.Series) -> pd.Series:
    """The small matrices of all samples of a batch."""
    return scores.map(lambda m: [{"g": i, "p": j} for i, j in assignment([list(r) for r in m])] if m is not None else [])


def pair_scores(gt: Column, pred: Column) -> Column:
    """struct(tiou, siou, viou) of two tracks (description, s, e, boxes)."""
    return F.struct(interval.tiou_closed(gt["s"], gt["e"], pred["s"], pred["e"]).alias("tIoU"), box.tube_siou(gt["boxes"], pred["boxes"]).alias("sIoU"), box.tube_viou(gt["boxes"], pred["boxes"]).alias("vIoU"))


def score(samples: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """samples with m_tIoU, m_vIoU, vIoU@0.3, vIoU@0.5, matches and counts; single pairs also have tIoU, sIoU and vIoU.

    gt and pred are arrays of tracks. Sums run over the best assignment by vIoU
    and are divided by the larger count, so missed and extra tracks count as 0;
    no tracks on both sides score 0.
    """
    none = F.array().cast(samples.schema[gt].dataType)
    g, p = F.coalesce(F.col(gt), none), F.coalesce(F.col(pred), none)
    table = F.transform(g, lambda a: F.transform(p, lambda b: pair_scores(a, b)))
    d = samples.withColumn("__t", table)
    d = d.withColumn("__m", assign(F.transform("__t", lambda r: F.transform(r, lambda x: x["vIoU"]))))
    total = lambda f: F.aggregate("__m", F.lit(0.0), lambda s, m: s + F.get(F.get(F.col("__t"), m["g"]), m["p"])[f])
    n = F.greatest(F.size(g), F.size(p), F.lit(1))
    one = (F.size(g) == 1) & (F.size(p) == 1)
    out = d.withColumn("m_tIoU", total("tIoU") / n).withColumn("m_vIoU", total("vIoU") / n)
    out = out.withColumn("vIoU@0.3", (F.col("m_vIoU") >= 0.3).cast("double")).withColumn("vIoU@0.5", (F.col("m_vIoU") >= 0.5).cast("double"))
    detail = F.transform("__m", lambda m: F.struct(m["g"].alias("gt_index"), m["p"].alias("pred_index"), F.get(F.get(F.col("__t"), m["g"]), m["p"])["tIoU"].alias("tIoU"), F.get(F.get(F.col("__t"), m["g"]), m["p"])["vIoU"].alias("vIoU"), F.get(g, m["g"])["description"].alias("gt_description"), F.get(p, m["p"])["description"].alias("pred_description")))
    out = out.withColumn("matches", detail).withColumn("match_count", F.size("__m")).withColumn("gt_count", F.size(g)).withColumn("pred_count", F.size(p))
    for f in ("tIoU", "sIoU", "vIoU"):
        out = out.withColumn(f, F.when(one, F.get(F.get(F.col("__t"), F.lit(0)), F.lit(0))[f]))
    return out.drop("__t", "__m")


def temporal_score(samples: DataFrame, gs: str, ge: str, ps: str, pe: str) -> DataFrame:
    """tIoU with its thresholds, for answers that hold a span only."""
    t = interval.tiou_closed(F.col(gs), F.col(ge), F.col(ps), F.col(pe))
    return samples.withColumn("tIoU", t).withColumn("m_tIoU", F.col("tIoU")).withColumn("tIoU@0.3", (F.col("tIoU") >= 0.3).cast("double")).withColumn("tIoU@0.5", (F.col("tIoU") >= 0.5).cast("double"))


def means(results: DataFrame, by: str | None = None, metrics: tuple[str, ...] = MEANS, weight: str | None = None) -> DataFrame:
    """(group, num_samples, metrics): 'overall' and a row for each group that occurs; zeros over nothing.

    weight: a column that says how many samples a row stands for.
    """
    if weight is None:
        avg = [F.coalesce(F.avg(f"`{m}`"), F.lit(0.0)).alias(m) for m in metrics]
        count = F.count("*")
    else:
        known = lambda m: F.sum(F.when(F.col(f"`{m}`").isNotNull(), F.col(weight)))
        avg = [F.coalesce(F.sum(F.col(f"`{m}`") * F.col(weight)) / F.nullif(known(m), F.lit(0)), F.lit(0.0)).alias(m) for m in metrics]
        count = F.coalesce(F.sum(weight), F.lit(0).cast("long"))
    overall = results.agg(count.alias("num_samples"), *avg).select(F.lit("overall").alias("group"), "num_samples", *[f"`{m}`" for m in metrics])
    if by is None:
        return overall
    each = results.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("group")).agg(count.alias("num_samples"), *avg)
    return overall.unionByName(each)


def means_by_label(results: DataFrame, label: str = "difficulty_bucket", metrics: tuple[str, ...] = MEANS) -> DataFrame:
    """means() with __order: overall first, then labels from easy to hard; other labels are left out."""
    order = F.create_map(*[F.lit(x) for i, n in enumerate(("overall", *LABELS)) for x in (n, i)])
    return means(results, label, metrics).withColumn("__order", F.try_element_at(order, F.col("group"))).where("__order is not null")


def means_by_question(results: DataFrame, qtype: str = "qtype", metrics: tuple[str, ...] = MEANS) -> DataFrame:
    """overall, declarative and interrogative."""
    kind = F.when(F.col(qtype) == "declar", "declarative").otherwise("interrogative")
    return means(results.withColumn("__kind", kind), "__kind", metrics)


def means_by_thirds(results: DataFrame, difficulty: str = "difficulty_score", metrics: tuple[str, ...] = MEANS) -> DataFrame:
    """easy below 1/3, medium below 2/3, hard above; a class without samples has zeros."""
    third = F.when(F.col(difficulty) < 1 / 3, "easy").when(F.col(difficulty) < 2 / 3, "medium").otherwise("hard")
    found = results.withColumn("group", third).groupBy("group").agg(F.count("*").alias("num_samples"), *[F.avg(f"`{m}`").alias(m) for m in metrics])
    spark = results.sparkSession
    every = spark.createDataFrame([("easy", 0), ("medium", 1), ("hard", 2)], "group string, __order int")
    zero = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c)
    return every.join(found, "group", "left").select("group", "__order", zero("num_samples"), *[zero(m) for m in metrics])


def official(samples: DataFrame, gs: str, ge: str, ps: str, pe: str, gt: str, pred: str, missing: str = "error", thresholds: tuple[float, ...] = (0.3, 0.5)) -> DataFrame:
    """The half-open dialect: tiou, viou and gt_viou of one tube a video, with strict thresholds.

    viou sums box IoU over annotated frames inside both spans, by the length of
    their hull; gt_viou is the mean over all annotated frames. A frame without
    a prediction is an error, or skipped.
    """
    if missing not in ("error", "skip"):
        raise ValueError("missing is 'error' or 'skip'")
    g, p = F.col(gt), F.col(pred)
    lo, hi = F.greatest(F.col(gs), F.col(ps)), F.least(F.col(ge), F.col(pe))
    hull = F.greatest(F.greatest(F.col(ge), F.col(pe)) - F.least(F.col(gs), F.col(ps)), F.lit(1))
    keys = F.map_keys(g)
    gone = F.raise_error(F.concat(F.lit("no prediction for frame of "), F.col(gs).cast("string"))) if missing == "error" else F.lit(0.0)
    one = lambda f: F.when(F.map_contains_key(p, f), box.box_iou(F.try_element_at(g, f), F.try_element_at(p, f))).otherwise(gone)
    total = lambda fs: F.aggregate(fs, F.lit(0.0), lambda s, f: s + one(f))
    out = samples.withColumn("tiou", interval.tiou_half_open(F.col(gs), F.col(ge), F.col(ps), F.col(pe)))
    out = out.withColumn("viou", total(F.filter(keys, lambda f: (f >= lo) & (f < hi))) / hull).withColumn("gt_viou", total(keys) / F.greatest(F.size(keys), F.lit(1)))
    for t in thresholds:
        out = out.withColumn(f"viou@{t}", (F.col("viou") > t).cast("int")).withColumn(f"gt_viou@{t}", (F.col("gt_viou") > t).cast("int"))
    return out


def official_means(results: DataFrame, qtype: str = "qtype", thresholds: tuple[float, ...] = (0.3, 0.5)) -> DataFrame:
    """Means of the official metrics for each question type."""
    names = ["tiou", "viou", "gt_viou", *[f"{p}viou@{t}" for t in thresholds for p in ("", "gt_")]]
    return results.groupBy(qtype).agg(F.count("*").alias("num_samples"), *[F.avg(f"`{n}`").alias(n) for n in names])
