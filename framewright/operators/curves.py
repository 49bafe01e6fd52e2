"""Ranks and precision-recall curves over any number of rows of a key.

A key's rows are cut into buckets of its score by approximate quantiles; ranks
and running sums are taken inside the buckets and carried on from bucket to
bucket, so a key with most of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import settle

BUCKETS = 64
#: Keys whose cuts are broadcast after they were counted, so that a hot key's rows stay where they are.
BROADCAST_KEYS = 20_000


def bucketed(df: DataFrame, keys: list[str], score: str, buckets: int = BUCKETS) -> DataFrame:
    """df with __b: 0 for the highest scores; equal scores of a key share a bucket."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(F.col(score).cast("double"), shares, 1000).alias("__cuts"))
    if keys:
        cuts = settle(cuts)
        j = df.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_KEYS else cuts, keys)
    else:
        j = df.join(F.broadcast(cuts))  # one row
    return j.withColumn("__b", (buckets - F.size(F.filter("__cuts", lambda c: c < F.col(score)))).cast("int")).drop("__cuts")


def running(df: DataFrame, keys: list[str], score: str, order: list, sums: dict[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """df with the sums of every column in `sums` over rows up to this one, by falling score."""
    b = bucketed(df, keys, score, buckets)
    for n, c in sums.items():
        b = b.withColumn(f"__{n}", c)
    per = b.groupBy(*keys, "__b").agg(*[F.sum(f"__{n}").alias(f"__s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*keys, "__b", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__0_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(base, [*keys, "__b"])
    for n in sums:
        out = out.withColumn(n, F.sum(f"__{n}").over(inside) + F.col(f"__0_{n}"))
    return out.drop("__b", *[f"__{n}" for n in sums], *[f"__0_{n}" for n in sums])


def pr_curve(df: DataFrame, keys: list[str], score: str, hit: str) -> DataFrame:
    """(keys, threshold, precision, recall) at distinct scores, up to full recall."""
    points = df.groupBy(*keys, score).agg(F.sum(F.col(hit).cast("long")).alias("hits"), F.count("*").alias("rows"))
    ran = running(points, keys, score, [F.col(score).desc()], {"tp": F.col("hits"), "n": F.col("rows")})
    total = points.groupBy(*keys).agg(F.sum("hits").alias("all_hits"))
    j = (ran.join(total, keys) if keys else ran.join(F.broadcast(total))).where((F.col("all_hits") > 0) & (F.col("tp") - F.col("hits") < F.col("all_hits")))
    return j.select(*keys, F.col(score).alias("threshold"), (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("all_hits")).alias("recall"), (F.col("hits") / F.col("all_hits")).alias("gain"))


def step_average_precision(df: DataFrame, keys: list[str], score: str, hit: str) -> DataFrame:
    """(keys, ap): area under the curve by steps at distinct scores; keys without a hit are left out."""
    return pr_curve(df, keys, score, hit).groupBy(*keys).agg(F.sum(F.col("gain") * F.col("precision")).alias("ap"))


def interpolated_average_precision(df: DataFrame, keys: list[str], score: str, hit: str, totals: DataFrame, total: str, order: list | None = None) -> DataFrame:
    """(keys, ap): at every hit the best precision from there on, averaged over all truths.

    Only hits count: between them precision falls. totals has a row for each key;
    a key without truths has a null ap, one without detections 0.
    """
    # both are read several times: matches may come from Python, ranks from sorts
    rows = settle(df.select(*dict.fromkeys([*keys, score, hit, *(order or [])])))
    ranked = running(rows, keys, score, [F.col(score).desc(), *(order or [])], {"rank": F.lit(1), "tp": F.col(hit).cast("long")})
    return _best_ahead(settle(ranked.where(F.col(hit)).select(*keys, "rank", "tp")), keys, totals, total)


def interpolated_average_precision_grid(df: DataFrame, keys: list[str], score: str, thresholds: str, totals: DataFrame, total: str, order: list | None = None) -> DataFrame:
    """(keys, threshold, ap) where a row hits at every one of its `thresholds` (an array) and at no other.

    A row's rank is the same at all of them, so rows are ranked once and only hits
    are told by threshold. totals has a row for each key and threshold.
    """
    rows = settle(df.select(*dict.fromkeys([*keys, score, thresholds, *(order or [])])))
    ranked = running(rows, keys, score, [F.col(score).desc(), *(order or [])], {"rank": F.lit(1)})
    hits = settle(ranked.select(*keys, "rank", F.explode(thresholds).alias("threshold")))
    each = [*keys, "threshold"]
    ahead = hits.withColumn("back", -F.col("rank").cast("double"))  # the first rank has the highest score
    return _best_ahead(settle(running(ahead, each, "back", ["rank"], {"tp": F.lit(1)}).select(*each, "rank", "tp")), each, totals, total)


def _best_ahead(hits: DataFrame, keys: list[str], totals: DataFrame, total: str) -> DataFrame:
    """(keys, ap) from hits (keys, rank, tp)."""
    hits = hits.withColumn("p", F.col("tp") / F.col("rank")).withColumn("far", F.col("rank").cast("double"))
    # a running maximum from the last hit back, again by buckets
    b = bucketed(hits, keys, "far")
    top = b.groupBy(*keys, "__b").agg(F.max("p").alias("__top"))
    later = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = top.select(*keys, "__b", F.max("__top").over(later).alias("__later"))
    inside = Window.partitionBy(*keys, "__b").orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    best = b.join(base, [*keys, "__b"]).withColumn("best", F.greatest(F.max("p").over(inside), "__later"))
    found = best.groupBy(*keys).agg(F.sum("best").alias("__s"))
    out = totals.join(found, keys, "left") if keys else totals.join(F.broadcast(found), how="left")
    return out.select(*keys, F.when(F.col(total) > 0, F.coalesce("__s", F.lit(0.0)) / F.col(total)).alias("ap"))
