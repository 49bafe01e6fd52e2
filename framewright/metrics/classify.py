"""Classification and recognition metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators import curves


def confusion_matrix(df: DataFrame, truth: str, guess: str, normalise: str | None = None) -> DataFrame:
    """(truth, guess, value) for all pairs of the labels of both columns; rows, columns or all sum to 1 if normalised."""
    if normalise not in (None, "true", "pred", "all"):
        raise ValueError("normalise is None, 'true', 'pred' or 'all'")
    t = df.select(F.col(truth).cast("long").alias("truth"), F.col(guess).cast("long").alias("guess")).dropna()
    counts = t.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    labels = counts.select(F.col("truth").alias("l")).union(counts.select("guess")).distinct()
    dense = labels.select(F.col("l").alias("truth")).join(labels.select(F.col("l").alias("guess"))).join(counts, ["truth", "guess"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if normalise is None:
        return dense.select("truth", "guess", F.col("n").alias("value"))
    w = Window.partitionBy(*{"true": ["truth"], "pred": ["guess"], "all": []}[normalise])
    return dense.select("truth", "guess", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(w)), F.lit(0.0)).alias("value"))


def mean_class_accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: the mean over all labels of either column of hits by truths; 0 for a label without truths."""
    t = df.select(F.col(truth).alias("t"), F.col(guess).alias("g")).dropna()
    each = t.groupBy(F.col("t").alias("l")).agg(F.avg((F.col("t") == F.col("g")).cast("double")).alias("a"))
    labels = t.select(F.col("t").alias("l")).union(t.select("g")).distinct()
    return labels.join(each, "l", "left").agg(F.avg(F.coalesce("a", F.lit(0.0))).alias("mean_class_accuracy"))


def class_ratios(df: DataFrame, truth: str, guess: str, k: int, best: bool = True) -> DataFrame:
    """The k classes with the highest or lowest share of hits."""
    each = df.groupBy(F.col(truth).alias("label")).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("ratio"))
    return each.orderBy(F.col("ratio").desc() if best else F.col("ratio").asc(), "label").limit(k)


def rank_of_label(scores: Column, label: Column) -> Column:
    """The label's place from 1 by falling score; the later of equal scores goes first."""
    own = F.get(scores, label)
    better = F.filter(scores, lambda s: s > own)
    ties = F.filter(F.transform(scores, lambda s, i: (s == own) & (i > label)), lambda b: b)
    return F.size(better) + F.size(ties) + 1


def top_k_accuracy(df: DataFrame, scores: str, label: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    r = rank_of_label(F.col(scores), F.col(label))
    return df.agg(*[F.avg((r <= k).cast("double")).alias(f"top{k}") for k in ks])


def mean_average_precision(df: DataFrame, scores: str, truth: str) -> DataFrame:
    """(map): the mean over classes of step-wise average precision; classes without a truth are left out.

    scores and truth are arrays with an element for each class.
    """
    each = df.select(F.posexplode(F.arrays_zip(F.col(scores).alias("s"), F.col(truth).alias("y"))).alias("cls", "z")).select("cls", F.col("z")["s"].alias("s"), (F.col("z")["y"] == 1).alias("hit"))
    return curves.step_average_precision(each, ["cls"], "s", "hit").agg(F.avg("ap").alias("map"))


def sample_average_precision(df: DataFrame, scores: str, truth: str) -> DataFrame:
    """(map): average precision of each sample over its classes, averaged; no shuffle, as a sample is one row."""
    z = F.zip_with(F.col(scores), F.col(truth), lambda s, y: F.struct(s.alias("s"), (y == 1).cast("int").alias("y")))
    hits = F.filter(z, lambda a: a["y"] == 1)
    count = lambda s: (F.size(F.filter(z, lambda b: b["s"] >= s)), F.size(F.filter(hits, lambda b: b["s"] >= s)))

    def precision(a: Column) -> Column:
        n, tp = count(a["s"])
        return tp / n

    ap = F.aggregate(hits, F.lit(0.0), lambda acc, a: acc + precision(a)) / F.nullif(F.size(hits), F.lit(0))
    return df.agg(F.avg(ap).alias("map"))


def vqa_accuracy(df: DataFrame, guess: Column, answers: Column, weights: Column, full: float = 0.3) -> DataFrame:
    """(acc): summed weights of the answers that are met by the full weight, 1 at most, as a percentage."""
    met = F.aggregate(F.zip_with(answers, weights, lambda a, w: F.when(a == guess, w).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return df.agg((F.avg(F.least(F.lit(1.0), met / full)) * 100).alias("acc"))


def cor_loc(df: DataFrame, images: str, correct: str) -> DataFrame:
    """Share of images with a truth in which a class is found; null for classes without truths."""
    return df.withColumn("corloc", F.try_divide(F.col(correct).cast("double"), F.col(images)))
