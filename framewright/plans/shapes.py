"""Driver tables in the shapes that the operators work on, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import spans
from framewright.plans.registry import table

HOUR = 3_600_000_000


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with frame: whole hours since the first one."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.agg(F.min("us").alias("t0"))
    return e.join(F.broadcast(first)).withColumn("frame", F.floor((F.col("us") - F.col("t0")) / HOUR)).drop("us", "t0")  # one row


FRAMES = "f AS (SELECT event_id, user_id, event_type, value, props, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS frame FROM events)"


def user_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, s, e)."""
    return spans.runs_of_frames(frames(spark, sf_dir), ["user_id", "event_type"], "frame")


SPANS = FRAMES + """, sp AS (SELECT user_id, event_type, min(frame) AS s, max(frame) AS e FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS g FROM (SELECT DISTINCT user_id, event_type, frame FROM f)) GROUP BY user_id, event_type, g)"""


def span_pairs(spark: SparkSession, sf_dir: str, values: dict[str, Column] | None = None) -> DataFrame:
    """(event_type, user_a, s, e, user_b, s2, e2, values): overlapping spans of two users, with columns over their ends."""
    p = spans.overlap_pairs(user_spans(spark, sf_dir), ["event_type"], "user_id", values or {})
    return p.select("event_type", F.col("a").alias("user_a"), "s", "e", F.col("b").alias("user_b"), "s2", "e2", *(values or {}))


def span_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, s, e, s2, e2, pairs): the overlapping spans of two users, counted by their ends."""
    return spans.overlap_counts(user_spans(spark, sf_dir), ["event_type"], "user_id")


PAIRS = SPANS + """, pr AS (SELECT a.event_type, a.user_id AS user_a, a.s, a.e, b.user_id AS user_b, b.s AS s2, b.e AS e2
  FROM sp a JOIN sp b ON a.event_type = b.event_type AND a.user_id < b.user_id AND a.s <= b.e AND b.s <= a.e)"""
TIOU = "((least(e, e2) - greatest(s, s2) + 1)::DOUBLE / ((e - s + 1) + (e2 - s2 + 1) - (least(e, e2) - greatest(s, s2) + 1)))"


def r6(c):
    return F.round(c, 6)
