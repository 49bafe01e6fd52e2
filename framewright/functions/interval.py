"""Interval arithmetic on columns.

Closed dialect: [s, e] counts whole frames. Half-open dialect: [s, e) measures
length. A null end makes an interval empty: overlaps with it are 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F




def overlap_closed(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared frames of two closed intervals, 0 if disjoint or null."""
    return F.coalesce(F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0)), F.lit(0))


def tiou_closed(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inter = overlap_closed(s1, e1, s2, e2)
    return F.coalesce(F.try_divide(inter.cast("double"), (e1 - s1 + 1) + (e2 - s2 + 1) - inter), F.lit(0.0))


def tiou_half_open(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inter = F.coalesce(F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0)), F.lit(0))
    return F.coalesce(F.try_divide(inter.cast("double"), (e1 - s1) + (e2 - s2) - inter), F.lit(0.0))


def tiou_hull(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Over the hull, without a clamp: negative for disjoint intervals."""
    return F.coalesce(F.try_divide((F.least(e1, e2) - F.greatest(s1, s2)).cast("double"), F.greatest(e1, e2) - F.least(s1, s2)), F.lit(0.0))


def overlap_span(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The shared closed interval as a struct, or null."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(s <= e, F.struct(s.alias("s"), e.alias("e")))


def group_gap(starts: Column, ends: Column) -> Column:
    """From the last start back to the first end, 0 at least; arrays of one group."""
    return F.greatest(F.array_max(starts) - F.array_min(ends), F.lit(0))


def group_span(starts: Column, ends: Column) -> Column:
    return F.array_max(ends) - F.array_min(starts)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rescale(frame: Column, in_fps: Column, out_fps: Column) -> Column:
    """Span ends between frame rates."""
    return F.try_divide(frame * out_fps, in_fps)


def temporal_bin_to_frame(b: Column, bins: Column, n: Column) -> Column:
    """bin / (bins - 1) of the way through n frames, inside the video."""
    at = F.bround(F.try_divide(b.cast("double"), bins - 1) * (n - 1))
    return F.greatest(F.lit(0), F.least(at.cast("long"), n - 1))


def difficulty_label5(d: Column) -> Column:
    return F.when(d < 0.2, "very_easy").when(d < 0.4, "easy").when(d < 0.6, "medium").when(d < 0.8, "hard").otherwise("very_hard")


def normalise_span(s: Column, e: Column) -> Column:
    """Half-even rounding, ends in order."""
    a, b = F.bround(s).cast("long"), F.bround(e).cast("long")
    return F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))
