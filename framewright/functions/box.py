"""Boxes [x1, y1, x2, y2] as arrays of doubles, and tubes as maps from frame to box."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.interval import clamp01


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(x1.cast("double"), y1.cast("double"), x2.cast("double"), y2.cast("double"))


def area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Column, b: Column, plus: float = 0.0) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + plus, F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + plus, F.lit(0.0))
    return w * h


def box_iou(a: Column, b: Column) -> Column:
    """0 for touching edges, empty or null boxes."""
    i = intersection(a, b)
    return F.coalesce(F.when(i > 0, F.try_divide(i, area(a) + area(b) - i)), F.lit(0.0))


def box_iou_pixel(a: Column, b: Column) -> Column:
    """Right and bottom pixels belong to the box."""
    size = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    i = intersection(a, b, 1.0)
    return F.coalesce(F.try_divide(i, size(a) + size(b) - i), F.lit(0.0))


def box_ioa(a: Column, b: Column) -> Column:
    """Share of b's area that a covers."""
    return F.coalesce(F.try_divide(intersection(a, b), area(b)), F.lit(0.0))


def normalise(b: Column, width: Column, height: Column) -> Column:
    """Pixels to [0, 1]; null where the size isn't positive or the box isn't four numbers."""
    ok = (F.size(b) == 4) & (width > 0) & (height > 0) & F.forall(b, lambda v: v.isNotNull())
    return F.when(ok, F.array(*[clamp01(F.try_divide(b[i], width if i % 2 == 0 else height)) for i in range(4)]))


def from_xywh(b: Column) -> Column:
    return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])


def is_pixels(b: Column) -> Column:
    """Any coordinate above 1.5."""
    return F.exists(b, lambda v: v > 1.5)


def to_integers(b: Column, width: Column, height: Column) -> Column:
    """Normalised or pixel box to whole pixels inside the frame, corners in order."""
    unit = F.forall(b, lambda v: v <= 1.0)
    at = [F.when(unit, b[i] * (width if i % 2 == 0 else height)).otherwise(b[i]) for i in range(4)]
    inside = lambda v, top: F.bround(F.greatest(F.lit(0.0), F.least(v, top.cast("double")))).cast("int")
    x, y = [inside(at[0], width), inside(at[2], width)], [inside(at[1], height), inside(at[3], height)]
    return F.struct(F.least(*x).alias("x1"), F.least(*y).alias("y1"), F.greatest(*x).alias("x2"), F.greatest(*y).alias("y2"))


def point_to_box(x: Column, y: Column, half: float, width: Column, height: Column) -> Column:
    """A square of twice half around a point given as a share, percent or pixels; in shares, clamped."""
    top = F.greatest(x, y)
    scale = lambda v, size: F.when(top <= 1.0, v).when(top <= 100.0, v / 100.0).otherwise(F.try_divide(v, size))
    px, py = scale(x, width), scale(y, height)
    return F.array(clamp01(px - half), clamp01(py - half), clamp01(px + half), clamp01(py + half))


def tube_frames(tube: Column) -> Column:
    return F.array_sort(F.map_keys(tube))


def tube_viou(gt: Column, pred: Column) -> Column:
    """Sum of box IoU over shared frames by the number of frames of either tube."""
    shared = F.array_intersect(F.map_keys(gt), F.map_keys(pred))
    total = F.aggregate(shared, F.lit(0.0), lambda acc, f: acc + box_iou(F.try_element_at(gt, f), F.try_element_at(pred, f)))
    return F.coalesce(F.try_divide(total, F.size(F.array_union(F.map_keys(gt), F.map_keys(pred)))), F.lit(0.0))


def tube_siou(gt: Column, pred: Column) -> Column:
    """Mean box IoU over shared frames."""
    shared = F.array_intersect(F.map_keys(gt), F.map_keys(pred))
    total = F.aggregate(shared, F.lit(0.0), lambda acc, f: acc + box_iou(F.try_element_at(gt, f), F.try_element_at(pred, f)))
    return F.coalesce(F.try_divide(total, F.size(shared)), F.lit(0.0))


def restrict(tube: Column, s: Column, e: Column) -> Column:
    return F.map_filter(tube, lambda f, _: (f >= s) & (f <= e))
