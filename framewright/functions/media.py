"""Sizes, buckets and token estimates of images and videos."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PixelBudget:
    factor: int = 28
    least: int = 56 * 56
    most: int = 14 * 14 * 4 * 1280


def _to(x: Column, factor: int, how) -> Column:
    return how(x / factor) * factor


def resize_image(height: Column, width: Column, b: PixelBudget = PixelBudget()) -> Column:
    """struct(h, w): multiples of factor within the budget, half-even rounding first."""
    h, w = _to(height, b.factor, F.bround), _to(width, b.factor, F.bround)
    shrink, grow = F.sqrt(height * width / float(b.most)), F.sqrt(F.lit(float(b.least)) / (height * width))
    down = lambda x: F.greatest(_to(x / shrink, b.factor, F.floor), F.lit(b.factor))
    up = lambda x: _to(x * grow, b.factor, F.ceil)
    pick = lambda plain, x: F.when(h * w > b.most, down(x)).when(h * w < b.least, up(x)).otherwise(plain).cast("long")
    return F.struct(pick(h, height).alias("h"), pick(w, width).alias("w"))


VIDEO = PixelBudget(32, 128 * 128, 16 * 16 * 2 * 2 * 2 * 6144)


def resize_video(frames: Column, height: Column, width: Column, temporal: int = 2, b: PixelBudget = VIDEO) -> Column:
    """struct(h, w) with the budget over all frames, their number rounded up to whole temporal patches."""
    t = F.ceil(frames / temporal) * temporal
    h, w = _to(height, b.factor, F.bround), _to(width, b.factor, F.bround)
    shrink, grow = F.sqrt(frames * height * width / float(b.most)), F.sqrt(F.lit(float(b.least)) / (frames * height * width))
    down = lambda x: F.greatest(_to(x / shrink, b.factor, F.floor), F.lit(b.factor))
    up = lambda x: _to(x * grow, b.factor, F.ceil)
    pick = lambda plain, x: F.when(t * h * w > b.most, down(x)).when(t * h * w < b.least, up(x)).otherwise(plain).cast("long")
    return F.struct(pick(h, height).alias("h"), pick(w, width).alias("w"))


def image_tokens(height: Column, width: Column, patch: int = 14, merge: int = 2, b: PixelBudget = PixelBudget()) -> Column:
    s = resize_image(height, width, b)
    return ((s["h"] / patch).cast("long") * (s["w"] / patch).cast("long") / merge**2).cast("long")


def video_frames(total: Column, native_fps: Column, duration: Column | None = None, fps: float = 2.0, least: int = 4, most: int = 768, temporal: int = 2) -> Column:
    """Frames sampled at fps, within bounds, rounded up to whole temporal patches; a missing count comes from the duration."""
    d = F.lit(0.0) if duration is None else duration
    t = F.when((total == 0) & (native_fps > 0), F.floor(d * native_fps)).otherwise(total).cast("long")
    n = F.greatest(F.lit(1), F.floor(F.when(native_fps > 0, F.try_divide(t.cast("double"), native_fps)).otherwise(d) * fps).cast("long"))
    n = F.greatest(F.lit(least), F.least(t, F.lit(most), n))
    return (F.ceil(n / temporal) * temporal).cast("long")


def video_tokens(total: Column, native_fps: Column, height: Column, width: Column, duration: Column | None = None, fps: float = 2.0, least: int = 4, most: int = 768, patch: int = 16, merge: int = 2, temporal: int = 2, b: PixelBudget = VIDEO) -> Column:
    n = video_frames(total, native_fps, duration, fps, least, most, temporal)
    s = resize_video(n, height, width, temporal, b)
    return F.floor(n / temporal * F.floor(s["h"] / patch) * F.floor(s["w"] / patch) / merge**2).cast("long")


def text_length(texts: Column, media: Column, precomputed: Column | None = None, per_media: int = 500) -> Column:
    """A length given before, else a third of the characters plus a flat size for each image or video."""
    chars = F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + F.length(F.coalesce(t, F.lit(""))))
    guess = F.floor(chars / 3) + F.coalesce(media, F.lit(0)) * per_media
    return guess if precomputed is None else F.coalesce(precomputed.cast("long"), guess)


def frames_at(total: Column, native_fps: Column, fps: float) -> Column:
    """Frames of a video at another rate, one at least; null where the metadata can't be right."""
    return F.when((total > 0) & (native_fps > 0) & F.lit(fps > 0), F.greatest(F.lit(1), F.bround(total / native_fps * fps).cast("long")))


def uniform_sample(total: Column, native_fps: Column, fps: float, most: int | None = None, to_fps: float | None = None) -> Column:
    """Frame numbers at to_fps of frames spread evenly over the video."""
    n = F.greatest(F.lit(1), F.least(total, F.bround(total / native_fps * fps).cast("long")))
    n = F.least(n, F.lit(most)) if most else n
    native = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.bround(i * (total - 1) / F.greatest(n - 1, F.lit(1))).cast("long"))))
    return F.transform(F.when(n == 1, F.array(F.lit(0).cast("long"))).otherwise(native), lambda i: F.bround(i / native_fps * (to_fps or fps)).cast("long"))


#: Width to height of the buckets' shapes.
ASPECTS = ((1, 2), (9, 16), (2, 3), (3, 4), (4, 5), (1, 1), (5, 4), (4, 3), (3, 2), (16, 10), (5, 3), (16, 9), (2, 1), (21, 9))


def bucket_rows(pixels: int = 256 * 256, step: int = 64, aspects: tuple[tuple[int, int], ...] = ASPECTS) -> list[tuple[int, int, int, float]]:
    """(id, w, h, aspect): for each shape the largest size in whole steps within the pixels, by rising aspect."""
    sizes = set()
    for a, b in aspects:
        h = round(int((pixels * b / a) ** 0.5) / step) * step
        w = round(int(h * (a / b)) / step) * step
        while w * h > pixels:  # rounding may have gone over
            w, h = (w - step, h) if w >= h else (w, h - step)
        if min(w, h) >= step:
            sizes.add((w, h))
    return [(i, w, h, w / h) for i, (w, h) in enumerate(sorted(sizes, key=lambda s: s[0] / s[1]))]


def bucket_table(spark: SparkSession, pixels: int = 256 * 256, step: int = 64, aspects: tuple[tuple[int, int], ...] = ASPECTS) -> DataFrame:
    return spark.createDataFrame(bucket_rows(pixels, step, aspects), "id int, w int, h int, aspect double")


def nearest_bucket(images: DataFrame, buckets: DataFrame, width: str, height: str) -> DataFrame:
    """images with the bucket whose aspect is nearest; the table has a row for each aspect, so it is one literal."""
    table = buckets.select(F.struct("id", "aspect", "w", "h").alias("b")).agg(F.array_sort(F.collect_list("b")).alias("__all"))
    ratio = F.col(width) / F.col(height)
    best = F.array_min(F.transform("__all", lambda b: F.struct(F.abs(b["aspect"] - ratio).alias("d"), b["id"].alias("id"), b["aspect"].alias("aspect"), b["w"].alias("w"), b["h"].alias("h"))))
    return images.join(F.broadcast(table)).withColumn("bucket", best).drop("__all")


def dynamic_batch(width: Column, height: Column, base_batch: int, base_pixels: int) -> Column:
    """Batches shrink as the area grows, one at least."""
    return F.greatest(F.lit(1), F.floor(base_batch * base_pixels / (width * height)).cast("int"))


def orientation(width: Column, height: Column) -> Column:
    r = width / height
    return F.when(r < 0.85, "tall").when(r > 1.18, "wide").otherwise("square")
