"""Arrays: sampling of positions, similarity, softmax, padding and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even_positions(n: Column, k: Column) -> Column:
    """k positions spread over 0..n-1 with half-even rounding; the middle one for k = 1; all if k covers n."""
    one = F.array((n / 2).cast("long"))
    many = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("long"))
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i.cast("long"))
    return F.when((n <= 0) | (k <= 0), F.array().cast("array<long>")).when(n <= k, every).when(k == 1, one).otherwise(many)


def select_evenly(a: Column, k: Column) -> Column:
    """The elements of a at even_positions."""
    return F.transform(even_positions(F.size(a).cast("long"), k), lambda i: F.element_at(a, (i + 1).cast("int")))


def linear_indices(start: Column, end: Column, most: Column) -> Column:
    """At most `most` whole numbers spread over [start, end], both ends included, without repeats."""
    e = F.greatest(start, end)
    total = e - start + 1
    step = (e - start) / F.greatest(most - 1, F.lit(1))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), lambda i: F.bround(start + i * step).cast("long")))
    return F.when((most <= 1) | (total <= 1), F.array(start.cast("long"))).when(total <= most, F.transform(F.sequence(start, e), lambda x: x.cast("long"))).otherwise(spread)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def weighted_scores(scores: list[Column], weights: list[float]) -> Column:
    """Element by element sum of weight times score."""
    scaled = lambda s, w: F.transform(s, lambda x: x * w)
    out = scaled(scores[0], weights[0])
    for s, w in zip(scores[1:], weights[1:], strict=True):
        out = F.zip_with(out, scaled(s, w), lambda x, y: x + y)
    return out


def pad(a: Column, size: Column, value) -> Column:
    """a filled up to size; longer arrays stay as they are."""
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(size - F.size(a), F.lit(0))))


def padded_size(n: Column, divisor: int | None) -> Column:
    """n rounded up to a multiple of divisor."""
    return n if not divisor else (F.ceil(n / divisor) * divisor).cast("int")


def shift_labels(ids: Column, answer: Column, ignore: int = -100) -> Column:
    """Next-token labels: label i is token i + 1 where that token belongs to the answer, else ignored; the last is ignored."""
    masked = F.zip_with(ids, answer, lambda t, m: F.when(m.cast("int") != 0, t).otherwise(F.lit(ignore)))
    return F.concat(F.slice(masked, 2, F.greatest(F.size(masked) - 1, F.lit(0))), F.array(F.lit(ignore)))


def last_run(mask: Column) -> Column:
    """Only the final run of ones of a 0/1 array stays."""
    n = F.size(mask)
    back = F.reverse(mask)
    tail = F.array_position(back, F.lit(1)) - 1  # zeros after the last one
    rest = F.slice(back, (tail + 1).cast("int"), F.greatest(n - tail, F.lit(0)).cast("int"))
    gap = F.array_position(rest, F.lit(0))
    run = F.when(gap == 0, F.size(rest)).otherwise(gap - 1)
    return F.when(F.array_position(mask, F.lit(1)) == 0, mask).otherwise(F.transform(mask, lambda _, i: ((i >= n - tail - run) & (i < n - tail)).cast("int")))


def attention_from_labels(labels: Column, ignore: int = -100) -> Column:
    """Ones up to the last kept label; all ones if the last label is kept or none is."""
    n = F.size(labels)
    kept = F.filter(F.transform(labels, lambda x, i: F.when(x != ignore, i)), lambda i: i.isNotNull())
    last = F.array_max(kept)
    end = F.when(last.isNull() | (last == n - 1), n - 1).otherwise(last)
    return F.transform(labels, lambda _, i: (i <= end).cast("int"))


def block_causal_mask(seq_lens: Column) -> Column:
    """Square 0/1 matrix: position j is seen from i if it is in the same sequence and not later."""
    owner = F.flatten(F.transform(seq_lens, lambda n, k: F.array_repeat(k, n)))
    return F.transform(owner, lambda a, i: F.transform(owner, lambda b, j: ((a == b) & (j <= i)).cast("int")))


def indexed_block_causal_mask(mask: Column) -> Column:
    """The same from a mask of sequence numbers, in which 0 is padding."""
    return F.transform(mask, lambda a, i: F.transform(mask, lambda b, j: ((a == b) & (a > 0) & (j <= i)).cast("int")))


def positions_with_reset(tokens: Column, eod: int) -> Column:
    """Positions that start anew after each end-of-document token."""
    return F.aggregate(
        tokens,
        F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")),
        lambda s, t: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), F.when(t == eod, 0).otherwise(s["at"] + 1).alias("at")),
        lambda s: s["out"],
    )


def loss_mask_without(tokens: Column, eod: int) -> Column:
    """1.0 but for end-of-document tokens."""
    return F.transform(tokens, lambda t: F.when(t == eod, 0.0).otherwise(1.0))


def document_mask(tokens: Column, eod: int) -> Column:
    """Causal 0/1 matrix whose rows don't see documents before the last end-of-document token."""
    doc = F.aggregate(
        tokens,
        F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("k")),
        lambda s, t: F.struct(F.concat(s["out"], F.array(s["k"])).alias("out"), F.when(t == eod, s["k"] + 1).otherwise(s["k"]).alias("k")),
        lambda s: s["out"],
    )
    return F.transform(doc, lambda a, i: F.transform(doc, lambda b, j: ((a == b) & (j <= i)).cast("int")))
