"""Spans of frames: runs, merging, sessions, overlap joins, ordered folds.

Table forms work on one row for each frame or span and shuffle once, by key;
array forms fold the spans that a row already holds and don't shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import settle, shuffle_partitions

#: Pairs that a task counts.
PAIRS = 1_000_000


def runs_of_frames(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """(keys, s, e): maximal runs of consecutive frames; repeated frames count once."""
    each = df.select(*keys, frame).where(F.col(frame).isNotNull()).distinct()
    island = F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame))
    return each.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min(frame).alias("s"), F.max(frame).alias("e")).drop("__i")


def merge_spans(df: DataFrame, keys: list[str], s: str = "s", e: str = "e", gap: int = 1) -> DataFrame:
    """(keys, s, e): spans joined where one starts at most `gap` after what came before ends."""
    w = Window.partitionBy(*keys).orderBy(s, e)
    far = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (far.isNull() | (F.col(s) > far + gap)).cast("int")
    numbered = df.withColumn("__o", opens).withColumn("__i", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__i").agg(F.min(s).alias("s"), F.max(e).alias("e")).drop("__i")


def sessions(df: DataFrame, keys: list[str], frame: str, score: str, max_gap: int) -> DataFrame:
    """(keys, s, e, n, mean_score, peak_score, peak_frame): a new session starts after a longer gap than max_gap.

    The peak is the first frame with the highest score.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    opens = F.coalesce((F.col(frame) - F.lag(frame).over(w) > max_gap).cast("int"), F.lit(0))
    numbered = df.withColumn("__o", opens).withColumn("__i", F.sum("__o").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    peak = F.max(F.struct(F.col(score).alias("p"), (-F.col(frame)).alias("f")))
    out = numbered.groupBy(*keys, "__i").agg(F.min(frame).alias("s"), F.max(frame).alias("e"), F.count("*").alias("n"), F.avg(score).alias("mean_score"), peak.alias("__p"))
    return out.select(*keys, "s", "e", "n", "mean_score", F.col("__p.p").alias("peak_score"), (-F.col("__p.f")).alias("peak_frame"))


#: Bins that a span is dealt into at most; longer ones go into wider bins, each level so many times as wide.
MOST_BINS, LEVELS = 64, 4


def fitted_width(sides: list[tuple[DataFrame, str, str]], widest: int) -> int:
    """The mean length of the spans of both sides, up to `widest`."""
    length = lambda d, s, e: d.where(F.col(s) <= F.col(e)).agg(F.sum((F.col(e) - F.col(s) + 1).cast("double")), F.count("*")).collect()[0]
    found = [length(*x) for x in sides]
    n = sum(x[1] for x in found)
    return max(1, min(widest, round(sum(x[0] or 0.0 for x in found) / n))) if n else widest


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bin_width: int, ls: str = "s", le: str = "e", rs: str = "s2", re: str = "e2") -> DataFrame:
    """Rows of both sides whose closed spans overlap, with equal keys, each pair once.

    Both sides are dealt into bins of frames, so the join is an equality join
    on keys and bin that spreads a hot key over its bins; a pair counts in the bin
    of its first shared frame only. bin_width is the most that a bin is wide: where
    spans are shorter on average, so are the bins, as rows of a bin that don't overlap
    are met in vain. A span of more than MOST_BINS bins has its bins
    on a wider level; pairs meet on the wider one of their levels. Column names
    must not clash but for the keys.
    """
    bin_width = fitted_width([(left, ls, le), (right, rs, re)], bin_width)
    wide = lambda level: F.lit(bin_width) * F.pow(F.lit(MOST_BINS), level)
    at = lambda c, level: F.floor(F.col(c) / wide(level)).cast("long")

    def level(s: str, e: str):
        out = F.lit(LEVELS - 1)
        for k in range(LEVELS - 2, -1, -1):
            out = F.when(at(e, F.lit(k)) - at(s, F.lit(k)) < MOST_BINS, k).otherwise(out)
        return out

    a, b = left.withColumn("__own", level(ls, le)), right.withColumn("__own", level(rs, re))
    top = max(d.agg(F.coalesce(F.max("__own"), F.lit(0))).collect()[0][0] for d in (a, b))

    def dealt(d: DataFrame, s: str, e: str, mine: str, other: str) -> DataFrame:
        """A row for each level, meeting and bin: rows of one level meet, and rows of this level meet shorter ones of the other side."""
        d = d.withColumn("__level", F.explode(F.sequence("__own", F.lit(top)))) if top else d.withColumn("__level", F.lit(0))
        own = F.col("__level") == F.col("__own")
        meet = F.when(own & (F.col("__level") > 0), F.array(F.lit("both"), F.lit(mine))).when(own, F.array(F.lit("both"))).otherwise(F.array(F.lit(other)))
        d = d.withColumn("__meet", F.explode(meet)) if top else d.withColumn("__meet", F.lit("both"))
        return d.withColumn("__bin", F.explode(F.sequence(at(s, F.col("__level")), at(e, F.col("__level"))))).drop("__own")

    both = dealt(a, ls, le, "left", "right").join(dealt(b, rs, re, "right", "left"), [*keys, "__level", "__meet", "__bin"])
    first = F.floor(F.greatest(ls, rs) / wide(F.col("__level")))
    return both.where((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.col("__bin") == first)).drop("__bin", "__level", "__meet")


def overlap_counts(spans: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, s, e, s2, e2, pairs): how many pairs of two items' spans overlap, by the ends of their spans.

    spans (keys, item, s, e) are distinct and of one item they don't overlap, so all
    that a span shares with its own item is itself. Each unordered pair counts
    once, under (s, e) <= (s2, e2). Rows grow with the distinct ends and not with
    the pairs.
    """
    each = settle(spans.where(F.col(item).isNotNull()).groupBy(*keys, "s", "e").agg(F.count("*").alias("n")))
    other = each.select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("n").alias("n2"))
    both = overlap_join(each, other, keys, 16).where("s < s2 or s = s2 and e <= e2")
    same = (F.col("s") == F.col("s2")) & (F.col("e") == F.col("e2"))
    pairs = F.when(same, (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(F.col("n") * F.col("n2"))
    return both.select(*keys, "s", "e", "s2", "e2", pairs.alias("pairs")).where("pairs > 0")


def overlap_pairs(spans: DataFrame, keys: list[str], item: str, values: dict[str, Column], part: int = 2048) -> DataFrame:
    """(keys, a, b, s, e, s2, e2, values): overlapping spans of two items, a < b.

    Items are gathered by the ends of their spans, up to about `part` in a row, so
    overlaps and values (columns over s, e, s2 and e2) are worked out once for two
    such rows, and a pair of items is only written. spans are distinct rows.
    """
    d = settle(spans.where(F.col(item).isNotNull()).select(*keys, item, "s", "e"))
    most = d.groupBy(*keys, "s", "e").count().agg(F.max("count")).collect()[0][0] or 0
    parts = -(-most // part) or 1
    each = settle(d.groupBy(*keys, "s", "e", F.pmod(F.xxhash64(item), F.lit(parts)).alias("__part")).agg(F.collect_list(item).alias("__a")).drop("__part"))
    other = each.select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("__a").alias("__b"))
    met = overlap_join(each, other, keys, 16)
    for n, c in values.items():
        met = met.withColumn(n, c)
    width = max(shuffle_partitions(d.sparkSession), 4 * d.sparkSession.sparkContext.defaultParallelism)
    dealt = met.repartition(width)  # few rows stand for many pairs
    out = dealt.withColumn("a", F.explode("__a")).drop("__a").withColumn("b", F.explode("__b")).drop("__b").where("a < b")
    return out.select(*keys, "a", "b", "s", "e", "s2", "e2", *values)


def shared_frame_pairs(frames: DataFrame, group: list[str], item: str, frame: str, least: int) -> DataFrame:
    """(group, a, b, shared): unordered pairs of items that are seen in at least `least` common frames of a group.

    Pairs are counted before they are made, so that a task never holds more than about PAIRS of them.
    """
    each = settle(frames.select(*group, item, frame).distinct())
    n = F.count("*")
    size = each.groupBy(*group, frame).agg((n * (n - 1) / 2).alias("n"), n.alias("k")).agg(F.sum("n"), F.sum("k")).collect()[0]
    wide = shuffle_partitions(frames.sparkSession)
    rows, made = (max(wide, -(-int(x or 0) // PAIRS)) for x in (size[1], size[0]))
    near = each.repartition(rows, *group, frame)
    b = near.withColumnRenamed(item, "b")
    pairs = near.withColumnRenamed(item, "a").join(b, [*group, frame]).where("a < b").select(*group, "a", "b")
    return pairs.repartition(made, *group, "a", "b").groupBy(*group, "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def frames_until(df: DataFrame, starts: DataFrame, keys: list[str], pos: str, start: str, most: int) -> DataFrame:
    """df with __next: the first start at or after pos, `most` where there is none (an as-of join forwards).

    One sort of both sides by key and place, no pairs.
    """
    a = df.withColumn("__at", F.col(pos)).withColumn("__s", F.lit(None).cast("long"))
    cols = [*df.columns, "__at", "__s", "__row"]
    b = starts.select(*keys, F.col(start).cast("long").alias("__s"))
    for c in df.columns:
        if c not in keys:
            b = b.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    both = a.withColumn("__row", F.lit(1)).select(*cols).union(b.withColumn("__at", F.col("__s")).withColumn("__row", F.lit(0)).select(*cols))
    w = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), F.col("__row")).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last("__s", ignorenulls=True).over(w)
    return both.withColumn("__next", F.coalesce(F.when(near < most, near), F.lit(most))).where("__row = 1").drop("__at", "__s", "__row")


# ---- spans that a row holds as array<struct<s, e>> ----------------------------------------------


def span(s: Column, e: Column) -> Column:
    """Ends in order; a missing end is the start, a missing start is 0."""
    a = F.coalesce(s, F.lit(0)).cast("long")
    b = F.coalesce(e, a).cast("long")
    return F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))


def merged(spans: Column, gap: int = 1) -> Column:
    """Array form of merge_spans."""
    empty = F.array().cast("array<struct<s: bigint, e: bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"] + gap), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def runs(frames: Column) -> Column:
    """Array form of runs_of_frames."""
    return merged(F.transform(F.array_distinct(frames), lambda f: F.struct(f.cast("long").alias("s"), f.cast("long").alias("e"))))


def downsample(spans: Column, limit: int) -> Column:
    """First, last and an even stride of what lies between, sorted and cut to limit (which may cut the last)."""
    a = F.array_sort(F.array_distinct(spans))
    n = F.size(a)
    step = F.greatest(F.lit(1), F.floor(n / max(1, limit - 2)).cast("int"))
    keep = F.filter(a, lambda _, i: (i == 0) | (i == n - 1) | ((i < n - 1) & ((i - 1) % step == 0)))
    return F.when(F.lit(limit <= 0) | (n <= limit), a).otherwise(F.slice(keep, 1, max(1, limit)))


# ---- choice within groups -------------------------------------------------------------------------


def first_by_signature(df: DataFrame, keys: list[str], signature: Column, order: list) -> DataFrame:
    """The first row of each signature (a sorted array) of a group; rows with an empty one go."""
    w = Window.partitionBy(*keys, "__sig").orderBy(*order)
    return df.withColumn("__sig", F.array_sort(signature)).where(F.size("__sig") > 0).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__sig")


def limit_round_robin(df: DataFrame, keys: list[str], bucket: Column, order: list, most: int | None, per_bucket: int | None = None) -> DataFrame:
    """One row of each bucket in order, then the rest in order, under both caps; rows get their __rank.

    bucket: the number of the row's bucket. Without `most`, only the first of each bucket stays.
    """
    per = Window.partitionBy(*keys, "__b").orderBy(*order)
    out = df.withColumn("__b", bucket).withColumn("__k", F.row_number().over(per))
    if per_bucket is not None:
        out = out.where(F.col("__k") <= per_bucket)
    if most is None:
        return out.where("__k = 1").withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__b"))).drop("__b", "__k")
    head = F.when(F.col("__k") == 1, 0).otherwise(1)
    w = Window.partitionBy(*keys).orderBy(head, "__b", *order)
    return out.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__b", "__k")


def share_buckets(df: DataFrame, keys: list[str], order: list, ratios: dict[str, float]) -> DataFrame:
    """df with `share`: rows in order are cut into named classes by largest remainder.

    With three rows or more, an empty class gets a row of a neighbour that has
    more than one: the middle class first, then the first, then the last.
    """
    names = list(ratios)
    if len(names) != 3:
        raise ValueError("three classes are asked for")
    n = F.count("*").over(Window.partitionBy(*keys))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("__n", n).withColumn("__r", row)
    raw = [F.col("__n") * F.lit(ratios[k]) for k in names]
    whole = [F.floor(x) for x in raw]
    left = [x - w for x, w in zip(raw, whole)]
    rest = F.col("__n") - sum(whole[1:], whole[0])
    place = [sum((((left[j] > left[i]) | ((left[j] == left[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i), F.lit(0)) for i in range(3)]
    for i in range(3):
        out = out.withColumn(f"__c{i}", whole[i] + (place[i] < rest).cast("int"))
    out = out.withColumn("__ok", F.col("__n") >= 3)
    # each empty class asks the larger of the two others; ties go to the later one
    for want, x, y in ((1, 0, 2), (0, 1, 2), (2, 1, 0)):
        donor = F.when(F.col(f"__c{x}") > F.col(f"__c{y}"), x).otherwise(y)
        has = F.when(donor == x, F.col(f"__c{x}")).otherwise(F.col(f"__c{y}"))
        move = F.col("__ok") & (F.col(f"__c{want}") == 0) & (has > 1)
        moved = out.withColumn("__d", F.when(move, donor).otherwise(-1))
        out = moved.select(*[c for c in moved.columns if c not in ("__c0", "__c1", "__c2", "__d")], *[(F.col(f"__c{i}") + (F.when(F.col("__d") >= 0, 1).otherwise(0) if i == want else F.when(F.col("__d") == i, -1).otherwise(0))).alias(f"__c{i}") for i in range(3)])
    label = F.when(F.col("__r") <= F.col("__c0"), names[0]).when(F.col("__r") <= F.col("__c0") + F.col("__c1"), names[1]).otherwise(names[2])
    return out.withColumn("share", label).drop("__n", "__r", "__c0", "__c1", "__c2", "__ok")
