"""Seeded samples, shards, buckets and batches.

Order by a seeded hash stands for a shuffle: it is the same in every run and
needs no state. Draws differ from those of any generator, distributions don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.relational import ordinal


def seeded(key: str | Column, seed: int, *more) -> Column:
    """48 bits of md5 over 'key:seed:..', the same in every engine."""
    parts = [F.col(key) if isinstance(key, str) else key, F.lit(seed), *[F.lit(m) if not isinstance(m, Column) else m for m in more]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in parts])), 1, 12), 16, 10).cast("long")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement; all of a smaller one."""
    w = Window.partitionBy(group).orderBy(seeded(key, seed), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def shuffled(df: DataFrame, key: str, seed: int, epoch: int = 0, name: str = "position") -> DataFrame:
    """df with a gapless position in a seeded order."""
    return ordinal(df.withColumn("__h", seeded(key, seed + epoch)), ["__h", key], name).drop("__h")


def repeated(df: DataFrame, epochs: int, key: str, seed: int) -> DataFrame:
    """Every row once an epoch, epochs one after the other, each in an order of its own."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return ordinal(e.withColumn("__h", seeded(key, seed, F.col("epoch"))), ["epoch", "__h", key], "position").drop("__h")


def modulo_shard(df: DataFrame, order: list[str], shards: int, index: int) -> DataFrame:
    return ordinal(df, order).where(F.pmod("__ord", F.lit(shards)) == index).drop("__ord")


def rank_parts(df: DataFrame, order: list[str], parts: int, name: str = "part") -> DataFrame:
    """Contiguous parts in which the first ones have one row more."""
    d = ordinal(df, order)
    n = d.count()
    base, more = divmod(n, parts)
    cut = more * (base + 1)
    return d.withColumn(name, F.when(F.col("__ord") < cut, F.floor(F.col("__ord") / (base + 1))).otherwise(F.lit(more) + F.floor((F.col("__ord") - cut) / max(base, 1))).cast("int")).drop("__ord")


def worker_ranges(n: int, workers: int) -> list[tuple[int, int]]:
    """Equal shares rounded down; the last takes the rest."""
    each = n // workers
    return [(i * each, n if i == workers - 1 else (i + 1) * each) for i in range(workers)]


def length_grouped(df: DataFrame, key: str, length: str, batch: int, replicas: int, seed: int, epoch: int = 0, drop_last: bool = True) -> DataFrame:
    """(df, replica, chunk, position): rows by falling length are dealt out in turn; a replica's batches are shuffled as wholes.

    All replicas shuffle alike and end alike, so batches that meet have like lengths.
    """
    d = ordinal(df.withColumn("__neg", -F.col(length)), ["__neg", key]).withColumn("replica", F.pmod("__ord", F.lit(replicas)).cast("int")).withColumn("__i", F.floor(F.col("__ord") / replicas))
    if drop_last:
        n = df.count()
        usable = n // replicas // batch * batch
        d = d.where(F.col("__i") < usable)
    d = d.withColumn("chunk", F.floor(F.col("__i") / batch).cast("long"))
    order = d.select("chunk").distinct().withColumn("__h", seeded("chunk", seed + epoch))
    placed = ordinal(order, ["__h", "chunk"], "__c")
    return d.join(placed.select("chunk", "__c"), "chunk").withColumn("position", (F.col("__c") * batch + F.pmod("__i", F.lit(batch))).cast("long")).drop("__ord", "__i", "__c", "__neg")


def bucket_batches(df: DataFrame, key: str, bucket: str, batch: Column, replicas: int, seed: int, epoch: int = 0, drop_last: bool = True) -> DataFrame:
    """(df, replica, batch, slot): bucket by bucket; rows are shuffled, cycled up to a multiple of the replicas, dealt out and batched.

    batch: a bucket's batch size. Buckets come in a seeded order (bucket_rank).
    """
    w = Window.partitionBy(bucket)
    d = df.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(seeded(key, seed + epoch), key)) - 1).withColumn("__b", batch)
    more = F.pmod(-F.col("__n"), F.lit(replicas))
    times = F.ceil((more - F.col("__i")) / F.col("__n")).cast("int")  # how often a row is repeated as filling
    copies = d.withColumn("__k", F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(0)))))
    placed = copies.withColumn("__p", F.col("__i") + F.col("__k") * F.col("__n"))
    dealt = placed.withColumn("replica", F.pmod("__p", F.lit(replicas)).cast("int")).withColumn("__q", F.floor(F.col("__p") / replicas))
    dealt = dealt.withColumn("batch", F.floor(F.col("__q") / F.col("__b")).cast("int")).withColumn("slot", F.pmod("__q", F.col("__b")).cast("int"))
    if drop_last:
        per = F.ceil(F.col("__n") / replicas)
        dealt = dealt.where(F.col("batch") < F.floor(per / F.col("__b")))
    rank = df.select(bucket).distinct().withColumn("bucket_rank", seeded(F.col(bucket).cast("string"), seed + epoch + 1))
    return dealt.join(rank, bucket).drop("__n", "__i", "__k", "__p", "__q", "__b")


def resumed(df: DataFrame, consumed: int, total: int, batch: int, replica: int, replicas: int, seed: int, key: str) -> DataFrame:
    """A replica's rows after `consumed` ones of all: its contiguous share, in the epoch's order, from where it stood.

    Rows beyond the last whole global batch are left out, as in every epoch.
    """
    step = batch * replicas
    active = total // step * step
    epoch, done = divmod(consumed, active) if active else (0, 0)
    share = active // replicas
    d = ordinal(df, [key]).where((F.col("__ord") >= replica * share) & (F.col("__ord") < (replica + 1) * share)).drop("__ord")
    return shuffled(d, key, seed, epoch).where(F.col("position") >= done // replicas)


def gumbel_top(df: DataFrame, group: list[str], key: str, log_weight: str, k: str, seed: int) -> DataFrame:
    """df with `chosen`: k rows of each group drawn by weight without replacement."""
    u = (seeded(key, seed, *[F.col(g) for g in group]).cast("double") + 0.5) / float(1 << 48)
    noisy = F.col(log_weight) - F.log(-F.log(u))
    w = Window.partitionBy(*group).orderBy(F.desc("__z"), key)
    return df.withColumn("__z", noisy).withColumn("chosen", F.row_number().over(w) <= F.col(k)).drop("__z")


def _unit(*parts) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def corrupt_uniform(df: DataFrame, key: str, ids: str, mask: str, mask_id: int, seed: int, eps: float = 1e-3) -> DataFrame:
    """noisy_ids, noise_mask, p_mask: each supervised token is masked with the row's own probability eps + (1 - eps) u."""
    p = (1 - eps) * _unit(F.col(key), F.lit(seed)) + eps
    d = df.withColumn("p_mask", p)
    hit = F.zip_with(F.transform(ids, lambda _, i: _unit(F.col(key), F.lit(seed + 1), i) < F.col("p_mask")), mask, lambda h, m: h & (m.cast("int") == 1))
    d = d.withColumn("noise_mask", hit)
    return d.withColumn("noisy_ids", F.zip_with(ids, "noise_mask", lambda t, h: F.when(h, F.lit(mask_id)).otherwise(t)))


def corrupt_blocks(df: DataFrame, key: str, ids: str, mask: str, mask_id: int, seed: int, block: int | None = None, eps: float = 1e-3, half_life: float = 0.25) -> DataFrame:
    """noisy_ids, noise_mask: in each block round(m n) places are drawn, late ones rather than early ones while m is small.

    m is eps + (1 - eps) u of the block; without a block size the row is one
    block with at least one place. Draws need a row's hashes and length only, so
    no tokens travel to Python.
    """
    import pyarrow as pa

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for own, places, sizes in batches:
            h0, h1 = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (own, places))
            n = np.maximum(sizes.fill_null(0).to_numpy(zero_copy_only=False), 0)
            at = 0
            while at < len(n):  # some rows at a time
                to = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), PLACES, "right")) + at)
                offsets = np.r_[0, np.cumsum(n[at:to])].astype(np.int32)
                drawn = [pa.array(x) for x in _drawn(h0[at:to], h1[at:to], n[at:to], block, eps, half_life)]
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(drawn) if drawn else pa.array([], pa.bool_()))
                at = to

    noise = F.arrow_udf(run, "array<boolean>", F.ArrowUDFType.SCALAR_ITER)
    d = df.withColumn("__at", noise(F.xxhash64(F.col(key), F.lit(seed)), F.xxhash64(F.col(key), F.lit(seed + 1)), F.size(ids).cast("long")))
    d = d.withColumn("noise_mask", F.zip_with(mask, "__at", lambda m, h: (m.cast("int") != 0) & h)).drop("__at")
    return d.withColumn("noisy_ids", F.zip_with(ids, "noise_mask", lambda t, h: F.when(h, F.lit(mask_id)).otherwise(t)))


#: Places of the rows that are handed to the JVM at once, and of the blocks that are drawn from at once.
PLACES, DRAWS = 1 << 24, 1 << 15
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxhash64 of whole numbers of 32 bits as in Spark, with a hash to go on from."""
    h = (seed + _P5 + np.uint64(4)) ^ (x.astype(np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _share(h: np.ndarray) -> np.ndarray:
    """_unit of hashes."""
    return ((h & np.uint64((1 << 52) - 1)).astype(np.float64) + 0.5) / float(1 << 52)


def _drawn(h0: np.ndarray, h1: np.ndarray, n: np.ndarray, block: int | None, eps: float, half_life: float) -> Iterator[np.ndarray]:
    """Whether each place of the rows of n places is drawn, row after row, in parts."""
    for rows in [slice(None)] if block else [slice(i, i + 1) for i in np.flatnonzero(n)]:
        width = block or int(n[rows][0])
        each = -(-n[rows] // width)
        ends = np.cumsum(each)
        step = max(1, DRAWS // width)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, step):
            k = np.arange(lo, min(lo + step, int(ends[-1])))
            row = np.searchsorted(ends, k, "right")
            b = k - (ends[row] - each[row])
            size = np.minimum(width, n[rows][row] - b * width)
            m = eps + (1 - eps) * _share(_hashed(b, h0[rows][row]))
            many = np.maximum(np.rint(m * size).astype(np.int64), 0 if block else 1)
            i = np.arange(width)
            z = (((1 - m) * np.log(2.0) / (half_life * width))[:, None] * i) - np.log(-np.log(_share(_hashed(i, _hashed(b, h1[rows][row])[:, None]))))
            there = i < size[:, None]
            z[~there] = -np.inf
            low = np.take_along_axis(np.sort(z, axis=1), np.minimum(width - many, width - 1)[:, None], axis=1)
            hit = (z >= low) & (many > 0)[:, None] & there
            for r in np.flatnonzero(hit.sum(axis=1) != many):  # equal numbers: later places first
                hit[r] = False
                hit[r, np.argsort(z[r], kind="stable")[width - many[r] :]] = True
            yield hit[there]


def vocabulary(df: DataFrame, ids: str, mask: str, target: int, draft: int, specials: tuple[int, ...] = ()) -> DataFrame:
    """(place, token): specials in their order, supervised tokens by falling count (smaller id first), then other ids; draft in all.

    Counting combines on the map side; the rest is a table of at most `target` rows.
    """
    spark = df.sparkSession
    tokens = df.select(F.explode(F.arrays_zip(F.col(ids).alias("t"), F.col(mask).alias("m"))).alias("z")).where("z.m = 1 and z.t >= 0").where(F.col("z.t") < target)
    counts = tokens.groupBy(F.col("z.t").cast("long").alias("token")).agg(F.count("*").alias("n"))
    first = [s for i, s in enumerate(specials) if s is not None and 0 <= s < target and s not in specials[:i]]
    head = spark.createDataFrame([(s, i) for i, s in enumerate(first)], "token long, spot long")
    every = spark.range(target).withColumnRenamed("id", "token").join(F.broadcast(head), "token", "left").join(counts, "token", "left")  # as many specials as are named
    tier = F.when(F.col("spot").isNotNull(), 0).when(F.col("n").isNotNull(), 1).otherwise(2)
    d = every.withColumn("__t", tier).withColumn("__a", F.coalesce("spot", -F.coalesce("n", F.lit(0))))
    return ordinal(d, ["__t", "__a", "token"], "place").where(F.col("place") < draft).select("place", "token")


def keyframes(df: DataFrame, group: list[str], frame: str, features: list[str], window: int = 30, per: int = 15, max_gap: int | None = None, seed: int = 0) -> DataFrame:
    """(group, frame): in windows of `window` frames the frames nearest the centres of n // per clusters of their features.

    A grouped Arrow map on (group, window): each is `window` rows. With max_gap,
    frames are added so that no gap between chosen ones of a window is longer.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    d = df.withColumn("__w", F.floor(F.col(frame) / window))

    def run(key, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(frame)
        v = x[features].to_numpy(float)
        k = max(1, len(x) // per)
        rng = np.random.default_rng(seed)
        c = v[rng.choice(len(v), k, replace=False)]
        for _ in range(50):
            near = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([v[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        at = {int(((v - m) ** 2).sum(axis=1).argmin()) for m in c}
        f = x[frame].to_numpy()
        if max_gap:
            last = f[min(at)]
            for i in range(min(at), len(f)):
                if i in at:
                    last = f[i]
                elif f[i] - last >= max_gap:
                    at.add(i)
                    last = f[i]
        return pd.DataFrame({**{g: x[g].iloc[0] for g in group}, frame: f[sorted(at)]})

    return d.groupBy(*group, "__w").applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*group, frame)))


def cover_frames(frames: dict[int, set], centre: float, n: int, gap: int = 2) -> list[int]:
    """n frames: those that add most objects first, kept `gap` apart, then fullest and most central ones, then any."""
    rank = sorted(frames, key=lambda f: (-len(frames[f]), abs(f - centre), f))
    left = set().union(*frames.values()) if frames else set()
    chosen: list[int] = []
    apart = lambda f: all(abs(f - c) >= gap for c in chosen)
    while left and len(chosen) < n:
        free = [f for f in rank if f not in chosen and apart(f)]
        best = max(free, key=lambda f: len(frames[f] & left), default=None)
        if best is None or not frames[best] & left:
            break
        chosen.append(best)
        left -= frames[best]
    for more in ([f for f in rank], rank):
        for f in more:
            if len(chosen) >= n:
                break
            if f not in chosen and (apart(f) or more is rank):
                chosen.append(f)
    return sorted(chosen[:n])
