"""Streaming forms: sessions, shuffles with a buffer, chained views of an endless row source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.prep import sampling


def session_stream(events: DataFrame, ts: str, keys: list[str], value: str, gap: str, late: str) -> DataFrame:
    """(keys, start, end, n, mean_value, peak_value): sessions that a longer silence than gap ends; rows later than `late` are dropped."""
    s = F.session_window(ts, gap)
    g = events.withWatermark(ts, late).groupBy(*keys, s.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("peak_value"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value", "peak_value")


def windowed_stream(events: DataFrame, ts: str, keys: list[str], value: str, width: str, slide: str, late: str) -> DataFrame:
    """Tumbling (width = slide) or sliding counts and sums with a watermark."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def buffered_shuffle(rows: DataFrame, key: str, payload: str, lanes: int, buffer: int, seed: int, idle_ms: int = 1000) -> DataFrame:
    """(lane, key, payload): rows in a seeded random order by a buffer of fixed size a lane; every row comes out once.

    A new row takes the place of a random one of a full buffer, which goes out.
    A lane that hears nothing for idle_ms gives what it still holds.
    """
    kinds = dict(rows.dtypes)
    d = rows.select(F.pmod(F.xxhash64(key), lanes).cast("int").alias("lane"), F.col(key).alias("k"), F.col(payload).alias("v"))

    def step(lane, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import random

        held_k, held_v, n = state.get if state.exists else ([], [], 0)
        held_k, held_v = list(held_k), list(held_v)
        out_k, out_v = [], []
        if state.hasTimedOut:
            out_k, out_v, held_k, held_v = held_k, held_v, [], []
            state.remove()
        else:
            for x in parts:
                for k, v in zip(x["k"], x["v"]):
                    n += 1
                    if len(held_k) < buffer:
                        held_k.append(k)
                        held_v.append(v)
                    else:
                        i = random.Random(f"{seed}:{lane[0]}:{n}").randrange(buffer)
                        out_k.append(held_k[i])
                        out_v.append(held_v[i])
                        held_k[i], held_v[i] = k, v
            state.update((held_k, held_v, n))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"lane": [lane[0]] * len(out_k), "k": out_k, "v": out_v})

    kk, vk = kinds[key], kinds[payload]
    out = d.groupBy("lane").applyInPandasWithState(step, f"lane int, k {kk}, v {vk}", f"ks array<{kk}>, vs array<{vk}>, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select("lane", F.col("k").alias(key), F.col("v").alias(payload))


def reservoir_order(keys: list, buffer: int, seed: int) -> list:
    """The same rule on a list: all keys once."""
    import random

    rng, held, out = random.Random(seed), [], []
    for k in keys:
        if len(held) < buffer:
            held.append(k)
        else:
            i = rng.randrange(buffer)
            out.append(held[i])
            held[i] = k
    rng.shuffle(held)
    return out + held


def without_tail(stream: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Starts writing a stream as Parquet; with once, what is there now and no more."""
    w = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start(folder)


@dataclass(frozen=True)
class Rows:
    """A row source with shard, shuffle, take and epoch, chained as often as wanted; nothing runs before df().

    Takes nest to the least; a shard is of the ordered rows, before any shuffle.
    """

    source: DataFrame
    key: str
    parts: tuple[int, int] | None = None
    seed: int | None = None
    most: int | None = None
    epoch: int = 0

    def shard(self, shards: int, index: int) -> Rows:
        return replace(self, parts=(shards, index))

    def shuffle(self, seed: int) -> Rows:
        return replace(self, seed=seed)

    def take(self, n: int) -> Rows:
        return replace(self, most=n if self.most is None else min(n, self.most))

    def set_epoch(self, epoch: int) -> Rows:
        return replace(self, epoch=epoch)

    def df(self) -> DataFrame:
        d = self.source
        if self.parts:
            d = sampling.modulo_shard(d, [self.key], *self.parts)
        if self.seed is not None:
            d = sampling.shuffled(d, self.key, self.seed, self.epoch)
            return d.where(F.col("position") < self.most) if self.most is not None else d
        return d.orderBy(self.key).limit(self.most) if self.most is not None else d

    def after(self, consumed: int) -> DataFrame:
        """What is left of an epoch once so many rows are used."""
        if self.seed is None:
            raise ValueError("only a shuffled source can be resumed by position")
        return self.df().where(F.col("position") >= consumed)


def endless(spark: SparkSession, rows: DataFrame, ordinal: str, n: int, per_second: int) -> DataFrame:
    """(epoch, row): an unbounded stream that repeats n numbered rows, epoch by epoch, at a rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    t = ticks.select(F.floor(F.col("value") / n).cast("long").alias("epoch"), F.pmod("value", F.lit(n)).alias("__o"))
    return t.join(rows, t["__o"] == rows[ordinal]).drop("__o")
