"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded order; row r of n has the
fractional rank (r - 1/2) / n. Sorted by it, every stretch holds all sources in
proportion, so cutting the order into runs of equal length makes shards that
all match the mixture.

Both ranks are taken in buckets of bounded size whose counts are summed up:
first (source, part of the hash range), with more parts for larger sources,
then parts of the fractional rank, which are even by construction. Rows are
dealt by bucket explicitly, and the sizes of sources are broadcast where their
counted number allows it, so a source with most of all rows is spread like any
other. Rows are written once where a rank is known, not ranked anew for every
count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import settle, shuffle_partitions

#: Sources whose sizes are broadcast; beyond it they are joined by a shuffle on source and part of the hash range.
BROADCAST_SOURCES = 100_000
#: Parts of the hash range that a source's rows are dealt over in that join.
SALTS = 1024
#: Rows aimed at for a bucket.
BUCKET_ROWS = 256
#: Counters that are summed up in one group; the groups' totals are summed in a second step.
GROUP = 4096


def _running(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """counts(by, order, __rows) -> (by, order, __before): the rows of earlier buckets, in two levels."""
    grouped = counts.withColumn("__g", F.floor(F.col(order) / GROUP))
    outer = Window.partitionBy(*by).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*by, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = grouped.groupBy(*by, "__g").agg(F.sum("__rows").alias("__sum")).select(*by, "__g", zero(F.sum("__sum").over(outer)).alias("__base"))
    inside = grouped.select(*by, "__g", order, zero(F.sum("__rows").over(inner)).alias("__in"))
    return inside.join(groups, [*by, "__g"]).select(*by, order, (F.col("__in") + F.col("__base")).alias("__before"))


def interleave(df: DataFrame, id_col: str = "doc_id", stratum_col: str = "source", keep: dict | None = None, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df's id, stratum and the kept columns with __pos (gapless from 0) and __total.

    A null stratum is one of its own; equal ids are told apart by the kept
    columns, and equal rows are interchangeable. Rows of one id share a bucket:
    ids are meant to be keys.
    """
    keep = keep or {}
    base = df.select(df[id_col].alias("__id"), df[stratum_col].cast("string").alias("__s"), *[c.alias(n) for n, c in keep.items()])
    # 48 bits of md5: the same in every engine
    base = base.withColumn("__s", F.coalesce(F.concat(F.lit("s"), "__s"), F.lit("")))
    base = base.withColumn("__u", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long"))
    base = base.withColumn("__v", F.xxhash64("__u", "__id", *keep))
    n = shuffle_partitions(df.sparkSession)
    sizes = settle(base.groupBy("__s").agg(F.count("*").alias("__n")))
    n_sources, total = sizes.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).collect()[0]
    if n_sources <= BROADCAST_SOURCES:
        sized = base.join(F.broadcast(sizes), "__s")
    else:
        salt = F.pmod(F.col("__v"), F.lit(SALTS)).cast("int")
        sized = base.withColumn("__salt", salt).join(sizes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__s", "__salt"]).drop("__salt")
    parts = F.greatest(F.lit(1), F.ceil(F.col("__n") / bucket_rows))
    sized = sized.withColumn("__k", F.floor(F.col("__u") / F.lit(float(1 << 48)) * parts).cast("long"))
    order = ["__u", "__v", "__id", *keep]
    dealt = sized.repartition(n, "__s", "__k").withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__k").orderBy(*order)))
    dealt = settle(dealt)
    counts = _running(dealt.groupBy("__s", "__k").agg(F.count("*").alias("__rows")), ["__s"], "__k")
    # the join finds its left side dealt already
    placed = dealt.join(counts, ["__s", "__k"]).withColumn("__f", (F.col("__r") + F.col("__before") - 0.5) / F.col("__n")).drop("__k", "__before", "__r", "__n")
    cells = max(1, -(-total // bucket_rows))
    celled = placed.withColumn("__cell", F.least(F.floor(F.col("__f") * cells).cast("long"), F.lit(cells - 1)))
    local = F.row_number().over(Window.partitionBy("__cell").orderBy("__f", "__s", *order))
    celled = settle(celled.repartition(n, "__cell").withColumn("__l", local))
    starts = _running(celled.groupBy("__cell").agg(F.count("*").alias("__rows")), [], "__cell")
    return celled.join(starts, "__cell").withColumn("__pos", F.col("__l") + F.col("__before") - 1).withColumn("__total", F.lit(total).cast("long")).drop("__l", "__before", "__cell", "__f", "__v")


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): law 'rows', shard counts are at most one apart.

    size is the text's UTF-8 bytes (null: none) plus 16; slot is gapless from 0
    in each shard. Every row of df gets a shard, repeated rows too; an empty
    table gives no rows. The text isn't carried: join on the id to write files.
    """
    t = F.coalesce(df[text_col].cast("string"), F.lit(""))
    keep = {"size": (F.octet_length(t) + 16).cast("long"), "text_crc32": F.crc32(t)}
    rows = interleave(df, id_col, stratum_col, keep, seed, bucket_rows)
    # exact in whole numbers: shard = pos * n div total
    where = F.expr(f"int((__pos * {n_shards}L) div __total)")
    start = F.expr(f"(shard * __total + {n_shards - 1}L) div {n_shards}L")
    out = rows.withColumn("shard", where)
    return out.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("__pos") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
