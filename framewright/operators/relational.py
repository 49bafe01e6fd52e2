"""Joins and set operations with the semantics that graph and annotation files need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_ids(df: DataFrame, col: str, known: DataFrame, known_col: str) -> DataFrame:
    """Rows whose trimmed id is known."""
    return df.join(known.select(F.trim(F.col(known_col).cast("string")).alias("__k")).distinct(), F.trim(df[col].cast("string")) == F.col("__k"), "left_semi")


def skip_existing(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that aren't finished yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of base with a key of new are replaced by new's rows; new keys are added."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def lookup(df: DataFrame, path_col: str, wanted: str) -> DataFrame:
    """Rows whose path or file stem is the one that is asked for; one row."""
    stem = F.regexp_replace(F.regexp_extract(path_col, r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    want = wanted.replace("\\", "/").rsplit("/", 1)[-1]
    want = want.rsplit(".", 1)[0] if "." in want else want
    return df.where((F.col(path_col) == wanted) | (stem == want)).limit(1)


def last_by_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """A later duplicate wins."""
    w = Window.partitionBy(*keys).orderBy(F.col(ordinal).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replace_unless(left: DataFrame, right: DataFrame, keys: list[str], keep: Column, cols: dict[str, str]) -> DataFrame:
    """left with columns taken from right (name -> right's column) where `keep` isn't true and right has the key."""
    found = right.select(*keys, *[F.col(c).alias(f"__{n}") for n, c in cols.items()], F.lit(True).alias("__found"))
    out = left.join(found, keys, "left")
    take = F.coalesce(F.col("__found"), F.lit(False)) & ~F.coalesce(keep, F.lit(False))
    for n in cols:
        out = out.withColumn(n, F.when(take, F.col(f"__{n}")).otherwise(F.col(n)))
    return out.drop("__found", *[f"__{n}" for n in cols])


def synonym_map(values: DataFrame, value: str, canonical: Column) -> DataFrame:
    """(value, representative) of phrases that share a canonical form with others.

    The representative is the most frequent, then the shortest, then the first by
    alphabet; groups of one and representatives themselves aren't listed.
    """
    counts = values.where(F.col(value) != "").groupBy(value).agg(F.count("*").alias("__n")).withColumn("__c", canonical).where("__c <> ''")
    w = Window.partitionBy("__c")
    best = F.first(value).over(w.orderBy(F.col("__n").desc(), F.length(value), value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.withColumn("__size", F.count("*").over(w)).withColumn("representative", best).where((F.col("__size") > 1) & (F.col(value) != F.col("representative"))).select(value, "representative")


def ordinal(df: DataFrame, order: list, name: str = "__ord") -> DataFrame:
    """df with a gapless number from 0 by a total order, without one sorted partition.

    Rows are range-partitioned and sorted; each partition's count gives the
    others their start. The counts are one number for each partition.
    """
    from framewright.session import settle, shuffle_partitions

    parts = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    held = settle(parts.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    sizes = {r["__p"]: r["n"] for r in held.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = F.create_map(*[F.lit(x) for p, s in starts for x in (p, s)])
    return held.withColumn(name, (F.element_at(table, F.col("__p")) + F.col("__m") - F.shiftleft(F.shiftright(F.col("__m"), 33), 33)).cast("long")).drop("__p", "__m")
