"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the edges' ends; the edges are
written to the shared checkpoint folder after each round. Nothing is collected
but a count and a checksum. Edges become fewer with the rounds, so the number of
tasks follows their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import few, settle

#: Edges that a task takes at least.
EDGES = 50_000


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return few(few(moved, n, EDGES).distinct(), n, EDGES)


def _small_star(e: DataFrame, n: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return few(few(moved, n, EDGES).union(few(low, n, EDGES).select("u", F.col("m").alias("v"))).distinct(), n, EDGES)


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).collect()[0]
    return r.n, r.x


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest reachable node, for every node with an edge to another one.

    Edges with a null end and loops are ignored; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = settle(e)
    seen = _mark(e)
    for _ in range(max_rounds):
        n = seen[0]
        if not n:
            break
        e = settle(_small_star(_large_star(few(e, n, EDGES), n), n))
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
