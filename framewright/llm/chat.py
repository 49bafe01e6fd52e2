"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

Chat services log a conversation again after every turn. A rolling hash of
the turns so far identifies a logged conversation that is a prefix of a longer
one; anti-joins keep the maximal conversations, which are then rendered.

The hash of a prefix is the XOR of its turns' hashes, each salted with the
turn's place, in two independent 64-bit halves. XOR is associative and
commutative, so it is summed up in chunks of CHUNK turns. Turns are dealt by
conversation and chunk, explicitly, so a very long conversation is spread like
any other; what is joined by conversation alone has a row for each conversation
on one side, and Spark may split the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import settle, shuffle_partitions

CHUNK = 256
PAIR = ["__a", "__b"]


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each (conversation, turn): messages of one turn are ordered by role and text."""
    chosen = df.select(df[conv].alias("__c"), df[turn].cast("long").alias("__t"), df[role].cast("string").alias("__role"), df[text].cast("string").alias("__text"))
    return chosen.where("__c is not null and __t is not null").distinct()


def _hashed(turns: DataFrame, chunk: int) -> DataFrame:
    """(c, k, t, a, b): hashes of the turns, salted with their distance from the conversation's first turn; k is the chunk."""
    first = turns.groupBy("__c").agg(F.min("__t").alias("__first"))
    at = F.col("__t") - F.col("__first")
    each = turns.join(first, "__c").select("__c", F.floor(F.col("__t") / chunk).alias("__k"), "__t", F.xxhash64(at, "__role", "__text", F.lit(1)).alias("__a"), F.xxhash64(F.lit(2), "__text", at, "__role").alias("__b"))
    dealt = each.repartition(shuffle_partitions(turns.sparkSession), "__c", "__k")
    return dealt.groupBy("__c", "__k", "__t").agg(*[F.bit_xor(x).alias(x) for x in PAIR])


def _prefixes(hashed: DataFrame) -> DataFrame:
    """(c, a, b, n, whole): rolling values of all turns up to each one, their number, and whether it is the last."""
    sums = hashed.groupBy("__c", "__k").agg(*[F.bit_xor(x).alias(f"{x}s") for x in PAIR], F.count("*").alias("__ns"))
    chunks = Window.partitionBy("__c").orderBy("__k")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__c", "__k", *[F.coalesce(F.bit_xor(f"{x}s").over(before), F.lit(0)).alias(f"{x}0") for x in PAIR], F.coalesce(F.sum("__ns").over(before), F.lit(0)).alias("__n0"), F.lead("__k").over(chunks).isNull().alias("__end"))
    turns = Window.partitionBy("__c", "__k").orderBy("__t")
    inside = turns.rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("__c", "__k", *[F.bit_xor(x).over(inside).alias(x) for x in PAIR], F.row_number().over(turns).alias("__n"), F.lead("__t").over(turns).isNull().alias("__stop"))
    return rolled.join(base, ["__c", "__k"]).select("__c", *[F.col(x).bitwiseXOR(F.col(f"{x}0")).alias(x) for x in PAIR], (F.col("__n") + F.col("__n0")).alias("__n"), (F.col("__end") & F.col("__stop")).alias("__whole"))


def maximal_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that prefix no longer one.

    Of equal conversations the one with the smallest id stays; n_copies counts
    them. Rows with a null conversation or turn are dropped, null roles and
    texts equal only nulls, repeated rows count once, turns may have gaps and
    start anywhere (only distances count). An empty table gives no rows.
    """
    rolled = settle(_prefixes(_hashed(_turns(df, conv, turn, role, text), chunk)))
    whole = rolled.where("__whole").groupBy(*PAIR, "__n").agg(F.min("__c").alias("__c"), F.count("*").alias("__copies"))
    proper = rolled.where("not __whole").select(*PAIR, "__n").distinct()
    return whole.join(proper, [*PAIR, "__n"], "left_anti").select(F.col("__c").alias(conv), F.col("__n").alias("n_turns"), F.col("__copies").alias("n_copies"))


def render_turn(role: Column, text: Column) -> Column:
    """One message between markers; a null role is 'user', a null text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv, part, n_turns, n_copies, rendered) of the maximal conversations.

    A part holds the turns of one chunk, in order; all parts of a conversation
    but the unusually long ones are number 0. Concatenated by part they are the
    whole rendering. For other cases see maximal_conversations.
    """
    kept = maximal_conversations(df, conv, turn, role, text, chunk).select(F.col(conv).alias("__c"), "n_turns", "n_copies")
    turns = _turns(df, conv, turn, role, text)
    spans = turns.groupBy("__c").agg(F.min("__t").alias("__first"))
    part = F.floor((F.col("__t") - F.col("__first")) / chunk).cast("long")
    dealt = turns.join(kept.join(spans, "__c"), "__c").withColumn("part", part).repartition(shuffle_partitions(df.sparkSession), "__c", "part")
    rows = dealt.groupBy("__c", "part", "n_turns", "n_copies")
    entry = F.struct("__t", "__role", "__text")
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda m: render_turn(m["__role"], m["__text"]))
    return rows.agg(F.array_join(texts, "").alias("rendered")).select(F.col("__c").alias(conv), "part", "n_turns", "n_copies", "rendered")
