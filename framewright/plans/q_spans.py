"""Queries over spans, joins and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import arrays, interval
from framewright.graph import queries as gq
from framewright.graph import tables
from framewright.metrics import tubes
from framewright.operators import pairs, relational, spans
from framewright.operators.components import connected_components
from framewright.plans.registry import query, table
from framewright.plans.shapes import FRAMES, PAIRS, SPANS, TIOU, frames, r6, span_pair_counts, span_pairs, user_spans


@query("spans_gaps_islands", f"WITH {SPANS} SELECT * FROM sp")
def spans_gaps_islands(spark: SparkSession, sf: str) -> DataFrame:
    return user_spans(spark, sf)


@query("spans_array_runs", f"WITH {SPANS} SELECT user_id, event_type, count(*) AS n_runs, min(s) AS first_s, max(e) AS last_e FROM sp GROUP BY ALL")
def spans_array_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The array form inside a row."""
    a = frames(spark, sf).groupBy("user_id", "event_type").agg(spans.runs(F.collect_set("frame")).alias("r"))
    return a.select("user_id", "event_type", F.size("r").cast("long").alias("n_runs"), F.get("r.s", F.lit(0)).alias("first_s"), F.element_at("r.e", -1).alias("last_e"))


@query("spans_merge_adjacent", f"""WITH {FRAMES}, w AS (SELECT DISTINCT user_id, event_type, frame AS s, frame + 2 AS e FROM f),
o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM w),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, event_type, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, event_type, k""")
def spans_merge_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).select("user_id", "event_type", F.col("frame").alias("s"), (F.col("frame") + 2).alias("e"))
    return spans.merge_spans(f, ["user_id", "event_type"])


@query("sessions_max_gap", f"""WITH {FRAMES}, o AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id, event_type ORDER BY frame) > 15 THEN 1 ELSE 0 END AS n FROM f),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY frame RANGE UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, event_type, min(frame) AS s, max(frame) AS e, count(*) AS n, round(avg(value), 6) AS mean_score, max(value) AS peak_score, arg_min(frame, (-value, frame)) AS peak_frame FROM g GROUP BY user_id, event_type, k""")
def sessions_max_gap(spark: SparkSession, sf: str) -> DataFrame:
    return spans.sessions(frames(spark, sf), ["user_id", "event_type"], "frame", "value", 15).withColumn("mean_score", r6(F.col("mean_score")))


@query("overlap_join_tiou", f"WITH {PAIRS} SELECT *, round({TIOU}, 6) AS tiou FROM pr")
def overlap_join_tiou(spark: SparkSession, sf: str) -> DataFrame:
    return span_pairs(spark, sf, {"tiou": r6(interval.tiou_closed(*map(F.col, ("s", "e", "s2", "e2"))))})


@query("tiou_half_open", f"""WITH {PAIRS}, t AS (SELECT *, (least(e, e2) + 1 - greatest(s, s2))::DOUBLE / ((e + 1 - s) + (e2 + 1 - s2) - (least(e, e2) + 1 - greatest(s, s2))) AS t FROM pr)
SELECT event_type, user_a, user_b, s, s2, round(t, 6) AS tiou, t > 0.3 AS over3, t > 0.5 AS over5 FROM t""")
def tiou_half_open(spark: SparkSession, sf: str) -> DataFrame:
    t = interval.tiou_half_open(F.col("s"), F.col("e") + 1, F.col("s2"), F.col("e2") + 1)
    return span_pairs(spark, sf, {"tiou": r6(t), "over3": t > 0.3, "over5": t > 0.5}).select("event_type", "user_a", "user_b", "s", "s2", "tiou", "over3", "over5")


@query("tiou_hull", f"""WITH {PAIRS} SELECT event_type, user_a, user_b, s, s2, round(coalesce((least(e, e2) - greatest(s, s2))::DOUBLE / nullif(greatest(e, e2) - least(s, s2), 0), 0), 6) AS tiou FROM pr""")
def tiou_hull(spark: SparkSession, sf: str) -> DataFrame:
    return span_pairs(spark, sf, {"tiou": r6(interval.tiou_hull(*map(F.col, ("s", "e", "s2", "e2"))))}).select("event_type", "user_a", "user_b", "s", "s2", "tiou")


@query("temporal_tags", f"""WITH {SPANS} SELECT user_id, event_type, s, e, array_to_string(list_sort(list_transform(range(s // 24, e // 24 + 1), lambda k: 'clip_' || k)), ',') AS tags FROM sp""")
def temporal_tags(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    days = f.agg(F.max(F.floor(F.col("frame") / 24)).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("clip_id"))
    shots = days.select(F.lit("v").alias("video_path"), "clip_id", (F.col("clip_id") * 24).alias("s"), (F.col("clip_id") * 24 + 23).alias("e"))
    m = user_spans(spark, sf).withColumn("video_path", F.lit("v"))
    return tables.member_tags(m, shots, 24).select("user_id", "event_type", "s", "e", F.array_join("tags", ",").alias("tags"))


_JACCARD = f"""{FRAMES}, k AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM f), n AS (SELECT user_id, count(*) AS n FROM k GROUP BY 1),
i AS (SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.user_id < b.user_id GROUP BY 1, 2),
j AS (SELECT i.*, shared::DOUBLE / (x.n + y.n - shared) AS jaccard FROM i JOIN n x ON x.user_id = user_a JOIN n y ON y.user_id = user_b)"""


def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"))


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that share a token, by products of blocks of users."""
    k = token_sets(spark, sf).where("k is not null and user_id is not null").distinct()
    p = pairs.shared_token_pairs(k, "user_id", "k")
    return p.select(F.col("a").alias("user_a"), F.col("b").alias("user_b"), "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


@query("jaccard_users", f"WITH {_JACCARD} SELECT user_a, user_b, shared, round(jaccard, 6) AS jaccard FROM j")
def jaccard_users(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_pairs(spark, sf).withColumn("jaccard", r6(F.col("jaccard")))


@query("jaccard_neighbours", f"WITH {_JACCARD} SELECT user_a, user_b, round(jaccard, 6) AS jaccard FROM j WHERE user_b = user_a + 1")
def jaccard_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The array form, on users with neighbouring ids."""
    sets = token_sets(spark, sf).groupBy("user_id").agg(F.collect_set("k").alias("ks"))
    nxt = sets.select((F.col("user_id") - 1).alias("user_a"), F.col("user_id").alias("user_b"), F.col("ks").alias("kb"))
    j = sets.withColumnRenamed("user_id", "user_a").join(nxt, "user_a").withColumn("j", arrays.jaccard(F.col("ks"), F.col("kb")))
    return j.where("j > 0").select("user_a", "user_b", r6(F.col("j")).alias("jaccard"))


@query("spatial_confusability", f"""WITH {_JACCARD.replace(FRAMES, PAIRS)}, c AS (SELECT pr.*, jaccard * {TIOU} AS c FROM pr JOIN j USING (user_a, user_b)),
both_ AS (SELECT event_type, user_a AS user_id, s, e, c FROM c UNION ALL SELECT event_type, user_b, s2, e2, c FROM c)
SELECT event_type, user_id, s, e, count(*) AS rivals, round(sum(c * c), 6) AS mass, round(sum(c * c) / (1 + sum(c * c)), 6) AS d_s FROM both_ GROUP BY ALL""")
def spatial_confusability(spark: SparkSession, sf: str) -> DataFrame:
    k = token_sets(spark, sf).where("k is not null and user_id is not null").distinct()
    g = pairs.confusable(user_spans(spark, sf), k, "event_type", "user_id", "k")
    return g.select("event_type", "user_id", "s", "e", "rivals", r6(F.col("m")).alias("mass"), r6(F.col("m") / (1 + F.col("m"))).alias("d_s"))


@query("difficulty_bucket5", f"""WITH {FRAMES}, d AS (SELECT *, (frame % 100) / 99.0 AS d FROM f)
SELECT CASE WHEN d < 0.2 THEN 'very_easy' WHEN d < 0.4 THEN 'easy' WHEN d < 0.6 THEN 'medium' WHEN d < 0.8 THEN 'hard' ELSE 'very_hard' END AS label, count(*) AS n, round(avg(value), 6) AS mean_value FROM d GROUP BY 1""")
def difficulty_bucket5(spark: SparkSession, sf: str) -> DataFrame:
    d = frames(spark, sf).withColumn("label", interval.difficulty_label5(F.pmod("frame", F.lit(100)) / 99.0))
    return d.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query("difficulty_bucket3", f"""WITH {FRAMES}, d AS (SELECT *, (frame % 60) / 99.0 AS d FROM f), g AS (SELECT CASE WHEN d < 1.0 / 3 THEN 'easy' WHEN d < 2.0 / 3 THEN 'medium' ELSE 'hard' END AS grp, count(*) AS n, avg(value) AS m FROM d GROUP BY 1)
SELECT b AS "group", coalesce(n, 0) AS num_samples, round(coalesce(m, 0), 6) AS m_value FROM (VALUES ('easy'), ('medium'), ('hard')) v(b) LEFT JOIN g ON g.grp = b""")
def difficulty_bucket3(spark: SparkSession, sf: str) -> DataFrame:
    d = frames(spark, sf).withColumn("difficulty_score", F.pmod("frame", F.lit(60)) / 99.0).withColumn("m_value", F.col("value"))
    return tubes.means_by_thirds(d, metrics=("m_value",)).select("group", "num_samples", r6(F.col("m_value")).alias("m_value"))


@query("metric_grouping_sets", f"""WITH {PAIRS}, t AS (SELECT event_type, {TIOU} AS t FROM pr)
SELECT coalesce(event_type, 'overall') AS "group", count(*) AS num_samples, round(avg(t), 6) AS m_tIoU, round(avg((t >= 0.3)::INT), 6) AS r3, round(avg((t >= 0.5)::INT), 6) AS r5 FROM t GROUP BY GROUPING SETS ((), (event_type))""")
def metric_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    t = tubes.temporal_score(span_pair_counts(spark, sf), "s", "e", "s2", "e2").withColumnRenamed("tIoU@0.3", "r3").withColumnRenamed("tIoU@0.5", "r5")
    m = tubes.means(t, "event_type", ("m_tIoU", "r3", "r5"), "pairs")
    return m.select("group", "num_samples", *[r6(F.col(c)).alias(c) for c in ("m_tIoU", "r3", "r5")])


@query("sampling_buckets_30_45_25", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
w AS (SELECT *, floor(0.3 * n) AS a, floor(0.45 * n) AS b, floor(0.25 * n) AS c0, 0.3 * n - floor(0.3 * n) AS ra, 0.45 * n - floor(0.45 * n) AS rb, 0.25 * n - floor(0.25 * n) AS rc FROM c),
k AS (SELECT *, n - a - b - c0 AS left_, (rb > ra)::INT + (rc > ra)::INT AS pa, (ra >= rb)::INT + (rc > rb)::INT AS pb FROM w),
x AS (SELECT *, a + (pa < left_)::INT AS e1, b + (pb < left_)::INT AS m1 FROM k)
SELECT p_partkey, CASE WHEN r <= e1 THEN 'easy' WHEN r <= e1 + m1 THEN 'medium' ELSE 'hard' END AS share FROM x""")
def sampling_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return spans.share_buckets(table(spark, sf, "part"), ["p_brand"], ["p_retailprice", "p_partkey"], {"easy": 0.30, "medium": 0.45, "hard": 0.25}).select("p_partkey", "share")


@query("limit_round_robin", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k FROM orders),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (k > 1)::INT, o_orderpriority, o_totalprice, o_orderkey) AS rank FROM k WHERE k <= 2)
SELECT o_custkey, o_orderkey, rank FROM c WHERE rank <= 6""")
def limit_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return spans.limit_round_robin(o, ["o_custkey"], level, ["o_totalprice", "o_orderkey"], 6, 2).select("o_custkey", "o_orderkey", F.col("__rank").cast("long").alias("rank"))


@query("dedupe_signature", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_linenumber, l_extendedprice, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def dedupe_signature(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    return spans.first_by_signature(l, ["l_orderkey"], F.array("l_partkey", "l_suppkey"), ["l_linenumber", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("skip_existing_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def skip_existing_anti(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.skip_existing(table(spark, sf, "customer"), done, ["c_custkey"]).select("c_custkey", "c_name")


@query("valid_ids_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def valid_ids_semi(spark: SparkSession, sf: str) -> DataFrame:
    return relational.valid_ids(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size > 25"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("lookup_by_stem", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def lookup_by_stem(spark: SparkSession, sf: str) -> DataFrame:
    return relational.lookup(table(spark, sf, "customer"), "c_name", "videos/Customer#000000007.mp4").select("c_custkey", "c_name")


@query("last_duplicate_wins", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1")
def last_duplicate_wins(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey"))  # noqa: E741
    return relational.last_by_key(l, ["l_orderkey"], "o").select("l_orderkey", "l_linenumber", "l_partkey")


@query("track_expand_left_join", """WITH t AS (SELECT l_orderkey AS k, min(l_linenumber) AS s, max(l_linenumber) AS e FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR t.k IS NULL THEN 0 ELSE t.s END AS s, CASE WHEN o_orderstatus = 'O' OR t.k IS NULL THEN 0 ELSE t.e END AS e FROM orders LEFT JOIN t ON t.k = o_orderkey""")
def track_expand_left_join(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("ts"), F.max("l_linenumber").alias("te"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("s"), F.lit(0).alias("e"))
    return relational.replace_unless(o, t, ["o_orderkey"], F.col("o_orderstatus") == "O", {"s": "ts", "e": "te"}).drop("o_orderstatus")


@query("upsert_by_key", """WITH n AS (SELECT c_custkey + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1000000 ELSE 0 END AS c_custkey, 'new ' || c_name AS c_name FROM customer WHERE c_acctbal < 0)
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n""")
def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    new = c.where("c_acctbal < 0").select((F.col("c_custkey") + F.when(F.col("c_mktsegment") == "MACHINERY", 1000000).otherwise(0)).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"))
    return relational.upsert(c.select("c_custkey", "c_name"), new, ["c_custkey"])


@query("shared_pairs", """WITH l AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS shared FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_frame_pairs(table(spark, sf, "lineitem"), [], "l_partkey", "l_orderkey", 2)


@query("pair_top_ranked", f"""WITH {PAIRS}, r AS (SELECT *, greatest(0, greatest(s, s2) - least(e, e2)) AS gap, greatest(e, e2) - least(s, s2) AS width FROM pr),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_a, user_b ORDER BY gap, width, s, e, s2, e2) AS k FROM r) SELECT event_type, user_a, user_b, s, e, s2, e2, gap, width, k FROM k WHERE k <= 2""")
def pair_top_ranked(spark: SparkSession, sf: str) -> DataFrame:
    best = pairs.best_overlaps(user_spans(spark, sf), "event_type", "user_id", 2)
    return best.select("event_type", F.col("a").alias("user_a"), "s", "e", F.col("b").alias("user_b"), "s2", "e2", "gap", "width", "k")


@query("interval_downsample", f"""WITH {SPANS}, l AS (SELECT user_id, event_type, list((s, e) ORDER BY s, e) AS a FROM sp GROUP BY ALL),
x AS (SELECT user_id, event_type, CASE WHEN len(a) <= 12 THEN len(a) ELSE least(12, 2 + len(range(1, len(a) - 1, greatest(1, len(a) // 10)))) END AS kept, len(a) AS had FROM l) SELECT user_id, event_type, kept, had FROM x""")
def interval_downsample(spark: SparkSession, sf: str) -> DataFrame:
    g = user_spans(spark, sf).groupBy("user_id", "event_type").agg(F.collect_list(F.struct("s", "e")).alias("a"))
    return g.select("user_id", "event_type", F.size(spans.downsample(F.col("a"), 12)).cast("long").alias("kept"), F.size("a").cast("long").alias("had"))


@query("as_of_next_start", f"""WITH {FRAMES}, st AS (SELECT DISTINCT user_id, frame AS b FROM f WHERE event_type = 'click'), p AS (SELECT DISTINCT user_id, frame FROM f WHERE event_type = 'view')
SELECT p.user_id, p.frame, coalesce((SELECT min(b) FROM st WHERE st.user_id = p.user_id AND b >= p.frame AND b < 700), 700) AS next FROM p""")
def as_of_next_start(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    pos = f.where("event_type = 'view'").select("user_id", "frame").distinct()
    starts = f.where("event_type = 'click'").select("user_id", F.col("frame").alias("b")).distinct()
    return spans.frames_until(pos, starts, ["user_id"], "frame", "b", 700).withColumnRenamed("__next", "next")


@query("connected_components", "SELECT o_orderkey + 100000000 AS node, o_custkey AS component FROM orders UNION SELECT o_custkey, o_custkey FROM orders")
def components(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select((F.col("o_orderkey") + 100000000).alias("u"), F.col("o_custkey").alias("v"))
    return connected_components(e)


@query("solver_summary", """WITH c AS (SELECT l_orderkey AS k, l_returnflag AS solver, l_linestatus = 'F' AS feasible, CASE WHEN l_linestatus = 'F' THEN l_quantity::INT END AS objective, l_tax AS t FROM lineitem),
b AS (SELECT *, min(objective) OVER (PARTITION BY k) AS best FROM c), d AS (SELECT *, sum((objective = best)::INT) OVER (PARTITION BY k) AS ties FROM b),
g AS (SELECT solver, count(*) AS n, sum(feasible::INT) AS ok, sum(CASE WHEN feasible AND objective = best THEN 1 ELSE 0 END) AS opt, avg(CASE WHEN feasible THEN objective / best - 1 END) AS gap, sum(CASE WHEN feasible AND objective = best AND ties = 1 THEN 1 ELSE 0 END) AS wins, max(CASE WHEN feasible THEN objective / best END) AS worst, list(t ORDER BY t) AS ts FROM d GROUP BY 1)
SELECT solver, n AS n_cases, round(ok / n, 6) AS success_rate, round(opt / ok, 6) AS optimality_rate, round(gap, 6) AS mean_opt_gap, round(wins / n, 6) AS win_rate, round(worst, 6) AS approx_ratio_max, ts[greatest(0, floor(0.95 * n)::INT - 1) + 1] AS p95_time_sec FROM g""")
def solver_summary(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    c = l.select("l_orderkey", F.col("l_returnflag").alias("solver"), (F.col("l_linestatus") == "F").alias("feasible"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int")).alias("objective"), F.col("l_tax").alias("time_sec"))
    s = gq.solver_summary(c, ["l_orderkey"])
    return s.select("solver", "n_cases", *[r6(F.col(x)).alias(x) for x in ("success_rate", "optimality_rate", "mean_opt_gap", "win_rate", "approx_ratio_max")], "p95_time_sec")


@query("temporal_bins", f"""WITH {SPANS} SELECT user_id, event_type, s, greatest(0, least(round_even(least(s, 99) / 99.0 * 199, 0)::BIGINT, 199)) AS frame FROM sp""")
def temporal_bins(spark: SparkSession, sf: str) -> DataFrame:
    return user_spans(spark, sf).select("user_id", "event_type", "s", interval.temporal_bin_to_frame(F.least("s", F.lit(99)), F.lit(100), F.lit(200)).alias("frame"))


@query("even_selection", """SELECT o_custkey, count(*) AS n, array_to_string(list_transform(CASE WHEN count(*) <= 4 THEN range(count(*)) ELSE list_transform(range(4), lambda i: round_even(i * (count(*) - 1) / 3.0, 0)::BIGINT) END, lambda i: i::VARCHAR), ',') AS at FROM orders GROUP BY 1""".replace("list_transform(range(4), lambda i: round_even(i * (count(*) - 1) / 3.0, 0)::BIGINT)", "[0, round_even((count(*) - 1) / 3.0, 0)::BIGINT, round_even(2 * (count(*) - 1) / 3.0, 0)::BIGINT, count(*) - 1]"))
def even_selection(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.withColumn("at", F.array_join(F.transform(arrays.even_positions(F.col("n"), F.lit(4)), lambda i: i.cast("string")), ","))
