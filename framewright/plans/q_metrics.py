"""Queries over boxes, tubes, classifications, detections and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import box, media
from framewright.metrics import classify, detect, retrieve, tubes
from framewright.operators import curves
from framewright.plans.registry import query, table
from framewright.plans.shapes import FRAMES, PAIRS, SPANS, TIOU, frames, r6, span_pair_counts, user_spans

_BOX = "l_quantity AS x1, l_discount * 100 AS y1, l_quantity + l_extendedprice / 5000 AS x2, l_discount * 100 + 10 + l_tax * 100 AS y2"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    b = box.box(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + F.col("l_extendedprice") / 5000, F.col("l_discount") * 100 + 10 + F.col("l_tax") * 100)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", b.alias("b"))


def _pairs_sql(value: str, name: str) -> str:
    return f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, {_BOX} FROM lineitem), p AS (SELECT a.l_orderkey, a.l_linenumber AS la, b.l_linenumber AS lb, a.l_partkey AS pa, b.l_partkey AS pb, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND (a.l_linenumber, a.l_partkey) < (b.l_linenumber, b.l_partkey)), i AS (SELECT *, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS i, greatest(0, least(ax2, bx2) - greatest(ax1, bx1) + 1) * greatest(0, least(ay2, by2) - greatest(ay1, by1) + 1) AS ip,
(ax2 - ax1) * (ay2 - ay1) AS sa, (bx2 - bx1) * (by2 - by1) AS sb, (ax2 - ax1 + 1) * (ay2 - ay1 + 1) AS sap, (bx2 - bx1 + 1) * (by2 - by1 + 1) AS sbp FROM p) SELECT l_orderkey, la, lb, pa, pb, round({value}, 6) AS {name} FROM i"""


def _box_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    x = b.select("l_orderkey", F.col("l_linenumber").alias("la"), F.col("l_partkey").alias("pa"), F.col("b").alias("ba"))
    y = b.select("l_orderkey", F.col("l_linenumber").alias("lb"), F.col("l_partkey").alias("pb"), F.col("b").alias("bb"))
    return x.join(y, "l_orderkey").where((F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("pa") < F.col("pb"))))


def _box_query(fn, name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _box_pairs(spark, sf).select("l_orderkey", "la", "lb", "pa", "pb", r6(fn(F.col("ba"), F.col("bb"))).alias(name))

    return run


query("box_iou", _pairs_sql("CASE WHEN i > 0 THEN i / (sa + sb - i) ELSE 0 END", "iou"))(_box_query(box.box_iou, "iou"))
query("box_iou_pixel", _pairs_sql("ip / (sap + sbp - ip)", "iou"))(_box_query(box.box_iou_pixel, "iou"))
query("box_ioa", _pairs_sql("i / sb", "ioa"))(_box_query(box.box_ioa, "ioa"))


@query("box_normalize_clamp", f"WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, {_BOX} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, x1 / 50)), 6) AS x1, round(greatest(0, least(1, y1 / 20)), 6) AS y1, round(greatest(0, least(1, x2 / 50)), 6) AS x2, round(greatest(0, least(1, y2 / 20)), 6) AS y2 FROM b")
def box_normalize_clamp(spark: SparkSession, sf: str) -> DataFrame:
    n = box.normalise(F.col("b"), F.lit(50), F.lit(20))
    return boxes(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", *[r6(n[i]).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])


def user_tubes(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, event_type, tube): a box from each hour's highest value."""
    v = frames(spark, sf).groupBy("user_id", "event_type", "frame").agg(F.max("value").alias("v"))
    b = box.box(F.col("v"), F.col("v") / 2, F.col("v") + 10, F.col("v") / 2 + 10)
    return v.groupBy("user_id", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("frame", b))).alias("tube"))


_TUBES = f"{FRAMES}, t AS (SELECT user_id, event_type, frame, max(value) AS v FROM f GROUP BY ALL), c AS (SELECT user_id, frame, v FROM t WHERE event_type = 'click'), w AS (SELECT user_id, frame, v FROM t WHERE event_type = 'view')"
_TUBE_IOU = "(greatest(0, 10 - abs(c.v - w.v)) * greatest(0, 10 - abs(c.v - w.v) / 2))"


@query("viou_tube", f"""WITH {_TUBES}, i AS (SELECT user_id, sum(x / (200 - x)) AS total, count(*) AS shared FROM (SELECT c.user_id, {_TUBE_IOU} AS x FROM c JOIN w ON c.user_id = w.user_id AND c.frame = w.frame) GROUP BY 1),
n AS (SELECT user_id, count(DISTINCT frame) AS n FROM t WHERE event_type IN ('click', 'view') GROUP BY 1) SELECT user_id, round(coalesce(total, 0) / n, 6) AS viou, round(coalesce(total / shared, 0), 6) AS siou FROM n LEFT JOIN i USING (user_id) WHERE user_id IN (SELECT user_id FROM c) AND user_id IN (SELECT user_id FROM w)""")
def viou_tube(spark: SparkSession, sf: str) -> DataFrame:
    t = user_tubes(spark, sf)
    a = t.where("event_type = 'click'").select("user_id", F.col("tube").alias("g"))
    b = t.where("event_type = 'view'").select("user_id", F.col("tube").alias("p"))
    return a.join(b, "user_id").select("user_id", r6(box.tube_viou(F.col("g"), F.col("p"))).alias("viou"), r6(box.tube_siou(F.col("g"), F.col("p"))).alias("siou"))


@query("official_tube", f"""WITH {_TUBES}, g AS (SELECT user_id, min(frame) AS s, max(frame) + 1 AS e, count(*) AS n FROM c GROUP BY 1), p AS (SELECT user_id, min(frame) AS s, max(frame) + 1 AS e FROM w GROUP BY 1),
h AS (SELECT g.user_id, g.s AS gs, g.e AS ge, p.s AS ps, p.e AS pe, g.n FROM g JOIN p USING (user_id)), i AS (SELECT c.user_id, c.frame, {_TUBE_IOU} / (200 - {_TUBE_IOU}) AS x FROM c JOIN w ON c.user_id = w.user_id AND c.frame = w.frame),
v AS (SELECT h.user_id, sum(CASE WHEN frame >= greatest(gs, ps) AND frame < least(ge, pe) THEN x ELSE 0 END) AS a, sum(x) AS b FROM h JOIN i USING (user_id) GROUP BY 1)
SELECT h.user_id, round(CASE WHEN least(ge, pe) > greatest(gs, ps) THEN (least(ge, pe) - greatest(gs, ps))::DOUBLE / (ge - gs + pe - ps - (least(ge, pe) - greatest(gs, ps))) ELSE 0 END, 6) AS tiou, round(coalesce(a, 0) / (greatest(ge, pe) - least(gs, ps)), 6) AS viou, round(coalesce(b, 0) / n, 6) AS gt_viou FROM h LEFT JOIN v USING (user_id)""")
def official_tube(spark: SparkSession, sf: str) -> DataFrame:
    t = user_tubes(spark, sf)
    a = t.where("event_type = 'click'").select("user_id", F.col("tube").alias("g"))
    b = t.where("event_type = 'view'").select("user_id", F.col("tube").alias("p"))
    k = lambda c, f: f(F.map_keys(c))
    j = a.join(b, "user_id").select("*", k("g", F.array_min).alias("gs"), (k("g", F.array_max) + 1).alias("ge"), k("p", F.array_min).alias("ps"), (k("p", F.array_max) + 1).alias("pe"))
    return tubes.official(j, "gs", "ge", "ps", "pe", "g", "p", "skip").select("user_id", *[r6(F.col(c)).alias(c) for c in ("tiou", "viou", "gt_viou")])


_CELLS = "click view purchase".split()


@query("optimal_assignment", f"""WITH {FRAMES}, m AS (SELECT user_id, event_type AS g, frame % 3 AS p, count(*) AS n FROM f WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL),
c AS (SELECT user_id, max(CASE WHEN g = 'click' AND p = 0 THEN n ELSE 0 END) AS a0, max(CASE WHEN g = 'click' AND p = 1 THEN n ELSE 0 END) AS a1, max(CASE WHEN g = 'click' AND p = 2 THEN n ELSE 0 END) AS a2, max(CASE WHEN g = 'view' AND p = 0 THEN n ELSE 0 END) AS b0, max(CASE WHEN g = 'view' AND p = 1 THEN n ELSE 0 END) AS b1, max(CASE WHEN g = 'view' AND p = 2 THEN n ELSE 0 END) AS b2, max(CASE WHEN g = 'purchase' AND p = 0 THEN n ELSE 0 END) AS c0, max(CASE WHEN g = 'purchase' AND p = 1 THEN n ELSE 0 END) AS c1, max(CASE WHEN g = 'purchase' AND p = 2 THEN n ELSE 0 END) AS c2 FROM m GROUP BY 1)
SELECT user_id, greatest(a0 + b1 + c2, a0 + b2 + c1, a1 + b0 + c2, a1 + b2 + c0, a2 + b0 + c1, a2 + b1 + c0)::BIGINT AS best FROM c""")
def optimal_assignment(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).where(F.col("event_type").isin(*_CELLS))
    cell = lambda g, p: F.sum(((F.col("event_type") == g) & (F.pmod("frame", F.lit(3)) == p)).cast("double"))
    m = f.groupBy("user_id").agg(F.array(*[F.array(*[cell(g, p) for p in range(3)]) for g in _CELLS]).alias("m")).withColumn("a", tubes.assign("m"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + F.get(F.get(F.col("m"), x["g"]), x["p"]))
    return m.select("user_id", total.cast("long").alias("best"))


@query("multi_target_metrics")
def multi_target_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A user's tubes against all of the next user's."""
    t = user_tubes(spark, sf).withColumn("k", F.map_keys("tube"))
    one = F.struct(F.col("event_type").alias("description"), F.array_min("k").alias("s"), F.array_max("k").alias("e"), F.col("tube").alias("boxes"))
    u = t.withColumn("t", one).groupBy("user_id").agg(F.collect_list("t").alias("gt")).withColumn("gt", F.array_sort("gt", lambda a, b: F.when(a["description"] < b["description"], -1).when(a["description"] > b["description"], 1).otherwise(0)))
    pred = u.select((F.col("user_id") - 1).alias("user_id"), F.col("gt").alias("pred"))
    return tubes.score(u.join(pred, "user_id")).select("user_id", *[r6(F.col(f"`{c}`")).alias(c) for c in ("m_tIoU", "m_vIoU", "vIoU@0.3", "vIoU@0.5")], "match_count", "gt_count", "pred_count")


_CM = "WITH t AS (SELECT quality AS truth, toxic AS guess, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), l AS (SELECT truth AS l FROM t UNION SELECT guess FROM t), d AS (SELECT a.l AS truth, b.l AS guess, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN t ON t.truth = a.l AND t.guess = b.l) SELECT truth::BIGINT AS truth, guess::BIGINT AS guess, "
for _name, _over in (("true", "PARTITION BY truth"), ("pred", "PARTITION BY guess"), ("all", "")):
    query(f"confusion_matrix_{_name}", _CM + f"round(coalesce(n::DOUBLE / nullif(sum(n) OVER ({_over}), 0), 0), 6) AS value FROM d")(lambda spark, sf, _n=_name: classify.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic", _n).withColumn("value", r6(F.col("value"))))


@query("confusion_matrix", _CM + "n AS value FROM d")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return classify.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic")


@query("mean_class_accuracy", "WITH t AS (SELECT quality AS t, toxic AS g FROM labels), l AS (SELECT t AS l FROM t UNION SELECT g FROM t), a AS (SELECT t AS l, avg((t = g)::INT) AS a FROM t GROUP BY 1) SELECT round(avg(coalesce(a, 0)), 6) AS mean_class_accuracy FROM l LEFT JOIN a USING (l)")
def mean_class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return classify.mean_class_accuracy(table(spark, sf, "labels"), "quality", "toxic").select(r6(F.col("mean_class_accuracy")).alias("mean_class_accuracy"))


@query("class_ratios", "SELECT o_orderpriority AS label, round(avg((o_orderstatus = 'F')::INT), 6) AS ratio FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def class_ratios(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("g", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("-"))
    return classify.class_ratios(o, "o_orderpriority", "g", 3).withColumn("ratio", r6(F.col("ratio")))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").alias("score"))
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "lang", "score", (F.col("quality") == 1).alias("hit"))


_SC = "s AS (SELECT lang, n_chars AS score, quality = 1 AS hit, doc_id FROM labels JOIN documents USING (doc_id))"


@query("pr_curve", f"""WITH {_SC}, g AS (SELECT lang, score, sum(hit::INT) AS tp, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY lang) AS total FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, score AS threshold, round(ctp / cn, 6) AS "precision", round(ctp / total, 6) AS recall FROM c WHERE total > 0 AND ctp - tp < total""")
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return curves.pr_curve(_scored(spark, sf), ["lang"], "score", "hit").select("lang", "threshold", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("pr_curve_ap", f"""WITH {_SC}, g AS (SELECT lang, score, sum(hit::INT) AS tp, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY lang) AS total FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC)) SELECT lang, round(sum(tp / total * ctp / cn), 6) AS ap FROM c WHERE total > 0 GROUP BY 1""")
def pr_curve_ap(spark: SparkSession, sf: str) -> DataFrame:
    return curves.step_average_precision(_scored(spark, sf), ["lang"], "score", "hit").withColumn("ap", r6(F.col("ap")))


@query("interpolated_ap", f"""WITH {_SC}, r AS (SELECT *, row_number() OVER w AS rk, sum(hit::INT) OVER w AS tp FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)), p AS (SELECT lang, max(tp / rk) OVER (PARTITION BY lang ORDER BY rk DESC) AS best FROM r WHERE hit), n AS (SELECT lang, sum(hit::INT) AS n FROM s GROUP BY 1)
SELECT n.lang, round(sum(best) / n.n, 6) AS ap FROM n JOIN p USING (lang) WHERE n.n > 0 GROUP BY n.lang, n.n""")
def interpolated_ap(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    n = s.groupBy("lang").agg(F.sum(F.col("hit").cast("int")).alias("n"))
    return curves.interpolated_average_precision(s, ["lang"], "score", "hit", n, "n", ["doc_id"]).where("ap is not null").withColumn("ap", r6(F.col("ap")))


@query("topk_accuracy", "WITH e AS (SELECT label, embedding AS s FROM embeddings), r AS (SELECT len(list_filter(s, lambda x: x > s[label + 1])) + len(list_filter(list_zip(s, range(len(s))), lambda z: z[1] = s[label + 1] AND z[2] > label)) + 1 AS r FROM e) SELECT round(avg((r <= 1)::INT), 6) AS top1, round(avg((r <= 5)::INT), 6) AS top5 FROM r")
def topk_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("s"))
    return classify.top_k_accuracy(e, "s", "label").select(r6(F.col("top1")).alias("top1"), r6(F.col("top5")).alias("top5"))


_MANY = "WITH e AS (SELECT vec_id, embedding AS v, label FROM embeddings), x AS (SELECT vec_id, unnest(v)::DOUBLE AS s, unnest(range(len(v))) AS k, label FROM e), h AS (SELECT *, k = label OR k = (label + 3) % 10 AS hit FROM x)"


def _many(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    y = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda k: ((k == F.col("label")) | (k == F.pmod(F.col("label") + 3, F.lit(10)))).cast("int"))
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("s"), y.alias("y"))


@query("mean_average_precision", _MANY + """, g AS (SELECT k, s, sum(hit::INT) AS tp, count(*) AS n FROM h GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY k) AS total FROM g WINDOW w AS (PARTITION BY k ORDER BY s DESC)), a AS (SELECT k, sum(tp / total * ctp / cn) AS ap FROM c WHERE total > 0 GROUP BY 1) SELECT round(avg(ap), 6) AS map FROM a""")
def mean_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return classify.mean_average_precision(_many(spark, sf), "s", "y").select(r6(F.col("map")).alias("map"))


@query("sample_average_precision", _MANY + """, g AS (SELECT vec_id, s, sum(hit::INT) AS tp, count(*) AS n FROM h GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY vec_id) AS total FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC)), a AS (SELECT vec_id, sum(tp / total * ctp / cn) AS ap FROM c GROUP BY 1) SELECT round(avg(ap), 6) AS map FROM a""")
def sample_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return classify.sample_average_precision(_many(spark, sf), "s", "y").select(r6(F.col("map")).alias("map"))


_UNIT = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"
_RANKS = _UNIT + ", p AS (SELECT a.vec_id, a.v AS t, b.v AS w FROM u a JOIN u b ON b.vec_id = a.vec_id + 1), o AS (SELECT vec_id, t, list_dot_product(t, w) AS own FROM p), r AS (SELECT o.vec_id, sum((list_dot_product(o.t, p.w) > own + 1e-9)::INT)::BIGINT AS above, sum((abs(list_dot_product(o.t, p.w) - own) <= 1e-9)::INT)::BIGINT AS ties FROM o CROSS JOIN p GROUP BY 1)"


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("t"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("w"))
    return retrieve.ranks(e.join(n, "vec_id"), "vec_id", "t", "w", 1e-9)


@query("retrieval_ranks", _RANKS + ", i AS (SELECT unnest(range(above, above + ties)) AS i FROM r) SELECT round(avg((i < 1)::INT) * 100, 6) AS R1, round(avg((i < 5)::INT) * 100, 6) AS R5, round(avg((i < 10)::INT) * 100, 6) AS R10, median(i) + 1 AS MdR, round(avg(i) + 1, 6) AS MnR FROM i")
def retrieval_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.rank_summary(_ranks(spark, sf)).select(*[r6(F.col(c)).alias(c) for c in ("R1", "R5", "R10")], "MdR", r6(F.col("MnR")).alias("MnR"))


@query("mrr", _RANKS + " SELECT round(sum(1.0 / (above + 1)), 6) AS mrr_sum, round(avg(1.0 / (above + 1)), 6) AS mrr FROM r")
def mrr(spark: SparkSession, sf: str) -> DataFrame:
    m = retrieve.mrr(_ranks(spark, sf).withColumn("rank", F.col("above") + 1), "rank")
    return m.select(r6(F.col("mrr_sum")).alias("mrr_sum"), r6(F.col("mrr")).alias("mrr"))


def _mine_sql(top: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS d, a.label = b.label AS pos, round(list_dot_product(a.v, b.v), 9) AS s FROM e a CROSS JOIN e b), m AS (SELECT q, min(s) AS least FROM s WHERE pos GROUP BY 1),
k AS (SELECT q, d, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rank FROM s JOIN m USING (q) WHERE NOT pos AND s <= {top}) SELECT q AS query_id, d AS doc_id, round(s, 6) AS score, rank FROM k WHERE rank <= 4"""


def _mine(spark: SparkSession, sf: str, margin: float, kind: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q, d = e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id")
    return retrieve.hard_negatives(q, d, "label", 4, margin, kind).select("query_id", "doc_id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("hard_negatives_perc", _mine_sql("round(least * 0.95, 9)"))
def hard_negatives_perc(spark: SparkSession, sf: str) -> DataFrame:
    return _mine(spark, sf, 0.95, "perc")


@query("hard_negatives_abs", _mine_sql("round(least + 0.1, 9)"))
def hard_negatives_abs(spark: SparkSession, sf: str) -> DataFrame:
    return _mine(spark, sf, -0.1, "abs")


@query("recall_at_k", "WITH o AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS g FROM orders GROUP BY 1) SELECT round(avg(list_has_any(g[1:1], ['1-URGENT', '2-HIGH'])::INT) * 100, 6) AS \"R@1\", round(avg(list_has_any(g[1:5], ['1-URGENT', '2-HIGH'])::INT) * 100, 6) AS \"R@5\" FROM o")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("g"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("t"))
    return retrieve.recall_at(o, "g", "t", (1, 5)).select(*[r6(F.col(f"`R@{k}`")).alias(f"R@{k}") for k in (1, 5)])


def _ap_sql(keys: str, order: str, totals: str) -> str:
    """Interpolated average precision of m(keys, score, hit) over the truths in totals(keys, n)."""
    return f"""r AS (SELECT *, row_number() OVER w AS rk, sum(hit::INT) OVER w AS tp FROM m WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC, {order} ROWS UNBOUNDED PRECEDING)),
peak AS (SELECT {keys}, max(tp / rk) OVER (PARTITION BY {keys} ORDER BY rk DESC) AS best FROM r WHERE hit), a AS (SELECT {keys}, sum(best) AS total FROM peak GROUP BY {keys}),
ap AS (SELECT {keys}, coalesce(total, 0) / n AS ap FROM {totals} LEFT JOIN a USING ({keys}) WHERE n > 0)"""


_SEGMENTS = SPANS + """, x AS (SELECT event_type AS label, user_id // 10 AS video, user_id, s, e + 1 AS e FROM sp), t AS (SELECT label, video, s, e, row_number() OVER (PARTITION BY label, video ORDER BY s, e) AS j FROM x WHERE user_id % 2 = 0),
g AS (SELECT label, video, s, e, ((s * 37 + user_id * 11) % 101) / 101.0 AS score FROM x WHERE user_id % 2 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY label, video ORDER BY score DESC, s, e) - 1 AS ord FROM g)"""


def _greedy_sql(thresholds: str) -> str:
    """m: every guess takes the best truth that is still free, one guess after the other."""
    return f"""WITH RECURSIVE {_SEGMENTS}, i AS (SELECT o.label, o.video, ord, j, greatest(0, least(o.e, t.e) - greatest(o.s, t.s)) AS i, o.e - o.s + t.e - t.s AS both_ FROM o JOIN t USING (label, video)),
h AS (SELECT unnest({thresholds})::DOUBLE AS threshold), c AS (SELECT o.label, o.video, o.ord, o.score, threshold, list(j ORDER BY i / (both_ - i) DESC, j DESC) FILTER (i / (both_ - i) >= threshold) AS js FROM o CROSS JOIN h LEFT JOIN i ON i.label = o.label AND i.video = o.video AND i.ord = o.ord GROUP BY ALL),
fold AS (SELECT label, video, threshold, -1::BIGINT AS ord, NULL::DOUBLE AS score, NULL::BIGINT AS pick, []::BIGINT[] AS used FROM (SELECT DISTINCT label, video, threshold FROM c)
UNION ALL SELECT label, video, threshold, ord, score, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (SELECT c.*, fold.used, list_filter(coalesce(c.js, []), lambda j: NOT list_contains(fold.used, j))[1] AS pick FROM fold JOIN c ON c.label = fold.label AND c.video = fold.video AND c.threshold = fold.threshold AND c.ord = fold.ord + 1)),
m AS (SELECT label, video, score, ord, threshold, pick IS NOT NULL AS hit FROM fold WHERE ord >= 0)"""


@query("segment_ap", _greedy_sql("[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]") + ", n AS (SELECT label, threshold, n FROM (SELECT label, count(*) AS n FROM t GROUP BY 1) CROSS JOIN h), " + _ap_sql("label, threshold", "video, ord", "n") + " SELECT label, threshold, round(ap, 6) AS ap FROM ap")
def segment_ap(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision of each class at every threshold."""
    return detect.segment_average_precision(*_segments(spark, sf)).withColumn("ap", r6(F.col("ap")))


def _segments(spark: SparkSession, sf: str):
    x = user_spans(spark, sf).select(F.col("event_type").alias("label"), F.floor(F.col("user_id") / 10).alias("video"), "user_id", "s", (F.col("e") + 1).alias("e"))
    even = F.pmod("user_id", F.lit(2)) == 0
    g = x.where(~even).select("label", "video", "s", "e", (F.pmod(F.col("s") * 37 + F.col("user_id") * 11, F.lit(101)) / 101.0).alias("score"))
    return x.where(even).drop("user_id"), g


@query("matched_segments", _greedy_sql("[0.3, 0.5]") + " SELECT label, video, round(score, 6) AS score, ord, threshold, hit FROM m")
def matched_segments(spark: SparkSession, sf: str) -> DataFrame:
    return detect.matched_segments(*_segments(spark, sf), (0.3, 0.5)).withColumn("score", r6(F.col("score")))


@query("proposal_recall", f"""WITH {_SEGMENTS}, gt AS (SELECT video, s, e, row_number() OVER () AS id FROM t), own AS (SELECT video, s, e, row_number() OVER (PARTITION BY video ORDER BY score DESC, s, e) - 1 AS ord, count(*) OVER (PARTITION BY video) AS n FROM g WHERE video IN (SELECT video FROM gt)),
z AS (SELECT (SELECT count(DISTINCT video) FROM gt) AS videos, (SELECT count(*) FROM g) AS n), ratio AS (SELECT 100.0::DOUBLE * videos / n AS ratio, videos FROM z),
kept AS (SELECT video, least(floor(n * ratio), n)::BIGINT AS kept FROM (SELECT DISTINCT video, n FROM own), ratio), k AS (SELECT sum(kept)::BIGINT AS kept FROM kept),
h AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold), i AS (SELECT gt.id, gt.video, ord, greatest(0, least(gt.e, own.e) - greatest(gt.s, own.s)) AS i, gt.e - gt.s + own.e - own.s AS both_ FROM gt JOIN own USING (video) JOIN kept USING (video) WHERE ord < kept),
r AS (SELECT id, video, threshold, min(ord) + 1 AS rank FROM i JOIN h ON i / (both_ - i) >= threshold GROUP BY ALL), st AS (SELECT CAST(range AS INT) AS step, range / 100.0 * (100.0::DOUBLE * videos / k.kept) AS x FROM range(1, 101), ratio, k),
u AS (SELECT video, step, least(floor(kept.kept * x), kept.kept)::BIGINT AS upto FROM kept, st), f AS (SELECT threshold, step, count(*) AS found FROM r JOIN u USING (video) WHERE rank <= upto GROUP BY ALL),
a AS (SELECT step, avg(coalesce(found, 0) / (SELECT count(*) FROM gt)) AS ar FROM st CROSS JOIN h LEFT JOIN f USING (threshold, step) GROUP BY step), p AS (SELECT step, ar, lag(ar) OVER (ORDER BY step) AS before FROM a)
SELECT round(max(CASE WHEN step = 1 THEN ar END), 6) AS "AR@1", round(max(CASE WHEN step = 5 THEN ar END), 6) AS "AR@5", round(max(CASE WHEN step = 10 THEN ar END), 6) AS "AR@10", round(max(CASE WHEN step = 100 THEN ar END), 6) AS "AR@100", round(sum((ar + before) / 2) / 100 * 100, 6) AS auc FROM p""".replace("f AS (SELECT threshold, step", "fd AS (SELECT threshold, step").replace("LEFT JOIN f USING", "LEFT JOIN fd USING"))
def proposal_recall(spark: SparkSession, sf: str) -> DataFrame:
    t, g = _segments(spark, sf)
    r = detect.proposal_summary(detect.proposal_recall(t.drop("label"), g.drop("label")))
    return r.select(*[r6(F.col(f"`{c}`")).alias(c) for c in r.columns])


def _frame_boxes(spark: SparkSession, sf: str):
    b = boxes(spark, sf).select(F.pmod("l_partkey", F.lit(5)).alias("label"), F.col("l_suppkey").alias("video"), F.pmod("l_orderkey", F.lit(50)).alias("frame"), "l_linenumber", *[F.col("b")[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])
    return b.where("l_linenumber <= 3").drop("l_linenumber"), b.where("l_linenumber > 3").withColumn("score", F.col("x1") / 51).drop("l_linenumber")


_FRAME_BOXES = f"""WITH b AS (SELECT l_partkey % 5 AS label, l_suppkey AS video, l_orderkey % 50 AS frame, l_linenumber, {_BOX} FROM lineitem), t AS (SELECT label, video, frame, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, row_number() OVER (PARTITION BY label, video, frame ORDER BY x1, y1, x2, y2) AS j FROM b WHERE l_linenumber <= 3),
g AS (SELECT label, video, frame, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, x1 / 51 AS score FROM b WHERE l_linenumber > 3), o AS (SELECT *, row_number() OVER (PARTITION BY label, video, frame ORDER BY score DESC, x1, y1, x2, y2) - 1 AS ord FROM g)"""
_BEST_BOX = """, i AS (SELECT o.label, o.video, o.frame, ord, j, greatest(0, least(o.x2, t.x2) - greatest(o.x1, t.x1)) * greatest(0, least(o.y2, t.y2) - greatest(o.y1, t.y1)) AS i, (o.x2 - o.x1) * (o.y2 - o.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS both_ FROM o JOIN t USING (label, video, frame)),
k AS (SELECT label, video, frame, ord, i / (both_ - i) AS iou, j FROM i QUALIFY row_number() OVER (PARTITION BY label, video, frame, ord ORDER BY i / (both_ - i) DESC, j) = 1), f AS (SELECT label, video, frame, min(ord) AS ord, true AS hit FROM k WHERE iou >= 0.5 GROUP BY label, video, frame, j),
m AS (SELECT label, video, frame, ord, score, coalesce(hit, false) AS hit FROM o LEFT JOIN f USING (label, video, frame, ord))"""


@query("frame_ap", _FRAME_BOXES + _BEST_BOX + ", n AS (SELECT label, count(*) AS n FROM t GROUP BY 1), " + _ap_sql("label", "video, frame, ord", "n") + " SELECT label, round(ap, 6) AS ap FROM ap")
def frame_ap(spark: SparkSession, sf: str) -> DataFrame:
    return detect.frame_average_precision(*_frame_boxes(spark, sf)).withColumn("ap", r6(F.col("ap")))


@query("action_evaluation", _FRAME_BOXES.replace("), o AS", "), g0 AS (SELECT * FROM g WHERE (video, frame) IN (SELECT (video, frame) FROM t)), o AS").replace("AS ord FROM g)", "AS ord FROM g0)") + _BEST_BOX + ", n AS (SELECT label, count(*) AS n FROM t WHERE label IN (SELECT label FROM g0) GROUP BY 1), " + _ap_sql("label", "video, frame, ord", "n") + """
SELECT "group", round(avg(ap), 6) AS map FROM (SELECT ap, unnest(['overall', CASE WHEN label <= 14 THEN 'person_movement' WHEN label < 64 THEN 'object_manipulation' ELSE 'person_interaction' END]) AS "group" FROM ap) GROUP BY 1""")
def action_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    t, g = _frame_boxes(spark, sf)
    return detect.evaluate_actions(t, g, t.select("label").distinct().withColumn("name", F.col("label").cast("string"))).withColumn("map", r6(F.col("map")))


#: Boxes of equal frames are equal here, so a tube's overlap is that of its frames.
@query("video_ap", f"""WITH {_SEGMENTS.replace("ORDER BY s, e) AS j", "ORDER BY s, e - s) AS j").replace("score DESC, s, e)", "score DESC, s, e - s)")}, h AS (SELECT unnest(range(1, 20)) / 20.0 AS threshold), i AS (SELECT o.label, o.video, ord, j, least(o.e, t.e) - 1 - greatest(o.s, t.s) AS shared, greatest(o.e, t.e) - 1 - least(o.s, t.s) AS whole_ FROM o JOIN t USING (label, video)),
v AS (SELECT label, video, ord, j, CASE WHEN shared < 0 THEN 0 WHEN whole_ = 0 THEN 1 ELSE shared / whole_ END AS iou FROM i), k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label, video, ord ORDER BY iou DESC, j) = 1),
won AS (SELECT label, video, threshold, min(ord) AS ord, true AS hit FROM k JOIN h ON iou >= round(threshold, 2)::DOUBLE GROUP BY label, video, threshold, j), m AS (SELECT o.label, o.video, o.ord, o.score, h.threshold, coalesce(hit, false) AS hit FROM o CROSS JOIN h LEFT JOIN won ON won.label = o.label AND won.video = o.video AND won.ord = o.ord AND won.threshold = h.threshold),
n AS (SELECT label, threshold, n FROM (SELECT label, count(*) AS n FROM t GROUP BY 1) CROSS JOIN h), {_ap_sql("label, threshold", "video, ord", "n")}, p AS (SELECT (threshold * 20)::INT AS k, avg(ap) * 100 AS m FROM ap GROUP BY threshold),
g3 AS (SELECT '0.50:0.95' AS range, k, m FROM p WHERE k >= 10 UNION ALL SELECT '0.05:0.45', k, m FROM p WHERE k < 10 UNION ALL SELECT '0.10:0.90', k, m FROM p WHERE k % 2 = 0) SELECT range, round(avg(m), 4) AS map FROM g3 GROUP BY 1""")
def video_ap(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of users as tubes with a drifting box."""
    t, g = _segments(spark, sf)
    tube = F.transform(F.sequence("s", F.col("e") - 1), lambda f: F.struct(f.alias("frame"), (f * 1.0).alias("x1"), F.lit(0.0).alias("y1"), (f + 20.0).alias("x2"), F.lit(10.0).alias("y2")))
    return detect.video_average_precision_grid(t.withColumn("tube", tube), g.withColumn("tube", tube))


_BUCKETS = media.bucket_rows(512 * 512)
_VALUES = ", ".join(f"({i}, {w}, {h}, {a!r})" for i, w, h, a in _BUCKETS)


@query("nearest_bucket", f"""WITH b(id, w, h, aspect) AS (VALUES {_VALUES}), p AS (SELECT p_partkey, p_size * 32 + 100 AS w0, 600 AS h0 FROM part), d AS (SELECT p_partkey, id, w, h, abs(aspect::DOUBLE - w0 / h0) AS d FROM p CROSS JOIN b) SELECT p_partkey, arg_min(w, (d, id)) AS w, arg_min(h, (d, id)) AS h FROM d GROUP BY 1""")
def nearest_bucket(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 32 + 100).alias("w0"), F.lit(600).alias("h0"))
    return media.nearest_bucket(p, media.bucket_table(spark, 512 * 512), "w0", "h0").select("p_partkey", F.col("bucket.w").alias("w"), F.col("bucket.h").alias("h"))


@query("orientation", "SELECT p_partkey, CASE WHEN p_size / 25 < 0.85 THEN 'tall' WHEN p_size / 25 > 1.18 THEN 'wide' ELSE 'square' END AS kind, greatest(1, floor(32 * 512 * 512 / (p_size * 32 * 800))::INT) AS batch FROM part")
def orientation(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", media.orientation(F.col("p_size"), F.lit(25)).alias("kind"), media.dynamic_batch(F.col("p_size") * 32, F.lit(800), 32, 512 * 512).alias("batch"))


@query("resize_budget", """WITH p AS (SELECT p_partkey, p_size * 40 + 20 AS h, p_size * 55 + 20 AS w FROM part), b AS (SELECT *, round_even(h / 28, 0) * 28 AS hb, round_even(w / 28, 0) * 28 AS wb FROM p)
SELECT p_partkey, (CASE WHEN hb * wb > 1003520 THEN greatest(28, floor(h / sqrt(h * w / 1003520.0) / 28) * 28) WHEN hb * wb < 3136 THEN ceil(h * sqrt(3136.0 / (h * w)) / 28) * 28 ELSE hb END)::BIGINT AS h, (CASE WHEN hb * wb > 1003520 THEN greatest(28, floor(w / sqrt(h * w / 1003520.0) / 28) * 28) WHEN hb * wb < 3136 THEN ceil(w * sqrt(3136.0 / (h * w)) / 28) * 28 ELSE wb END)::BIGINT AS w FROM b""")
def resize_budget(spark: SparkSession, sf: str) -> DataFrame:
    s = media.resize_image(F.col("p_size") * 40 + 20, F.col("p_size") * 55 + 20)
    return table(spark, sf, "part").select("p_partkey", s["h"].alias("h"), s["w"].alias("w"))


@query("metrics_of_pairs", f"WITH {PAIRS} SELECT event_type, count(*) AS n, round(sum({TIOU}), 4) AS total FROM pr GROUP BY 1")
def metrics_of_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = tubes.temporal_score(span_pair_counts(spark, sf), "s", "e", "s2", "e2")
    return t.groupBy("event_type").agg(F.sum("pairs").alias("n"), F.round(F.sum(F.col("tIoU") * F.col("pairs")), 4).alias("total"))
