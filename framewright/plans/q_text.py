"""Queries over phrases, JSON and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import answers, text
from framewright.operators import relational
from framewright.plans.registry import query, table
from framewright.plans.shapes import r6

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _raw(c: str) -> str:
    return f"trim(regexp_replace(translate(lower({c}), '_-', '  '), '{_SPACE}', ' ', 'g'))"


def _stem(t: str) -> str:
    odd = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.IRREGULAR.items())
    return f"CASE {t} {odd} ELSE CASE WHEN len({t}) > 4 AND {t} LIKE '%ing' THEN left({t}, len({t}) - 3) WHEN len({t}) > 3 AND {t} LIKE '%ed' THEN left({t}, len({t}) - 2) WHEN len({t}) > 3 AND {t} LIKE '%s' THEN left({t}, len({t}) - 1) ELSE {t} END END"


@query("normalize_phrase", f"SELECT doc_id, md5({_raw('coalesce(text, chr(32))')}) AS phrase_md5 FROM documents")
def normalize_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.raw_phrase(F.col("text"))).alias("phrase_md5"))


@query("canonical_phrase", f"""WITH p AS (SELECT p_partkey, 'Is ' || p_type || '_' || p_name AS a, p_name || 's' AS b FROM part), w AS (SELECT p_partkey, string_split({_raw('a')}, ' ') AS a, string_split({_raw('b')}, ' ') AS b FROM p)
SELECT p_partkey, array_to_string(a[2:], ' ') AS rel, array_to_string(list_concat([{_stem('b[1]')}], b[2:]), ' ') AS attr FROM w""")
def canonical_phrase(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.canonical(F.concat(F.lit("Is "), "p_type", F.lit("_"), "p_name")).alias("rel"), text.canonical(F.concat("p_name", F.lit("s")), True).alias("attr"))


@query("synonym_map", f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS value FROM documents), c AS (SELECT value, count(*) AS n FROM w GROUP BY 1), k AS (SELECT *, {_stem('value')} AS c FROM c),
r AS (SELECT *, count(*) OVER (PARTITION BY c) AS size, first_value(value) OVER (PARTITION BY c ORDER BY n DESC, len(value), value) AS representative FROM k) SELECT value, representative FROM r WHERE size > 1 AND value <> representative""")
def synonym_map(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("value"))
    return relational.synonym_map(w, "value", text.stem(F.col("value")))


_PHRASES = ["Looking at", "hand shake", "lookat", "taking it from", "take a nice photo", "strike", "use", "using", "pick up", "riding", "chatting with", "works on", "working on", "stand", "hand over", "shake hands", "photographed", "Sing-to", "carry", "answer phone", "house"]
_CASES = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES))
_FAM = " ".join("WHEN " + " OR ".join(f"regexp_matches({c}, '{p}')" for p in ps for c in ("t", "z")) + f" THEN '{k}'" for k, ps in text.FAMILIES.items())


@query("regex_family", f"""WITH p AS (SELECT doc_id, CASE doc_id % {len(_PHRASES)} {_CASES} END || ' ' || source AS p FROM documents), t AS (SELECT doc_id, trim(regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM p), z AS (SELECT *, regexp_replace(t, '[^a-z0-9]+', '', 'g') AS z FROM t)
SELECT doc_id, CASE {_FAM} END AS family, CASE {_FAM} ELSE t END AS merge_key FROM z""")
def regex_family(spark: SparkSession, sf: str) -> DataFrame:
    which = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.pmod("doc_id", F.lit(len(_PHRASES))) + 1).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", which, "source").alias("p"))
    return d.select("doc_id", text.family(F.col("p")).alias("family"), text.merge_key(F.col("p")).alias("merge_key"))


@query("json_props_parse", "SELECT event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_props_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = text.safe_int(F.get_json_object("props", "$.k"), -1)
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("document_hash", """SELECT doc_id, ('0x' || array_to_string(list_reverse(regexp_extract_all(left(md5('doc-' || doc_id), 16), '..')), ''))::UBIGINT & 9223372036854775807 AS h FROM documents""".replace("('0x' ||", "CAST('0x' ||").replace(", ''))::UBIGINT &", ", '') AS UBIGINT) &"))
def document_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.doc_hash63(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("h"))


@query("humanised_ids", "SELECT p_partkey, replace(p_brand, '#', ' ') AS name FROM part")
def humanised_ids(spark: SparkSession, sf: str) -> DataFrame:
    node = F.concat_ws("_", F.translate("p_brand", "#", "-"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.humanise(node).alias("name"))


@query("temporal_answers", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 * (event_id % 50) WHEN 1 THEN event_id % 50 WHEN 2 THEN event_id % 50 ELSE NULL END AS s, CASE event_id % 4 WHEN 0 THEN 2 * (event_id % 50) + 7 WHEN 1 THEN event_id % 50 + 9 WHEN 2 THEN event_id % 50 + 4 ELSE NULL END AS e FROM events""".replace("2 * (event_id % 50) + 7", "2 * (event_id % 50) + 6"))
def temporal_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Four forms of an answer, made from the event's number."""
    a = F.pmod("event_id", F.lit(50))
    t = [F.format_string("It is %d s to %d s.", a, a + 3), F.format_string('```json\n{"temporal_span": [%d, %d]}\n```', a + 9, a), F.format_string("frames %d - %d", a + 4, a), F.lit("nowhere")]
    kind = F.pmod("event_id", F.lit(4))
    said = F.when(kind == 0, t[0]).when(kind == 1, t[1]).when(kind == 2, t[2]).otherwise(t[3])
    p = answers.temporal_span(said)
    return table(spark, sf, "events").select("event_id", p["s"].alias("s"), p["e"].alias("e"))


@query("tracks_from_answers", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS n_tracks, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id % 40 END AS s, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id % 40 + 1 END AS e FROM events""")
def tracks_from_answers(spark: SparkSession, sf: str) -> DataFrame:
    a = F.pmod("event_id", F.lit(40))
    whole = F.format_string('{"the dog": {"%d": [0.1, 0.1, 0.5, 0.5], "%d": [0, 0, 1, 2], "x": [1]}}', a, a + 1)
    cut = F.format_string('{"the dog": {"%d": [0.1, 0.1, 0.5, 0.5], "%d": [0.1, 0.2, 0.3, 0.4], "9', a, a + 1)
    kind = F.pmod("event_id", F.lit(3))
    t = table(spark, sf, "events").select("event_id", answers.tracks(F.when(kind == 0, whole).when(kind == 1, cut).otherwise(F.lit("none"))).alias("t"))
    return t.select("event_id", F.size("t").alias("n_tracks"), F.get("t.s", F.lit(0)).alias("s"), F.get("t.e", F.lit(0)).alias("e"))


@query("vqa_answers", "SELECT avg(CASE WHEN event_type = 'click' THEN 100.0 ELSE 0.0 END) AS acc FROM events".replace("avg(", "round(avg(").replace(") AS acc", "), 6) AS acc"))
def vqa_answers(spark: SparkSession, sf: str) -> DataFrame:
    from framewright.metrics.classify import vqa_accuracy

    e = table(spark, sf, "events")
    g = text.vqa_answer(F.concat(F.lit("The "), "event_type", F.lit(", one.")))
    truths = F.transform(F.array(F.lit("a click 1"), F.lit("nothing")), lambda x: text.vqa_answer(x))
    return vqa_accuracy(e, g, truths, F.array(F.lit(1.0), F.lit(0.5))).select(r6(F.col("acc")).alias("acc"))
