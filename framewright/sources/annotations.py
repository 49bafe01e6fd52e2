"""Annotation files as samples: (sample_id, video_path, query, gt array<track>, metadata columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import answers, box
from framewright.schemas import TRACK
from framewright.sources import documents

_EMPTY = f"array<{TRACK}>"


def _track(description: Column, s: Column, e: Column, boxes: Column) -> Column:
    return F.array(F.struct(description.alias("description"), s.cast("long").alias("s"), e.cast("long").alias("e"), boxes.alias("boxes"))).cast(_EMPTY)


def _hull(boxes: Column) -> tuple[Column, Column]:
    k = F.map_keys(boxes)
    return F.array_min(k), F.array_max(k)


def share_map(boxes: Column, width: Column, height: Column) -> Column:
    """map<string, box in pixels> -> map<long, box in shares>; bad keys and boxes go, a size that isn't positive leaves nothing."""
    rows = F.transform(F.map_entries(boxes), lambda kv: F.struct(F.trim(kv["key"]).try_cast("long").alias("k"), box.normalise(kv["value"], width, height).alias("v")))
    good = F.filter(rows, lambda r: r["k"].isNotNull() & r["v"].isNotNull())
    last = F.filter(good, lambda r, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["k"] == r["k"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<bigint, array<double>>"))


QUERY_LINES = "video_path string, video_width double, video_height double, Width double, Height double, query string, queryid string, query_id string, box string, difficulty_bucket string, Difficulty struct<D_s: double, D_t: double, D: double>, D_s double, D_t double, D double, template string, target_arity int, per_target_queries map<string, string>, target_members array<struct<object_id: string, start_frame: bigint, end_frame: bigint, target_index: int, boxes: map<string, array<double>>>>"


def queries(spark: SparkSession, path: str, videos: DataFrame | None = None) -> DataFrame:
    """Query lines: tracks from the box text, else from the members, else one empty track. videos: (video_name), others are left out."""
    d = spark.read.schema(QUERY_LINES).option("mode", "DROPMALFORMED").json(path)
    if videos is not None:
        d = d.join(videos.select("video_name").distinct(), d["video_path"] == F.col("video_name"), "left_semi")
    w, h = F.coalesce("video_width", "Width", F.lit(0.0)), F.coalesce("video_height", "Height", F.lit(0.0))

    def member(m: Column) -> Column:
        b = share_map(m["boxes"], w, h)
        s, e = _hull(b)
        name = F.coalesce(F.try_element_at("per_target_queries", F.concat(F.lit("target "), m["target_index"].cast("string"))), F.col("query"), F.lit(""))
        return F.struct(name.alias("description"), s.alias("s"), e.alias("e"), b.alias("boxes"))

    members = F.transform("target_members", member).cast(_EMPTY)
    empty = _track(F.coalesce("query", F.lit("")), F.lit(None), F.lit(None), F.create_map().cast("map<bigint, array<double>>"))
    read = d.withColumn("__b", answers.tracks(F.coalesce("box", F.lit(""))))
    gt = F.when(F.size("__b") > 0, F.col("__b")).when(F.coalesce(F.size("target_members"), F.lit(0)) > 0, members).otherwise(empty)
    pick = lambda n: F.coalesce(F.col(f"Difficulty.{n}"), F.col(n))
    return read.select(F.coalesce("queryid", "query_id").alias("sample_id"), "video_path", F.coalesce("query", F.lit("")).alias("query"), gt.alias("gt"), "difficulty_bucket", pick("D").alias("difficulty_score"), pick("D_t").alias("difficulty_temporal"), pick("D_s").alias("difficulty_spatial"), "template", "target_arity", F.coalesce("Width", "video_width").alias("width"), F.coalesce("Height", "video_height").alias("height"))


def _object_of(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, a): the entries of one JSON object that fills a file."""
    one = F.concat(F.lit("{"), "value", F.lit("}"))
    return documents.entries(spark, path, "{").select(F.explode(F.from_json(one, f"map<string, {value}>")).alias("key", "a"))


def _dense(boxes: Column, start: Column) -> Column:
    return F.map_from_entries(F.transform(boxes, lambda b, i: F.struct((start + i).cast("long").alias("k"), b.alias("v"))))


def corner_sized(spark: SparkSession, path: str) -> DataFrame:
    """Videos with boxes x, y, w, h from st_frame on; one box outside the picture drops the whole video."""
    d = _object_of(spark, path, "struct<st_frame: bigint, ed_frame: bigint, width: double, height: double, bbox: array<array<double>>, English: string, img_size: array<double>, st_time: double, ed_time: double>")
    a = F.col("a")
    inside = F.forall(a["bbox"], lambda b: (b[0] >= 0) & (b[1] >= 0) & (b[0] + b[2] <= a["width"]) & (b[1] + b[3] <= a["height"]))
    shares = F.transform(a["bbox"], lambda b: F.array(b[0] / a["width"], b[1] / a["height"], (b[0] + b[2]) / a["width"], (b[1] + b[3]) / a["height"]))
    return d.where(inside).select(F.col("key").alias("sample_id"), F.col("key").alias("video_path"), F.coalesce(a["English"], F.lit("")).alias("query"), _track(F.coalesce(a["English"], F.lit("")), a["st_frame"], a["ed_frame"], _dense(shares, a["st_frame"])).alias("gt"), a["width"].alias("width"), a["height"].alias("height"), a["st_time"].alias("st_time"), a["ed_time"].alias("ed_time"))


def cornered(spark: SparkSession, path: str) -> DataFrame:
    """Items with boxes xmin..ymax from begin_fid on, and a question type."""
    d = _object_of(spark, path, "struct<vid: string, temp_gt: struct<begin_fid: bigint, end_fid: bigint>, target_bboxs: array<struct<xmin: double, ymin: double, xmax: double, ymax: double>>, qtype: string, sentence: struct<description: string>, fps: double, width: double, height: double, frame_count: bigint, target_category: string>")
    a = F.col("a")
    shares = F.transform(a["target_bboxs"], lambda b: F.array(b["xmin"] / a["width"], b["ymin"] / a["height"], b["xmax"] / a["width"], b["ymax"] / a["height"]))
    q = a["sentence"]["description"]
    return d.select(F.col("key").alias("sample_id"), F.concat(a["vid"], F.lit(".mp4")).alias("video_path"), q.alias("query"), _track(q, a["temp_gt"]["begin_fid"], a["temp_gt"]["end_fid"], _dense(shares, a["temp_gt"]["begin_fid"])).alias("gt"), a["qtype"].alias("qtype"), a["fps"].alias("fps"), a["width"].alias("width"), a["height"].alias("height"), a["frame_count"].alias("frame_count"), F.coalesce(a["target_category"], F.lit("")).alias("target_category"))


def aligned(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array with spans in meta.time_token, swapped if reversed; items without path, query or span go."""
    schema = "video_path string, QA string, query string, box string, id string, meta struct<time_token: map<string, string>, split: array<bigint>>"
    d = documents.entries(spark, path, "[").select(F.from_json("value", schema).alias("x")).select("x.*")
    qa = lambda p: F.nullif(F.coalesce(F.get_json_object("QA", f"{p}.q"), F.get_json_object("QA", f"{p}.question")), F.lit(""))
    q = F.coalesce(qa("$"), qa("$[0]"), F.col("query"), F.lit(""))
    s, e = (F.try_element_at("meta.time_token", F.lit(k)).try_cast("long") for k in ("<s>", "<e>"))
    read = d.withColumn("__q", q).withColumn("__t", answers.tracks(F.coalesce("box", F.lit(""))))
    boxes = F.when(F.size("__t") == 1, F.get("__t", F.lit(0))["boxes"]).otherwise(F.create_map().cast("map<bigint, array<double>>"))
    cut = F.when(F.size("meta.split") == 2, F.array_sort("meta.split"))
    out = read.where((F.coalesce("video_path", F.lit("")) != "") & (F.col("__q") != "") & s.isNotNull() & e.isNotNull())
    return out.select(F.col("id").alias("sample_id"), "video_path", F.col("__q").alias("query"), _track(F.col("__q"), F.least(s, e), F.greatest(s, e), boxes).alias("gt"), cut.alias("clip_split"))


def with_answers(samples: DataFrame, predictions: DataFrame, text: str = "answer") -> DataFrame:
    """samples with `pred`, the tracks of their answers; a missing or unreadable answer is one empty track."""
    j = samples.join(predictions.select("sample_id", text), "sample_id", "left").withColumn("pred", answers.tracks(F.coalesce(text, F.lit(""))))
    empty = _track(F.lit(""), F.lit(None), F.lit(None), F.create_map().cast("map<bigint, array<double>>"))
    return j.withColumn("pred", F.when(F.size("pred") > 0, F.col("pred")).otherwise(empty))


def official_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """rows (ord, video_path, width, height) with target: half-open clipped first boxes in shares.

    predictions: (key, name, ord, s, e, boxes map<string, array<array<double>>>).
    A row takes the prediction keyed by its stem, its file name, its place, then
    the one whose name is its video, then the one in its place.
    """
    stem = F.regexp_replace(F.regexp_extract("video_path", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    r = rows.withColumn("__stem", stem)
    p = predictions.select("key", F.coalesce("name", F.lit("")).alias("name"), F.col("ord").alias("p_ord"), "s", "e", "boxes")
    keyed = [("key", "__stem"), ("key", "__file"), ("key", "__place"), ("name", "__stem"), ("name", "__file"), ("p_ord", "ord")]
    base = r.withColumn("__file", F.concat("__stem", F.lit(".mp4"))).withColumn("__place", F.col("ord").cast("string"))
    found = None
    for i, (a, b) in enumerate(keyed):
        hit = base.join(p, p[a] == base[b]).select("ord", F.lit(min(i, 4)).alias("way"), "s", "e", "boxes")
        found = hit if found is None else found.union(hit)
    best = found.groupBy("ord").agg(F.min_by(F.struct("s", "e", "boxes"), "way").alias("x"))
    w, h = F.greatest(F.coalesce("width", F.lit(1.0)), F.lit(1.0)), F.greatest(F.coalesce("height", F.lit(1.0)), F.lit(1.0))
    inside = lambda k: F.col("x.s").isNull() | ((k >= F.col("x.s")) & (k < F.col("x.e")))
    parts = F.transform(F.map_entries("x.boxes"), lambda kv: F.struct(kv["key"].try_cast("long").alias("k"), box.normalise(F.get(kv["value"], F.lit(0)), w, h).alias("v")))
    target = F.map_from_entries(F.filter(parts, lambda q: q["k"].isNotNull() & q["v"].isNotNull() & inside(q["k"])))
    return rows.join(best, "ord", "left").withColumn("target", F.coalesce(target, F.create_map().cast("map<bigint, array<double>>"))).drop("x")
