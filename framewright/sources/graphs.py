"""Scene-graph files and query records: one JSON object a line, explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import schemas
from framewright.operators import relational

VIDEO_ENDINGS = ("mp4", "avi", "mov", "mkv", "webm", "m4v")


def read_graphs(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """Blank lines are skipped; a broken line is dropped, or kept in _corrupt_record."""
    if keep_corrupt:
        return spark.read.schema(schemas.GRAPH + ", _corrupt_record string").json(path)
    return spark.read.schema(schemas.GRAPH).option("mode", "DROPMALFORMED").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RECORD).option("mode", "DROPMALFORMED").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def finished(graphs: DataFrame) -> DataFrame:
    """(name): paths, stems and file names of the videos that are done."""
    p = F.col("video_path")
    return graphs.where(p.isNotNull()).select(F.explode(F.array(p, stem(p), F.regexp_extract(p, r"([^/\\]+)$", 1))).alias("name")).distinct()


def unfinished(videos: DataFrame, graphs: DataFrame, path_col: str = "video_path") -> DataFrame:
    """Videos of which neither path, stem nor file name is done."""
    done = finished(graphs)
    p = videos[path_col]
    marked = videos.withColumn("__k", F.explode(F.array(p, stem(p), F.regexp_extract(p, r"([^/\\]+)$", 1))))
    hit = marked.join(done, marked["__k"] == done["name"], "left_semi").select(F.col(path_col).alias("__p")).distinct()
    return videos.join(hit, videos[path_col] == hit["__p"], "left_anti")


def list_videos(spark: SparkSession, folder: str, endings: tuple[str, ...] = ("mp4", "avi")) -> DataFrame:
    """(video_path, length, modified), without contents: the scan reads no bytes of a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").option("recursiveFileLookup", "false").load(folder)
    return files.select(F.col("path").alias("video_path"), "length", F.col("modificationTime").alias("modified"))


def shard(videos: DataFrame, index: int, shards: int, most: int | None = None, path_col: str = "video_path") -> DataFrame:
    """Every `shards`-th video by kind (mp4 first) and path, starting at index; `most` cuts the list first."""
    order = [F.when(F.lower(F.col(path_col)).endswith(".mp4"), 0).otherwise(1), F.col(path_col)]
    d = relational.ordinal(videos.withColumn("__kind", order[0]), ["__kind", path_col])
    if most is not None:
        d = d.where(F.col("__ord") < most)
    return d.where(F.pmod("__ord", F.lit(shards)) == index).drop("__kind", "__ord")


def chunk(df: DataFrame, order: list[str], index: int, chunks: int) -> DataFrame:
    """A contiguous slice of ceil(n / chunks) rows; trailing slices may be empty."""
    d = relational.ordinal(df, order)
    size = max(1, -(-d.count() // chunks))
    return d.where((F.col("__ord") >= index * size) & (F.col("__ord") < (index + 1) * size)).drop("__ord")


def split_files(df: DataFrame, order: list[str], chunks: int, path: str) -> None:
    """JSON folders chunk=0.. of contiguous rows."""
    d = relational.ordinal(df, order)
    size = max(1, -(-d.count() // chunks))
    d.withColumn("chunk", F.floor(F.col("__ord") / size).cast("int")).drop("__ord").write.partitionBy("chunk").json(path)


def upsert_file(spark: SparkSession, base: str, new: DataFrame, out: str) -> None:
    """All graphs of base with the videos of new replaced, written to another folder (a store has no atomic rename)."""
    relational.upsert(read_graphs(spark, base), new, ["video_path"]).write.mode("overwrite").json(out)


def in_folder(graphs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Graphs whose video lies in a folder, by path or file name."""
    names = list_videos(spark, folder, VIDEO_ENDINGS).select(F.regexp_extract("video_path", r"([^/\\]+)$", 1).alias("__f")).distinct()
    return graphs.join(names, F.regexp_extract(graphs["video_path"], r"([^/\\]+)$", 1) == names["__f"], "left_semi")


def save_results(results: DataFrame, summary: DataFrame, folder: str, **tags: str) -> None:
    """Rows under results, means under status with tags as columns."""
    results.write.mode("overwrite").json(f"{folder}/results")
    for k, v in tags.items():
        summary = summary.withColumn(k, F.lit(v))
    summary.write.mode("overwrite").json(f"{folder}/status")


def gather_chunks(spark: SparkSession, folder: str, chunks: int, schema: str) -> DataFrame:
    """All chunks' results in chunk order; a missing chunk is an error."""
    d = spark.read.schema(schema + ", chunk int").json(folder)
    seen = {r.chunk for r in d.select("chunk").distinct().collect()}
    if missing := set(range(chunks)) - seen:
        raise FileNotFoundError(f"chunks {sorted(missing)} of {chunks} are missing")
    return d


def attach_tracks(detections: DataFrame, start_id: int = 0) -> DataFrame:
    """Each detection as a track of its own: node id 'class_id' and a running number by video, frame and order."""
    d = relational.ordinal(detections, ["video_path", "frame", "ord"])
    gid = F.col("__ord") + start_id
    return d.withColumn("global_track_id", gid).withColumn("node_id", F.concat_ws("_", F.col("class"), gid.cast("string"))).drop("__ord")


def rle_by_frame(masks: DataFrame, lengths: DataFrame) -> DataFrame:
    """(video_path, frame, masks): every frame of a video, with its (track, size, counts) sorted by track; masks: (video_path, frame, track, size, counts)."""
    frames = lengths.select("video_path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))
    per = masks.groupBy("video_path", "frame").agg(F.sort_array(F.collect_list(F.struct("track", "size", "counts"))).alias("masks"))
    return frames.join(per, ["video_path", "frame"], "left").withColumn("masks", F.coalesce("masks", F.array().cast(per.schema["masks"].dataType)))


def rle_rows(by_frame: DataFrame) -> DataFrame:
    """rle_by_frame undone."""
    return by_frame.select("video_path", "frame", F.explode("masks").alias("m")).select("video_path", "frame", "m.*")


def cut_clips(shots: DataFrame, least_seconds: float, whole: DataFrame) -> DataFrame:
    """Shots of at least so many seconds with their own numbers; a video without shots is one clip. whole: (video_path, n_frames, fps)."""
    kept = shots.where(F.col("end_time") - F.col("start_time") >= least_seconds)
    none = whole.join(shots.select("video_path").distinct(), "video_path", "left_anti")
    full = none.select("video_path", F.lit(0).cast("long").alias("clip_id"), F.lit(0).cast("long").alias("start_frame"), (F.col("n_frames") - 1).cast("long").alias("end_frame"), F.lit(0.0).alias("start_time"), (F.col("n_frames") / F.col("fps")).alias("end_time"))
    return kept.select(*full.columns).unionByName(full)
