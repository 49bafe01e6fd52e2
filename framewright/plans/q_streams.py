"""Streaming queries, run to the end of what is there; results are read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.plans.registry import query
from framewright.prep import sampling
from framewright.session import shared_folder
from framewright.streaming import streams


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream, be it one file or a folder of part files: a pattern finds both, a plain path only folders."""
    e = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event[s].parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark: SparkSession, d: DataFrame) -> DataFrame:
    base = shared_folder(spark, "stream")
    streams.without_tail(d, f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.schema(d.schema).parquet(f"{base}/out")


#: What the watermark (the last event less an hour) has closed.
_CLOSED = "(SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 HOUR FROM events)"


@query("stream_sessions", f"""WITH o AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS t, value, CASE WHEN CAST(ts AS TIMESTAMP) >= lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(t) AS start, max(t) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS peak_value FROM k GROUP BY user_id, k HAVING max(t) + INTERVAL 6 HOUR <= {_CLOSED}""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that the watermark has closed; those still open at the end of the input (its last 7 hours) aren't given."""
    d = streams.session_stream(_stream(spark, sf), "ts", ["user_id"], "value", "6 hours", "1 hour")
    return _finished(spark, d).withColumn("mean_value", F.round("mean_value", 6))


@query("stream_windows", f"""WITH e AS (SELECT event_type, value, CAST(ts AS TIMESTAMP) AS t FROM events), w AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, t, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, t, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS start FROM e)
SELECT start, start + INTERVAL 24 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL HAVING start + INTERVAL 24 HOUR <= {_CLOSED}""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark has closed; those still open at the end of the input (its last 25 hours) aren't given."""
    d = streams.windowed_stream(_stream(spark, sf), "ts", ["event_type"], "value", "1 day", "12 hours", "1 hour")
    return _finished(spark, d).withColumn("total", F.round("total", 4))


@query("seeded_order", "SELECT event_id, row_number() OVER (ORDER BY CAST(('0x' || substr(md5(event_id || ':7'), 1, 12)) AS BIGINT), event_id) - 1 AS position FROM events")
def seeded_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every row in a seeded order."""
    return sampling.shuffled(spark.read.parquet(f"{sf}/events.parquet").select("event_id"), "event_id", 7)


@query("reservoir_shuffle", "SELECT event_id, event_type FROM events")
def reservoir_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Every row once through the buffers of four lanes; the stream ends once a lane that heard nothing has given its buffer.

    The order inside the buffers is held against the plain rule in the tests.
    """
    base = shared_folder(spark, "shuffle")
    rows = streams.buffered_shuffle(_stream(spark, sf), "event_id", "event_type", 4, 256, 7, idle_ms=200)
    w = rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(processingTime="300 milliseconds").start(f"{base}/out")
    want = spark.read.parquet(f"{sf}/events.parquet").count()
    schema = rows.schema
    for _ in range(600):
        if w.exception() or not w.isActive:
            break
        if w.recentProgress and any(p["numInputRows"] for p in w.recentProgress) and w.lastProgress["stateOperators"] and w.lastProgress["stateOperators"][0]["numRowsTotal"] == 0 and spark.read.schema(schema).parquet(f"{base}/out").count() == want:
            break
        w.awaitTermination(0.3)
    w.stop()
    if w.exception():
        raise w.exception()
    return spark.read.schema(schema).parquet(f"{base}/out").select("event_id", "event_type")
