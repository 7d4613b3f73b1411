"""Windowed counts of an event stream: tumbling, sliding and session windows, late rows bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def windowed_counts(events: DataFrame, window: Column, by: list[str], late: str = "1 hour") -> DataFrame:
    """(window, *by, events, last_event) of a stream or a table with ts and event_id."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(window.alias("window"), *by).agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))


def run_available(spark, stream: DataFrame, keys: list[str], folder: str, mode: str = "update") -> DataFrame:
    """Runs an aggregated stream over what is there and gives the last state of every group.

    In update mode a batch writes the groups that it changed, so state that the watermark has
    passed is dropped, and the last row of a group wins; in append mode (session windows) only
    finished groups come.  ``folder`` holds state and results and must be shared by the
    cluster: given the same one, a run goes on from the last committed batch.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/out/*")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return found.withColumn("place", last).where("place = 1").drop("place", "batch")


def _folder(spark) -> str:
    """A new place in the cluster's shared folder; one of this machine only where driver and executor are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="folioscope-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir: str) -> DataFrame:
    """The table taken as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


_MINUTE = "yyyy-MM-dd HH:mm"


def stream_rollup(spark, sf_dir: str) -> DataFrame:
    """Hourly counts by type."""
    counts = windowed_counts(_events(spark, sf_dir), F.window("ts", "1 hour"), ["event_type"])
    out = run_available(spark, counts, ["window", "event_type"], _folder(spark))
    return out.select(F.date_format("window.start", _MINUTE).alias("hour"), "event_type", "events", "last_event")


def stream_sliding(spark, sf_dir: str) -> DataFrame:
    """Counts of two hours, every hour."""
    counts = windowed_counts(_events(spark, sf_dir), F.window("ts", "2 hours", "1 hour"), [])
    out = run_available(spark, counts, ["window"], _folder(spark))
    return out.select(F.date_format("window.start", _MINUTE).alias("start"), "events", "last_event")


def session_counts(spark, sf_dir: str) -> DataFrame:
    """Sessions of a user, ended by half an hour without an event; the operator is the stream's, run over the table."""
    counts = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), F.session_window("ts", "30 minutes"), ["user_id"])
    return counts.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "last_event")


QUERIES = {"stream_rollup": stream_rollup, "stream_sliding": stream_sliding, "session_counts": session_counts}
ORACLES = {
    "stream_rollup": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(h - i * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS start, count(*) AS events, max(event_id) AS last_event FROM (SELECT date_trunc('hour', ts) AS h, event_id FROM events), range(2) r(i) GROUP BY 1",
    "session_counts": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, max(event_id) AS last_event FROM s GROUP BY user_id, k""",
}
