"""Structured Streaming forms of the monitoring operators, over the events schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """A file stream of events; ts becomes a timestamp, since watermarks ask for one."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "5 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", size), "event_type").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("bin"), "event_type", "mean", "total", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there into a table in memory."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return df.sparkSession.table(name)


def metric_stream(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """A stream of a folder of JSON lines of metrics; lines without a sound time go."""
    rows = spark.readStream.schema("timestamp string, metric string, value double, metadata map<string,string>").json(path)
    return rows.withColumn("ts", F.try_to_timestamp("timestamp")).where("ts is not null").withWatermark("ts", late)


def append_metrics(metrics: DataFrame, path: str, checkpoint: str) -> None:
    """Write what a stream of metrics has, once, behind a log of JSON lines."""
    rows = metrics.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), "metric", "value", "metadata")
    rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
