"""Streams of documents: the same transformations as in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import htmlmd


def html_stream(files: DataFrame, options: htmlmd.Options = htmlmd.Options()) -> DataFrame:
    """A stream of files (path, content) -> path, markdown, error; stateless."""
    src = files.select("path", F.decode("content", "UTF-8").alias("html"))
    return htmlmd.html_to_markdown(src, "path", "html", options)


def run_counts(runs: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Runs by provider and event-time window; rows later than ``late`` are closed out by the watermark.
    Redelivered runs count once within it."""
    r = runs.select("run_id", F.lower(F.trim("provider")).alias("provider"), F.col("started_at").cast("timestamp").alias("ts"), F.coalesce("success", F.lit(False)).alias("ok"))
    r = r.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id"]) if runs.isStreaming else r.dropDuplicates(["run_id"])
    return r.groupBy(F.window("ts", window).alias("w"), "provider").agg(F.count("*").alias("n_runs"), F.count_if("ok").alias("n_success")).select(F.col("w.start").alias("window_start"), "provider", "n_runs", "n_success")


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived, exactly once, then stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
