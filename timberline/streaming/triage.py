"""Triage of unbounded logs: typed lines, and severities in event-time windows with late lines dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.parse import parse_lines


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they arrive. Numbers within a file aren't known in a stream, so ``line_no`` is null."""
    text = spark.readStream.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file_id"), F.lit(None).cast("long").alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("raw"))


def windowed_levels(lines: DataFrame, layout: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """window start, severity, count; continuation lines and lines without a time are left out."""
    p = parse_lines(lines, layout=layout).where("not is_empty and not continuation and ts_ms is not null")
    p = p.select(F.timestamp_millis("ts_ms").alias("at"), "level").withWatermark("at", late)
    return p.groupBy(F.window("at", window).alias("w"), "level").agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "level", "count")
