"""What a report's views compute from its bounded tables: shares, scales, tones and filtered lists.

Defined results: an empty table gives an empty view; a scale over zeros only is 0; nulls in a filtered column match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Labels of severities, layouts and groups of checks.
LEVEL_LABELS = {"fatal": "Fatal", "error": "Error", "warn": "Warning", "info": "Info", "debug": "Debug", "trace": "Trace", "unknown": "Unclassified"}
LAYOUT_LABELS = {"json": "JSON / JSON Lines", "apache": "Apache / Nginx access log", "syslog": "Syslog", "text": "Delimited text", "generic": "Generic plain text"}
GROUP_LABELS = {
    "availability": "Availability & crashes", "resources": "Resources", "concurrency": "Concurrency", "latency": "Latency & HTTP", "throughput": "Throughput",
    "data": "Data quality", "security": "Security", "configuration": "Configuration", "observability": "Logging hygiene",
}


def label(kind: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), kind), kind)


def severity_slices(levels: DataFrame) -> DataFrame:
    """file_id, level, count, share of the severities that occur."""
    whole = F.sum("count").over(W.partitionBy("file_id"))
    return levels.where("count > 0").select("file_id", "level", "count", (F.col("count") / whole).alias("share"))


def scaled(df: DataFrame, value: str, least: float = 1.0) -> DataFrame:
    """Adds ``scale``: the value over the file's largest (over ``least`` if that is larger)."""
    return df.withColumn("scale", F.col(value) / F.greatest(F.max(value).over(W.partitionBy("file_id")), F.lit(least)))


def health_tone(score: Column) -> Column:
    return F.when(score >= 75, "good").when(score >= 50, "fair").otherwise("poor")


def class_level(name: Column) -> Column:
    """The severity in whose colour a status class is shown."""
    return F.when(name == "5xx", "error").when(name == "4xx", "warn").otherwise("info")


def shown_value(errors: Column, total: Column) -> Column:
    return F.when(errors > 0, errors).otherwise(total)


def problem_lines(problems: DataFrame) -> DataFrame:
    return problems.groupBy("file_id").agg(F.sum("occurrences").alias("lines"))


def worst_p95(operations: DataFrame) -> DataFrame:
    return operations.groupBy("file_id").agg(F.greatest(F.max("p95"), F.lit(1.0)).alias("worst"))


def check_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("file_id", "status").agg(F.count("*").alias("count"))


def open_checks(checks: DataFrame) -> DataFrame:
    return checks.where("status in ('warn', 'fail')")


def issue_list(issues: DataFrame, kind: str = "all", most: int = 40) -> DataFrame:
    """Issues of all severities, of errors (and fatal ones) or of warnings; the first ``most`` of each file."""
    from timberline.operators.aggregate import top

    levels = {"all": None, "error": ("error", "fatal"), "warn": ("warn",)}[kind]
    out = issues if levels is None else issues.where(F.col("level").isin(*levels))
    return top(out.withColumnRenamed("place", "rank"), [F.asc("rank")], most)
