"""Lines of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.sources.shared import pin

LINE_COLUMNS = ("file_id", "line_no", "raw")


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """file_id, line_no (from 0, in file order), raw, through Spark's own text reader. The files are read once.

    Empty files give no lines. ``\\r`` before a line end is dropped; at the end of a last line without one it is content.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path).where("_metadata.file_size > 0")
    text = text.select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    )
    text = pin(text)
    # A block's lines lie in one task one after the other, so their numbers follow from the block's first.
    blocks = text.groupBy("file_id", "block").agg(F.min("at").alias("first"), F.count("*").alias("count"), F.sum(F.octet_length("raw") + 1).alias("bytes"), F.max("size").alias("size"))
    upto = W.partitionBy("file_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file_id")
    # With a line end behind every line, lines and ends are all that a file holds.
    blocks = blocks.select(
        "file_id", "block", "first", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"), (F.sum("bytes").over(whole) > F.max("size").over(whole)).alias("open"), F.sum("count").over(whole).alias("lines"),
    )
    blocks = pin(blocks)  # small where files are few: known to be so, it is broadcast, and the lines aren't shuffled
    number = F.col("before") + F.col("at") - F.col("first")
    unended = F.col("open") & (number == F.col("lines") - 1)
    return text.join(blocks, ["file_id", "block"]).select("file_id", number.alias("line_no"), F.when(unended, F.col("raw")).otherwise(F.regexp_replace("raw", r"\r\z", "")).alias("raw"))


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None, block_bytes: int | None = None) -> DataFrame:
    """As ``read_lines``, for one path, through the source of lines with places (``logsource``)."""
    from timberline.sources import logsource

    logsource.register(spark)
    reader = spark.read.format("timberline_lines").option("path", path)
    for name, value in (("glob", glob), ("blockBytes", block_bytes)):
        reader = reader if value is None else reader.option(name, str(value))
    text = pin(reader.load())
    blocks = text.groupBy("file_id", "block").agg(F.count("*").alias("count"))
    before = F.sum("count").over(W.partitionBy("file_id").orderBy("block")) - F.col("count")
    return text.join(blocks.select("file_id", "block", before.alias("before")), ["file_id", "block"]).select("file_id", (F.col("before") + F.col("in_block")).alias("line_no"), "raw")


def detect_format(lines: DataFrame, sample: int = 400) -> DataFrame:
    """file_id, format, confidence: the layout of the first ``sample`` non-blank lines of each file."""
    from timberline.functions.levels import detect_level
    from timberline.functions.sqltext import X
    from timberline.functions.stack import is_continuation, stack_frame
    from timberline.functions.text import clean, strip
    from timberline.functions.timestamps import extract_timestamp
    from timberline.operators.parse import ACCESS_LINE, RFC5424, SYSLOG_LINE

    head = lines.where(F.col("raw").rlike(r"\S"))
    head = head.withColumn("k", F.row_number().over(W.partitionBy("file_id").orderBy("line_no"))).where(F.col("k") <= sample)
    head = head.select("file_id", strip(clean(X.col("raw"))).column.alias("line"))
    line, text = F.col("line"), X.col("line")
    # In columns of their own: one expression of them all is more than the code generator takes.
    head = head.withColumn("frame", stack_frame(text).column).withColumn("ts", extract_timestamp(text)["ts_ms"].column)
    head = head.withColumn("level", X.when(X.col("ts").isNotNull(), detect_level(text)["level"]).column)
    kind = (
        F.when(line.startswith("{") & line.endswith("}") & F.try_parse_json(line).isNotNull(), "json")
        .when(line.rlike(ACCESS_LINE), "apache")
        .when(line.rlike(RFC5424) | line.rlike(SYSLOG_LINE), "syslog")
        .when(F.col("ts").isNotNull() & (F.col("level").isNotNull() | is_continuation(text, X.col("frame")).column), "text")
    )
    votes = head.select("file_id", kind.alias("kind")).groupBy("file_id").agg(
        F.count("*").alias("lines"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("json", "apache", "syslog", "text"))
    )
    order = {"json": 4, "apache": 3, "syslog": 2, "text": 1}  # of equal shares the earlier layout wins
    best = F.greatest(*(F.struct(F.col(k).alias("votes"), F.lit(v).alias("order"), F.lit(k).alias("format")) for k, v in order.items()))
    share = F.col("best.votes") / F.col("lines")
    return votes.select("file_id", "lines", best.alias("best")).select(
        "file_id", F.when(share < 0.4, "generic").otherwise(F.col("best.format")).alias("format"), share.alias("confidence")
    )
