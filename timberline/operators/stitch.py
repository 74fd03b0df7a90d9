"""Attaches continuation lines to the entries that they belong to.

Order matters along a whole file, so lines are windowed in chunks of ``CHUNK`` lines; what a chunk needs from those before
it (the last entry, frame and definite entry) comes from a small table of chunks. A single huge file is thus many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.sqltext import X
from timberline.functions.text import clean
from timberline.functions.timestamps import extract_timestamp
from timberline.sources.shared import pin

CHUNK = 100_000


def _carried(df: DataFrame, **marks: str) -> DataFrame:
    """Adds for each name the largest value of its expression on earlier lines of the file."""
    per = df.groupBy("file_id", "chunk").agg(*(F.max(F.expr(e)).alias(n) for n, e in marks.items()))
    earlier = W.partitionBy("file_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("file_id", "chunk", *(F.max(n).over(earlier).alias(f"c_{n}") for n in marks))
    inside = W.partitionBy("file_id", "chunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    df = df.join(per, ["file_id", "chunk"])
    for name, e in marks.items():
        df = df.withColumn(name, F.coalesce(F.max(F.expr(e)).over(inside), F.col(f"c_{name}"))).drop(f"c_{name}")
    return df


def flagged(parsed: DataFrame) -> DataFrame:
    """Adds what stitching looks at: whether a line is a frame of a trace, may be a trace's body, or surely begins an entry."""
    lead = F.col("raw").rlike(r"^(\s{2,}|\t)")
    indented = lead & F.col("frame").isNull() & X.when(X.col("raw").rlike(r"^(\s{2,}|\t)"), extract_timestamp(clean(X.col("raw")))).column.isNull()
    df = parsed.withColumn("is_frame", F.col("continuation") & F.col("frame").isNotNull())
    df = df.withColumn("maybe_body", ~F.col("is_empty") & ~F.col("continuation") & indented)
    return df.withColumn("sure", ~F.col("is_empty") & ~F.col("continuation") & ~F.col("maybe_body"))


def stitch(parsed: DataFrame) -> DataFrame:
    """Adds ``role`` (entry, continuation, orphan or empty) and ``entry_id`` (line_no of the entry a line belongs to).

    A line of blanks doesn't end a trace. An indented line without a timestamp is part of a trace if a frame has been seen
    since the last sure entry. A continuation with no entry before it opens an entry of its own (an orphan).
    """
    parsed = pin(parsed)
    if flagged(parsed).where("continuation or maybe_body").isEmpty():  # no line can go on another: nothing to carry or to join
        role, own = F.when(F.col("is_empty"), "empty").otherwise("entry"), F.when(~F.col("is_empty"), F.col("line_no"))
        return parsed.withColumn("role", role).withColumn("entry_id", own)
    # The windows see flags only; the lines themselves join once, at the end.
    df = pin(flagged(parsed).select("file_id", "line_no", F.floor(F.col("line_no") / CHUNK).alias("chunk"), "is_empty", "continuation", "is_frame", "maybe_body", "sure"))
    df = _carried(df, last_sure="if(sure, line_no, null)", last_frame="if(is_frame, line_no, null)")
    body = F.col("maybe_body") & F.coalesce(F.col("last_frame") > F.coalesce("last_sure", F.lit(-1)), F.lit(False))
    df = df.withColumn("attached", ~F.col("is_empty") & (F.col("continuation") | body))
    df = pin(df.withColumn("starts", ~F.col("is_empty") & ~F.col("attached")).select("file_id", "line_no", "chunk", "is_empty", "attached", "starts"))
    first = df.where("attached").groupBy("file_id").agg(F.min("line_no").alias("first_attached"))
    df = _carried(df, last_entry="if(starts, line_no, null)").join(first, "file_id", "left")
    orphan = F.col("attached") & F.col("last_entry").isNull() & (F.col("line_no") == F.col("first_attached"))
    role = F.when(F.col("is_empty"), "empty").when(orphan, "orphan").when(F.col("attached"), "continuation").otherwise("entry")
    own = F.when(role.isin("entry", "orphan"), F.col("line_no")).when(role == "continuation", F.coalesce("last_entry", "first_attached"))
    df = df.select("file_id", "line_no", role.alias("role"), own.alias("entry_id"))
    out = parsed.join(df, ["file_id", "line_no"])
    # An orphan counts as an error.
    return pin(out.withColumn("level", F.when((F.col("role") == "orphan") & (F.col("level") == "unknown"), "error").otherwise(F.col("level"))))
