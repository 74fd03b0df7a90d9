"""Aggregates over stitched lines, each keyed by file.

``lines`` is the result of ``stitch``; ``entries`` are its rows with role entry or orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.durations import BUDGET_MS, SEVERE_MS, extract_duration, operation_name
from timberline.functions.levels import RANK, rank
from timberline.functions.normalize import PATTERN_CHARS, title
from timberline.functions.sqltext import Sql, X
from timberline.functions.stack import FRAME_TYPE, compact_frames, source_refs
from timberline.functions.text import any_of, truncate
from timberline.operators.parse import STATUS_IN_TEXT, signed
from timberline.operators.stitch import CHUNK
from timberline.sources.shared import pin

# How much of each list a report holds.
MOST = {"issues": 60, "exceptions": 60, "loggers": 40, "sources": 40, "paths": 60, "statuses": 20, "operations": 20, "frames": 24, "samples": 3, "issue_loggers": 5}
BUCKET_MS = (1_000, 5_000, 10_000, 30_000, 60_000, 300_000, 600_000, 900_000, 1_800_000, 3_600_000, 10_800_000, 21_600_000, 43_200_000, 86_400_000, 604_800_000)
TARGET_BUCKETS, MOST_BUCKETS = 48, 500


def entries_of(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("role").isin("entry", "orphan"))


def top(df: DataFrame, order: list[Column], most: int, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """The first ``most`` rows of each file in the given order."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def first_rows(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key: by chunk of the file, then of what is left, so that no task sees a whole hot key."""
    chunked = df.withColumn("part", F.floor(F.col("line_no") / CHUNK))
    near = chunked.withColumn("k", F.row_number().over(W.partitionBy(*keys, "part").orderBy(order))).where(F.col("k") <= most)
    return near.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("k") <= most).drop("part")


def line_counts(lines: DataFrame) -> DataFrame:
    is_entry = F.col("role").isin("entry", "orphan")
    has_frame = F.col("frame").isNotNull()
    multi = lines.where((F.col("role") == "continuation") & has_frame).select("file_id", "entry_id").distinct()
    orphans = lines.where((F.col("role") == "orphan") & has_frame).select("file_id", "entry_id")
    multi = multi.join(orphans, ["file_id", "entry_id"], "left_anti").groupBy("file_id").agg(F.count("*").alias("multi_line_entries"))
    counts = lines.groupBy("file_id").agg(
        F.count("*").alias("line_count"),
        F.count_if(is_entry).alias("parsed_lines"),
        F.count_if(F.col("role") == "empty").alias("empty_lines"),
        F.count_if((F.col("role") == "entry") & (F.col("level") == "unknown")).alias("unclassified_lines"),
        F.count_if(F.col("role").isin("continuation", "orphan")).alias("continuation_lines"),
    )
    return counts.join(multi, "file_id", "left").fillna(0, ["multi_line_entries"])


def level_counts(lines: DataFrame) -> DataFrame:
    """file_id, level, count: all seven severities for every file."""
    is_entry = F.col("role").isin("entry", "orphan")
    wide = lines.groupBy("file_id").agg(*(F.count_if(is_entry & (F.col("level") == x)).alias(x) for x in RANK))
    return wide.select("file_id", F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.col(x).alias("count")) for x in RANK))).alias("l")).select("file_id", "l.*")


def health(levels: DataFrame) -> DataFrame:
    """file_id, parsed, error_rate, health_score."""
    n = {x: F.sum(F.when(F.col("level") == x, F.col("count")).otherwise(0)) for x in RANK}
    one = levels.groupBy("file_id").agg(F.sum("count").alias("parsed"), *(c.alias(x) for x, c in n.items()))
    total = F.greatest("parsed", F.lit(1))
    errors, warnings, unknown = (F.col("error") + F.col("fatal")) / total, F.col("warn") / total, F.col("unknown") / total
    score = 100 - F.least(F.lit(65.0), errors * 420) - F.least(F.lit(20.0), warnings * 120) - F.least(F.lit(15.0), unknown * 60)
    score = score - F.when(F.col("fatal") > 0, 10).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5)))
    return one.select("file_id", "parsed", errors.alias("error_rate"), score.cast("long").alias("health_score"))


def logger_of() -> Column:
    return F.coalesce("logger", F.substring_index(F.col("exc.type"), ".", 3))


def logger_stats(lines: DataFrame, most: int = MOST["loggers"]) -> DataFrame:
    e = lines.where("role = 'entry'").withColumn("logger", logger_of()).where("logger is not null")
    stats = e.groupBy("file_id", "logger").agg(
        F.count("*").alias("total"), F.count_if(F.col("level").isin("error", "fatal")).alias("errors"),
        F.count_if(F.col("level") == "warn").alias("warnings"), F.min("line_no").alias("first_line"),
    )
    return top(stats, [F.desc("errors"), F.desc("total"), F.asc("first_line")], most)


def exception_counts(lines: DataFrame, most: int = MOST["exceptions"]) -> DataFrame:
    """Exceptions of entries and of continuation headers."""
    e = lines.where("exc is not null and role in ('entry', 'continuation')").select("file_id", "line_no", F.col("exc.type").alias("type"))
    stats = e.groupBy("file_id", "type").agg(F.count("*").alias("count"), F.min("line_no").alias("first_line"))
    return top(stats, [F.desc("count"), F.asc("first_line")], most)


def entry_frames(lines: DataFrame, lead: int = MOST["frames"], keep: int = 200) -> DataFrame:
    """file_id, entry_id, frames (the first ``lead`` of an entry, in order) and ring (the last ``keep``).

    A trace is cut by chunks of lines first, so that one of any length is many tasks; what a chunk leaves is bounded.
    """
    f = lines.where("frame is not null and role in ('continuation', 'orphan')").select("file_id", "entry_id", "line_no", "frame")
    f = f.withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    keys, row = ["file_id", "entry_id"], F.struct("line_no", "frame")
    up, down = (W.partitionBy(*keys, "chunk").orderBy(o) for o in (F.asc("line_no"), F.desc("line_no")))
    f = f.withColumn("k", F.row_number().over(up)).withColumn("back", F.row_number().over(down)).where((F.col("k") <= lead) | (F.col("back") <= keep))
    parts = f.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.when(F.col("k") <= lead, row))).alias("head"), F.array_sort(F.collect_list(F.when(F.col("back") <= keep, row))).alias("tail"))
    # A chunk's part is at most ``lead`` and ``keep`` rows: carried over the chunks, the first ones and the last ones stay.
    earlier = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy("chunk").rowsBetween(1, W.unboundedFollowing)
    parts = parts.withColumn("before", F.coalesce(F.sum(F.size("head")).over(earlier), F.lit(0))).withColumn("behind", F.coalesce(F.sum(F.size("tail")).over(later), F.lit(0)))
    whole = lambda c, cond: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("chunk", c)))), lambda p: p[c]))
    parts = parts.groupBy(*keys).agg(whole("head", F.col("before") < lead).alias("head"), whole("tail", F.col("behind") < keep).alias("tail"))
    last = F.slice("tail", F.greatest(F.size("tail") - keep + 1, F.lit(1)), keep)
    return parts.select(*keys, F.transform(F.slice("head", 1, lead), lambda r: r["frame"]).alias("frames"), F.transform(last, lambda r: r["frame"]).alias("ring"))


def with_frames(lines: DataFrame) -> DataFrame:
    """Entries with their own frames and, for exceptions, the last ones of the entry before (``inherited``)."""
    if lines.where("role in ('continuation', 'orphan')").isEmpty():  # no line goes on another: nothing to gather or to inherit
        none = F.lit(None).cast(f"array<{FRAME_TYPE}>")
        return entries_of(lines).withColumn("frames", none).withColumn("inherited", none)
    e = entries_of(lines).join(entry_frames(lines), ["file_id", "entry_id"], "left")
    e = e.withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    before = W.partitionBy("file_id", "chunk").orderBy("line_no")
    ends = e.groupBy("file_id", "chunk").agg(F.max_by("ring", "line_no").alias("last_ring"))
    ends = ends.withColumn("carried", F.lag("last_ring").over(W.partitionBy("file_id").orderBy("chunk"))).drop("last_ring")
    e = e.join(ends, ["file_id", "chunk"], "left")
    prior = F.when(F.row_number().over(before) == 1, F.col("carried")).otherwise(F.lag("ring").over(before))
    inherited = F.when((F.col("role") == "entry") & F.col("exc").isNotNull(), prior)
    return e.withColumn("inherited", inherited).drop("carried", "chunk", "ring")


def issue_heads(lines: DataFrame, entries: DataFrame, most: int = 64) -> DataFrame:
    """file_id, signature, heads: the types of exception headers on attached lines, in order, that may change a title.

    Once a header's type stands in front of a title, headers whose type that one begins with change nothing. Those are
    left out within each chunk of lines, and of the rest the last ``most`` stay, which fill a title's 120 characters.
    """
    keys = ["file_id", "signature"]
    heads = lines.where("role = 'continuation' and exc is not null").select("file_id", "entry_id", "line_no", F.col("exc.type").alias("type"))
    heads = heads.join(entries.select("file_id", "entry_id", "signature"), ["file_id", "entry_id"]).withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    heads = heads.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("line_no", "type"))).alias("h"))

    def said(types: Sql) -> Sql:
        told = lambda acc, t: X.when((X.size(acc) > 0) & X.coalesce(X.try_element_at(acc, -1).startswith(t), X.lit(False)), acc).otherwise(X.slice(X.array_append(acc, t), X.greatest(X.size(acc) + 2 - most, 1), most))
        return X.aggregate(types, X.array().cast("array<string>"), told)

    heads = heads.select(*keys, "chunk", said(X.transform(X.col("h"), lambda x: x["type"])).alias("t").column, F.col("h")[0]["type"].alias("first"))
    heads = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "t"))).alias("c"), F.min_by("first", "chunk").alias("first_head"))
    return heads.select(*keys, "first_head", F.flatten(F.transform("c", lambda x: x["t"])).alias("heads"))


def source_counts(lines: DataFrame, most: int = MOST["sources"]) -> DataFrame:
    """Places named in messages, and those of frames; inherited frames count again."""
    place = lambda f: F.when(f["file"].isNotNull() & f["line"].isNotNull(), F.concat_ws(":", f["file"], f["line"]))
    said = lines.where("role = 'entry'").select("file_id", "line_no", F.explode(source_refs(X.col("message")).column).alias("location"))
    own = lines.where("frame is not null and role in ('continuation', 'orphan')").select("file_id", "line_no", place(F.col("frame")).alias("location"))
    again = with_frames(lines).where("inherited is not null").select("file_id", "line_no", F.explode("inherited").alias("f"))
    again = again.select("file_id", "line_no", place(F.col("f")).alias("location"))
    stats = said.union(own).union(again).where("location is not null").groupBy("file_id", "location")
    stats = stats.agg(F.count("*").alias("count"), F.min("line_no").alias("first_line"))
    return top(stats, [F.desc("count"), F.asc("first_line")], most)


def http_rows(lines: DataFrame) -> DataFrame:
    e = lines.where("role = 'entry'")
    worded = any_of(X.lower(X.col("message")), ("status", "http/", "responded with")).column
    status = F.coalesce("http.status", F.when(F.col("http").isNull() & worded, F.regexp_extract("message", STATUS_IN_TEXT, 1).try_cast("int")))
    return e.select("file_id", "line_no", "raw", status.alias("status"), F.col("http.path").alias("path"), F.col("http.duration_ms").alias("duration_ms")).where("status is not null")


def http_totals(lines: DataFrame) -> DataFrame:
    return http_rows(lines).groupBy("file_id").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors")).withColumn("error_rate", F.col("errors") / F.col("requests"))


def status_stats(lines: DataFrame, most: int = MOST["statuses"]) -> DataFrame:
    stats = http_rows(lines).groupBy("file_id", "status").agg(F.count("*").alias("count"), F.count_if(F.col("status") >= 500).alias("errors"))
    return top(stats, [F.desc("status")], most)


def status_classes(lines: DataFrame) -> DataFrame:
    return http_rows(lines).groupBy("file_id", F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")).alias("class")).agg(F.count("*").alias("count"))


def path_stats(lines: DataFrame, most: int = MOST["paths"]) -> DataFrame:
    timed = F.when(F.col("duration_ms") >= 0, F.col("duration_ms")).otherwise(0.0)
    stats = http_rows(lines).where("path <> ''").groupBy("file_id", "path").agg(
        F.count("*").alias("count"), F.count_if(F.col("status") >= 500).alias("errors"), (F.sum(timed) / F.count("*")).alias("avg_ms"),
        F.max(timed).alias("max_ms"), F.min("line_no").alias("first_line"),
    )
    return top(stats, [F.desc("errors"), F.desc("count"), F.asc("first_line")], most)


def slowest_request(lines: DataFrame) -> DataFrame:
    r = http_rows(lines).where("path <> '' and duration_ms >= 0")
    best = F.max_by(F.struct("path", "duration_ms", "line_no", truncate(X.col("raw"), 300).alias("raw").column), F.struct("duration_ms", -F.col("line_no")))
    return r.groupBy("file_id").agg(best.alias("s")).select("file_id", "s.*")


def durations(lines: DataFrame) -> DataFrame:
    """file_id, line_no, ms, name, is_http: one row for each timed entry."""
    e = lines.where("role = 'entry'").select("file_id", "line_no", "message", "http")
    timed = F.col("http.duration_ms").isNotNull()
    e = e.withColumn("hit", X.when(X.col("http.duration_ms").isNull(), extract_duration(X.col("message"))).column)
    name = X.when(X.col("http.duration_ms").isNotNull(), X.coalesce(X.col("http.path"), operation_name(X.col("message")))).otherwise(X.col("hit.name")).column
    return e.select("file_id", "line_no", F.when(timed, F.col("http.duration_ms")).otherwise(F.col("hit.ms")).alias("ms"), name.alias("name"), timed.alias("is_http")).where("ms is not null")


#: Values of a percentile's group that lie in one range; ranges hold about so many different values.
RANGES = 256


def _ranked(df: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles; no task sees all values of a group.

    Equal values are counted first. Positive values fall into ranges by their logarithm (``RANGES`` for each doubling); the
    counts of a group's ranges, a few thousand rows at most, tell which range holds each rank, and only the values of
    those ranges are looked at.
    """
    span = F.when(F.col("ms") > 0, F.floor(F.log2("ms") * RANGES)).otherwise(F.lit(-(10**6))).cast("long")
    counts = pin(df.groupBy(*keys, "ms").agg(F.count("*").alias("c")).withColumn("span", span))
    per = counts.groupBy(*keys, "span").agg(F.sum("c").alias("c"))
    upto = W.partitionBy(*keys).orderBy("span").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
    place = F.floor(F.col("q.q") * (F.col("n") - 1) + 0.5).cast("long") + 1
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("which"), F.lit(q).alias("q")) for name, q in quantiles.items()))).alias("q")
    wanted = per.select(*keys, "span", "c", "upto", "n", each).withColumn("place", place)
    wanted = wanted.where("place > upto - c and place <= upto").select(*keys, "span", F.col("q.which").alias("which"), (F.col("place") - F.col("upto") + F.col("c")).alias("place"))
    within = W.partitionBy(*keys, "span").orderBy("ms").rowsBetween(W.unboundedPreceding, 0)
    near = counts.join(wanted.select(*keys, "span").distinct(), [*keys, "span"]).withColumn("upto", F.sum("c").over(within))
    hit = near.join(wanted, [*keys, "span"]).where("place > upto - c and place <= upto")
    return hit.groupBy(*keys).agg(*(F.max(F.when(F.col("which") == name, F.col("ms"))).alias(name) for name in quantiles))


def latency_overall(timed: DataFrame, reservoir: int | None = None) -> DataFrame:
    """Exact counts, and percentiles over all values or the first ``reservoir`` of each file."""
    stats = timed.groupBy("file_id").agg(
        F.count("*").alias("samples"), F.avg("ms").alias("avg"), F.max("ms").alias("max"),
        F.count_if(F.col("ms") > BUDGET_MS).alias("over_budget"), F.count_if(F.col("ms") > SEVERE_MS).alias("severe"),
    )
    if reservoir:
        timed = first_rows(timed, ["file_id"], "line_no", reservoir)
    return stats.join(_ranked(timed, ["file_id"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}), "file_id")


def latency_by_operation(timed: DataFrame, reservoir: int | None = None, most: int = MOST["operations"]) -> DataFrame:
    keys = ["file_id", "name"]
    stats = timed.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.avg("ms").alias("avg"), F.max("ms").alias("max"),
        F.count_if(F.col("ms") > BUDGET_MS).alias("over_budget"), F.min("line_no").alias("first_line"),
    )
    if reservoir:
        timed = first_rows(timed, keys, "line_no", reservoir)
    stats = stats.join(_ranked(timed, keys, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}), keys)
    return top(stats, [F.desc("p95"), F.desc("samples"), F.asc("first_line")], most)


def http_latency(lines: DataFrame) -> DataFrame:
    e = lines.where("role = 'entry' and http is not null")
    timed = e.where("http.duration_ms is not null").select("file_id", F.col("http.duration_ms").alias("ms"))
    n = e.groupBy("file_id").agg(F.count_if(F.col("http.status").isNotNull() & F.col("http.duration_ms").isNotNull()).alias("with_status"), F.count("http.duration_ms").alias("samples"))
    n = n.join(http_totals(lines).select("file_id", F.col("requests").alias("total")), "file_id", "left")
    n = n.withColumn("requests", F.greatest(F.coalesce("total", F.lit(0)), "samples")).withColumn("coverage", F.try_divide("samples", "requests"))
    stats = timed.groupBy("file_id").agg(F.max("ms").alias("max")).join(_ranked(timed, ["file_id"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "file_id")
    return n.drop("total", "with_status").join(stats, "file_id", "left")


def time_range(lines: DataFrame) -> DataFrame:
    """file_id, start_ms, end_ms, duration_ms, out_of_order."""
    e = lines.where("role = 'entry' and ts_ms is not null").select("file_id", "line_no", "ts_ms").withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    step = e.withColumn("before", F.lag("ts_ms").over(W.partitionBy("file_id", "chunk").orderBy("line_no")))
    per = step.groupBy("file_id", "chunk").agg(
        F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"), F.min_by("ts_ms", "line_no").alias("first"), F.max_by("ts_ms", "line_no").alias("last"),
        F.coalesce(F.bool_or(F.col("ts_ms") < F.col("before")), F.lit(False)).alias("back"),
    )
    per = per.withColumn("prior", F.lag("last").over(W.partitionBy("file_id").orderBy("chunk")))
    back = F.bool_or(F.col("back") | F.coalesce(F.col("first") < F.col("prior"), F.lit(False)))
    out = per.groupBy("file_id").agg(F.min("low").alias("start_ms"), F.max("high").alias("end_ms"), back.alias("out_of_order"))
    return out.select("file_id", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "out_of_order")


def timeline(lines: DataFrame) -> DataFrame:
    """Dense buckets of the smallest size that makes at most 48 of them: file_id, t, total, error, warn, info, other.

    Bucket sizes are whole seconds, so the lines are counted by second once, and everything else follows from those counts.
    """
    e = lines.where("role = 'entry' and ts_ms is not null").select("file_id", "ts_ms", "level")
    lanes = ("error", "warn", "info", "other")
    lane = F.when(F.col("level").isin("error", "fatal"), "error").when(F.col("level").isin("warn", "info"), F.col("level")).otherwise("other")
    seconds = e.groupBy("file_id", F.floor(F.col("ts_ms") / 1000).alias("s")).agg(
        F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"), F.count("*").alias("total"), *(F.count_if(lane == x).alias(x) for x in lanes)
    )
    seconds = pin(seconds)
    span = seconds.groupBy("file_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("n")).where("n >= 2 and high > low")
    size = F.lit(BUCKET_MS[-1]).cast("long")
    for ms in reversed(BUCKET_MS):
        size = F.when((F.col("high") - F.col("low")) / ms <= TARGET_BUCKETS, F.lit(ms).cast("long")).otherwise(size)
    span = span.withColumn("size", size).withColumn("start", F.floor(F.col("low") / F.col("size")) * F.col("size"))
    span = span.withColumn("buckets", F.least(F.ceil((F.col("high") - F.col("start")) / F.col("size")) + 1, F.lit(MOST_BUCKETS)))
    dense = span.select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("k"), (F.col("start") + F.col("k") * F.col("size")).alias("t"))
    # One row for each file.
    hits = seconds.join(span.select("file_id", "start", "size", "buckets"), "file_id")
    hits = hits.withColumn("k", F.least(F.floor((F.col("s") * 1000 - F.col("start")) / F.col("size")), F.col("buckets") - 1))
    hits = hits.groupBy("file_id", "k").agg(*(F.sum(x).alias(x) for x in ("total", *lanes)))
    return dense.join(hits, ["file_id", "k"], "left").fillna(0, ["total", *lanes]).drop("k")


def issues(lines: DataFrame, most: int = MOST["issues"]) -> DataFrame:
    """Groups of equal problems by signature, the most severe and frequent first. Lines without signatures get them here, entries only."""
    whole = with_frames(lines)
    e = (whole if "signature" in lines.columns else signed(whole)).withColumn("who", F.when(F.col("role") == "entry", logger_of()))
    e = pin(e.select("file_id", "line_no", "raw", "role", "entry_id", "level", "message", "ts_ms", "exc", "normalized", "signature", "who", "frames", "inherited"))
    keys = ["file_id", "signature"]
    seen = F.when(F.col("ts_ms").isNotNull() & (F.col("role") == "entry"), F.col("line_no"))
    first = lambda c: F.min_by(c, "line_no")
    g = e.groupBy(*keys).agg(
        F.count("*").alias("count"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.min_by("ts_ms", seen).alias("first_seen"), F.max_by("ts_ms", seen).alias("last_seen"), F.max(rank(X.col("level")).column).alias("severity"),
        first(F.col("message")).alias("message"), first(F.substring("normalized", 1, PATTERN_CHARS)).alias("pattern"), first(F.col("exc.type")).alias("first_type"), F.min_by("exc.type", F.when(F.col("exc").isNotNull(), F.col("line_no"))).alias("any_type"),
    )
    parts = []
    if not lines.where("role in ('continuation', 'orphan')").isEmpty():
        # Headers of attached lines (such as causes) put their type in front of the title, in order.
        frames = first_rows(e.where("frames is not null or inherited is not null"), keys, "line_no", MOST["frames"])
        parts = [issue_heads(lines, e), frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "inherited", "frames"))).alias("parts"))]
    else:
        kind = f"array<struct<line_no:bigint,inherited:array<{FRAME_TYPE}>,frames:array<{FRAME_TYPE}>>>"
        g = g.select("*", F.lit(None).cast("string").alias("first_head"), F.lit(None).cast("array<string>").alias("heads"), F.lit(None).cast(kind).alias("parts"))
    names = e.where("who is not null").groupBy(*keys, "who").agg(F.min("line_no").alias("line_no"))
    names = first_rows(names, keys, "line_no", MOST["issue_loggers"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "who"))).alias("who"))
    samples = first_rows(e.where("role = 'entry'"), keys, "line_no", MOST["samples"]).select(*keys, "line_no", truncate(X.col("raw"), 400).alias("raw").column)
    samples = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("samples"))
    for part in (*parts, names, samples):
        g = g.join(part, keys, "left")
    base = title(X.col("message"), X.col("first_type"))
    put = lambda t, h: X.when(t.startswith(h), t).otherwise(title(t, h))
    g = g.withColumn("title", X.when(X.col("heads").isNull(), base).otherwise(X.aggregate(X.col("heads"), base, put)).column)
    none = X.array().cast("array<struct<function:string,file:string,line:int,raw:string>>")

    def grow(acc: Sql, p: Sql) -> Sql:
        own, lent = X.coalesce(p["frames"], none), X.coalesce(p["inherited"], none)
        start = X.when(X.size(acc) == 0, X.slice(compact_frames(lent), 1, MOST["frames"])).otherwise(acc)
        return X.slice(X.concat(start, own), 1, MOST["frames"])

    g = g.withColumn("frames", X.when(X.col("parts").isNull(), none).otherwise(X.aggregate(X.col("parts"), none, grow)).column)
    level = F.element_at(F.map_from_arrays(F.array(*(F.lit(r) for r in RANK.values())), F.array(*(F.lit(x) for x in RANK))), F.col("severity"))
    total = entries_of(lines).groupBy("file_id").agg(F.count("*").alias("parsed"))
    g = g.join(total, "file_id").select(
        *keys, level.alias("level"), "title", "pattern", "count", (F.col("count") / F.col("parsed")).alias("share"), "first_line", "last_line", "first_seen", "last_seen",
        F.coalesce("first_type", "first_head", "any_type").alias("exception_type"), F.transform(F.coalesce("who", F.array().cast("array<struct<line_no:bigint,who:string>>")), lambda w: w["who"]).alias("loggers"),
        "frames", F.coalesce("samples", F.array().cast("array<struct<line_no:bigint,raw:string>>")).alias("samples"), "severity",
    )
    return in_order(g, most)


def in_order(groups: DataFrame, most: int) -> DataFrame:
    """The first ``most`` groups of each file: the most severe, then the most frequent, then by title."""
    order = [F.desc("severity"), F.desc("count"), F.expr("title collate UNICODE"), F.asc("first_line")]
    columns = ["file_id", "signature", "level", "title", "pattern", "count", "share", "first_line", "last_line", "first_seen", "last_seen", "exception_type", "loggers", "frames", "samples"]
    return top(groups, order, most).select(*columns, "place")


def sample_lines(lines: DataFrame, most: int = 2000, lead: int = 200) -> DataFrame:
    """The first ``lead`` entries, then those of severity warn and up or status 500, up to ``most``."""
    q = min(most, lead)
    e = lines.where("role = 'entry'")
    notable = (rank(X.col("level")).column >= RANK["warn"]) | F.coalesce(F.col("http.status") == 500, F.lit(False))
    start = first_rows(e, ["file_id"], "line_no", q).drop("k")
    later = e.where(notable).join(start.groupBy("file_id").agg(F.max("line_no").alias("last"), F.count("*").alias("n")), "file_id").where("n >= %d and line_no > last" % q)
    later = first_rows(later, ["file_id"], "line_no", most - q).drop("k", "last", "n") if most > q else None
    out = start if later is None else start.unionByName(later)
    return out.select("file_id", "line_no", "level", truncate(X.col("raw"), 500).alias("raw").column)
