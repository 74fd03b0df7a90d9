"""The 53 checks of a report: what each looked at, its status, what it found and an example.

Checks of wording look for patterns in issue groups (``rules.SCANS``); measured ones compare figures of the report with fixed
bounds. Inputs are the bounded tables of a report. Defined results: every file has every check, also one without issues,
times or requests; where there is too little to judge, the status is ``unknown``. No files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.text import LARGE, shortened
from timberline.operators.aggregate import RANK
from timberline.plans import rules

# The checks in their order.
ORDER = (
    "fatal-lines", "process-crash", "oom", "unhandled-errors", "error-rate", "dependency-failure", "partial-failure", "restart-loop", "file-descriptors", "disk-full", "gc-pressure",
    "thread-pool", "pool-exhaustion", "deadlock", "race-condition", "lock-contention", "duplicate-work", "latency-p95", "latency-outliers", "latency-operations", "latency-over-budget",
    "http-latency-coverage", "http-5xx", "http-4xx", "error-burst", "traffic-spike", "error-spike", "volume-drop", "retry-storm", "rate-limiting", "timestamps", "clock-skew",
    "malformed-lines", "json-parse", "corruption", "schema-drift", "encoding", "secret-exposure", "auth-failures", "privilege", "injection", "tls", "dns", "config-missing", "port-conflict",
    "env-drift", "incompatible-runtime", "deprecations", "log-noise", "single-logger", "correlation-id", "structure", "error-context",
)
#: Our own names for what the measured checks look at; the others are named after their id.
NAMES = {
    "fatal-lines": "Fatal lines", "error-rate": "Share of errors", "latency-p95": "95th percentile of timings", "latency-outliers": "Timings far off", "latency-operations": "Slow operations",
    "latency-over-budget": "Timings over 1 s", "http-latency-coverage": "Requests with a time", "http-5xx": "Requests answered 5xx", "http-4xx": "Requests answered 4xx",
    "error-burst": "Groups within a minute", "traffic-spike": "Peaks of volume", "error-spike": "Peaks of errors", "volume-drop": "Volume at the end", "timestamps": "Times of lines",
    "malformed-lines": "Lines without a level", "log-noise": "Debug and trace lines", "single-logger": "Loggers", "correlation-id": "Request ids", "structure": "Layout", "error-context": "Context of errors",
}


def fixed(x: Column, digits: int) -> Column:
    """As ``fixed`` of ``functions/text.py``, of a column."""
    shown = lambda v: F.when(v < LARGE, shortened(v, digits, F.floor, F.when) / float(10**digits)).otherwise(v)
    return F.get(F.transform(F.array(x.cast("double")), lambda v: F.when(v.isNotNull(), F.format_string(f"%.{digits}f", shown(v)))), F.lit(0))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def short_ms(x: Column) -> Column:
    """``850ms``, ``4.20s``, ``2.5m``."""
    return (
        F.when(x >= 60_000, F.concat(fixed(x / 60_000.0, 1), F.lit("m")))
        .when(x >= 1_000, F.concat(fixed(x / 1_000.0, 2), F.lit("s")))
        .otherwise(F.concat(F.floor(x + 0.5).cast("string"), F.lit("ms")))
    )


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def said(*parts: object) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def times(figure: Column) -> Column:
    return F.concat(fixed(figure, 1), F.lit(" times"))


def timeline_facts(timeline: DataFrame) -> DataFrame:
    """Peaks and typical values of a file's buckets (at most 500 of them)."""
    share = F.when(F.col("total") > 0, F.col("error") / F.col("total"))
    t = timeline.withColumn("share", share).withColumn("back", F.row_number().over(W.partitionBy("file_id", F.col("total") > 0).orderBy(F.desc("t"))))
    filled = F.when(F.col("total") > 0, F.col("total"))
    return t.groupBy("file_id").agg(
        F.count("*").alias("buckets"), F.count(filled).alias("filled"), F.max("total").alias("peak"), F.median("total").alias("typical"), F.median(filled).alias("typical_filled"),
        F.max("share").alias("peak_errors"), F.median("share").alias("typical_errors"), F.avg(F.when((F.col("total") > 0) & (F.col("back") <= 3), F.col("total"))).alias("tail"),
    )


def _facts(t: dict[str, DataFrame]) -> DataFrame:
    """One row for each file with all figures that the measured checks compare."""
    levels = F.struct(*(F.sum(F.when(F.col("level") == x, F.col("count")).otherwise(0)).alias(x) for x in RANK))
    one = t["counts"].join(t["levels"].groupBy("file_id").agg(levels.alias("l")).select("file_id", "l.*"), "file_id")
    text = F.lower(F.concat_ws(" ", "pattern", "title", "exception_type", F.get("samples", F.lit(0))["raw"]))
    sample = F.get("samples", F.lit(0))["raw"]
    severe, grave = F.col("level").isin("warn", "error", "fatal"), F.col("level").isin("error", "fatal")
    burst = severe & (F.col("count") > 20) & (F.col("last_seen") - F.col("first_seen") < 60_000)
    traced, fatal = text.rlike("(?i)" + rules.CORRELATION), text.rlike("fatal|critical|emerg|alert|panic")
    context = grave & ((F.size("frames") > 0) | F.col("exception_type").isNotNull())
    first = lambda what, cond: F.min_by(what, F.when(cond, F.col("place")))
    issues = t["issues"].groupBy("file_id").agg(
        F.count_if(burst).alias("bursts"), first(F.struct("title", "count", sample.alias("raw")), burst).alias("burst"), F.sum(F.when(traced, F.col("count"))).alias("traced"),
        first(sample, traced).alias("traced_line"), first(sample, fatal).alias("fatal_line"), F.count_if(grave).alias("grave"), F.count_if(context).alias("with_context"),
    )
    operations = t["operations"].groupBy("file_id").agg(
        F.count("*").alias("operations"), F.count_if((F.col("samples") >= 2) & (F.col("p95") > 1000)).alias("slow_ops"), F.min_by(F.struct("name", "p95", "max"), "place").alias("worst_op"),
    )
    latency = t["latency"].select("file_id", "samples", F.col("max").alias("lat_max"), "p50", "p95", "p99", "over_budget", "severe")
    classes = t["status_classes"].groupBy("file_id").agg(*(F.sum(F.when(F.col("class") == f"{k}xx", F.col("count"))).alias(f"c{k}") for k in (4, 5)))
    loggers = t["loggers"].groupBy("file_id").agg(F.count("*").alias("loggers"), F.min_by(F.struct("logger", "total"), "place").alias("busiest"))
    for part in (
        issues, operations, latency, classes, loggers, t["formats"].select("file_id", "format"), t["time_range"].select("file_id", "start_ms", "duration_ms", "out_of_order"),
        t["http"].select("file_id", "requests"), t["http_latency"].select("file_id", F.col("samples").alias("timed"), "coverage", F.col("p95").alias("http_p95")),
        t["paths"].where("errors > 0").groupBy("file_id").agg(F.min_by("path", "place").alias("bad_path")), timeline_facts(t["timeline"]),
    ):
        one = one.join(part, "file_id", "left")
    return one


def measured(t: dict[str, DataFrame]) -> DataFrame:
    """file_id, id, group, status, detail, evidence of the checks that look at figures."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    col, none = F.col, F.lit(None).cast("string")
    parsed = F.greatest("parsed_lines", F.lit(1))
    errors = col("error") + col("fatal")
    error_rate, unclear, noise = errors / parsed, col("unclassified_lines") / parsed, (col("debug") + col("trace")) / parsed
    few, untimed = c("requests") < 3, c("samples") == 0
    server, client = c("c5") / c("requests"), c("c4") / c("requests")
    budget = said("p95 ", short_ms(col("p95")), ", median ", short_ms(col("p50")), ", p99 ", short_ms(col("p99")), ", most ", short_ms(col("lat_max")), ", ", grouped(col("samples")), " timings")
    worst = said('"', col("worst_op.name"), '" with p95 ', short_ms(col("worst_op.p95")))
    spread, ratio = said("most in a bucket ", grouped(col("peak")), ", median ", grouped(col("typical"))), col("peak") / col("typical")
    shares = said("most in a bucket ", percent(col("peak_errors"), 2), ", median ", percent(col("typical_errors"), 2))
    told_5xx = said(grouped(c("c5")), " of ", grouped(c("requests")), " requests (", percent(server, 2), ")")
    told_4xx = said(grouped(c("c4")), " of ", grouped(c("requests")), " requests (", percent(client, 2), ")")
    # (id, group, ways): of the ways (condition, status, detail, evidence) the first whose condition holds.
    yes = F.lit(True)
    table = (
        ("fatal-lines", "availability", (col("fatal") > 0, "fail", said(grouped(col("fatal")), " fatal lines"), col("fatal_line")), (yes, "pass", "no fatal line", none)),
        (
            "error-rate", "availability", (error_rate > 0.05, "fail", said(percent(error_rate, 2), " of the lines are errors"), none),
            (error_rate > 0.01, "warn", said(percent(error_rate, 2), " of the lines are errors (", grouped(errors), ")"), none), (yes, "pass", said(percent(error_rate, 2), " of the lines are errors"), none),
        ),
        ("latency-p95", "latency", (untimed, "unknown", "no timings", none), (c("p95") > 1000, "warn", budget, none), (yes, "pass", budget, none)),
        (
            "latency-outliers", "latency", (c("samples") < 5, "unknown", "fewer than 5 timings", none),
            (c("lat_max") > F.greatest(F.lit(1000.0), c("p95") * 4), "warn", said("most ", short_ms(col("lat_max")), " against p95 ", short_ms(col("p95")), "; ", grouped(col("severe")), " over 5 s"), none),
            (yes, "pass", said("most ", short_ms(col("lat_max")), " against p95 ", short_ms(col("p95"))), none),
        ),
        (
            "latency-operations", "latency", (c("operations") == 0, "unknown", "no timed operation", none),
            (c("slow_ops") > 0, "warn", said(col("slow_ops").cast("string"), " operations over 1 s at p95; slowest ", worst), none), (yes, "pass", said("slowest ", worst), none),
        ),
        (
            "latency-over-budget", "latency", (untimed, "unknown", "no timings", none),
            (c("over_budget") > 0, "warn", said(grouped(col("over_budget")), " of ", grouped(col("samples")), " timings (", percent(col("over_budget") / col("samples")), ") over 1 s"), none),
            (yes, "pass", "no timing over 1 s", none),
        ),
        (
            "http-latency-coverage", "latency", (few, "unknown", "fewer than 3 requests", none),
            (c("coverage") < 0.5, "warn", said(grouped(c("timed")), " of ", grouped(c("requests")), " requests have a time"), none),
            (yes, "pass", said(percent(col("coverage"), 0), " of the requests have a time, p95 ", short_ms(col("http_p95"))), none),
        ),
        ("http-5xx", "latency", (few, "unknown", "fewer than 3 requests", none), (server > 0.05, "fail", told_5xx, col("bad_path")), (c("c5") > 0, "warn", told_5xx, col("bad_path")), (yes, "pass", told_5xx, none)),
        ("http-4xx", "latency", (few, "unknown", "fewer than 3 requests", none), (client > 0.1, "warn", told_4xx, col("bad_path")), (yes, "pass", told_4xx, none)),
        (
            "error-burst", "throughput",
            (c("bursts") > 0, "warn", said(col("bursts").cast("string"), ' groups came within a minute; first "', col("burst.title"), '" with ', col("burst.count").cast("string"), " lines"), col("burst.raw")),
            (yes, "pass", "no group of more than 20 lines within a minute", none),
        ),
        (
            "traffic-spike", "throughput", (c("buckets") < 4, "unknown", "fewer than 4 buckets", none), (c("typical") <= 0, "unknown", "most buckets are empty", none),
            (ratio > 3, "warn", said(spread, ": ", times(ratio)), none), (yes, "pass", said(spread, ": ", times(ratio)), none),
        ),
        (
            "error-spike", "throughput", (c("filled") < 4, "unknown", "fewer than 4 buckets with lines", none),
            ((col("peak_errors") > 0.02) & (col("peak_errors") > 3 * col("typical_errors")), "warn", shares, none), (yes, "pass", shares, none),
        ),
        (
            "volume-drop", "throughput", (c("filled") < 6, "unknown", "fewer than 6 buckets with lines", none),
            (col("tail") < 0.25 * col("typical_filled"), "warn", said("the last three buckets have ", percent(col("tail") / col("typical_filled")), " of the median"), none),
            (yes, "pass", said("the last three buckets have ", percent(col("tail") / col("typical_filled")), " of the median"), none),
        ),
        (
            "timestamps", "data", (col("start_ms").isNull(), "unknown", "no line has a time", none), (col("out_of_order"), "warn", "times go back", none),
            (yes, "pass", said("times span ", short_ms(col("duration_ms").cast("double"))), none),
        ),
        ("malformed-lines", "data", (col("parsed_lines") == 0, "fail", "no line is an entry", none), (unclear > 0.2, "warn", said(percent(unclear, 0), " of the entries have no level"), none), (yes, "pass", said(percent(unclear, 0), " of the entries have no level"), none)),
        ("log-noise", "observability", (col("parsed_lines") == 0, "unknown", "no line is an entry", none), (noise > 0.4, "warn", said(percent(noise, 0), " of the entries are debug or trace"), none), (yes, "pass", said(percent(noise, 0), " of the entries are debug or trace"), none)),
        (
            "single-logger", "observability", (col("parsed_lines") < 200, "unknown", "fewer than 200 entries", none), (c("loggers") <= 1, "warn", "one logger or none", none),
            (yes, "pass", said(col("loggers").cast("string"), " loggers; most lines (", percent(col("busiest.total") / parsed, 0), ") from ", col("busiest.logger")), none),
        ),
        (
            "correlation-id", "observability", (col("parsed_lines") < 200, "unknown", "fewer than 200 entries", none), (c("traced") == 0, "warn", "no request or trace id", none),
            (yes, "pass", said(grouped(col("traced")), " lines hold a request or trace id"), col("traced_line")),
        ),
        (
            "structure", "observability", (F.coalesce(col("format"), F.lit("")).isin("json", "apache", "syslog"), "pass", said("layout ", col("format")), none),
            (yes, "warn", "free text, fields are guessed", none),
        ),
        (
            "error-context", "observability", (c("grave") == 0, "pass", "no error groups", none), (c("with_context") == 0, "warn", said("none of ", col("grave").cast("string"), " error groups has a type or frames"), none),
            (yes, "pass", said(col("with_context").cast("string"), " of ", col("grave").cast("string"), " error groups have a type or frames"), none),
        ),
    )

    def verdict(ways: tuple) -> Column:
        out = None
        for condition, status, detail, evidence in ways:
            v = F.struct(F.lit(status).alias("status"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"), evidence.alias("evidence"))
            out = F.when(condition, v) if out is None else out.when(condition, v)
        return out

    each = F.explode(F.array(*(F.struct(F.lit(a).alias("id"), F.lit(b).alias("group"), verdict(ways).alias("v")) for a, b, *ways in table)))
    return _facts(t).select("file_id", each.alias("c")).select("file_id", "c.id", "c.group", "c.v.*")


def worded(t: dict[str, DataFrame]) -> DataFrame:
    """file_id, id, group, status, detail, evidence of the checks that look for wording."""
    found = rules.scans(t["issues"])
    told = F.when(F.col("lines") > 0, said(grouped(F.col("lines")), " lines in ", F.col("groups").cast("string"), " groups")).otherwise("not found")
    found = found.select("file_id", "id", "group", "status", told.alias("detail"), F.col("sample").alias("evidence"))
    # A file without issues passes every wording check.
    every = F.explode(F.array(*(F.struct(F.lit(a).alias("id"), F.lit(b).alias("group")) for a, b, _, _ in rules.SCANS)))
    rest = t["counts"].select("file_id").join(t["issues"].select("file_id").distinct(), "file_id", "left_anti").select("file_id", every.alias("r"))
    return found.union(rest.select("file_id", "r.*", F.lit("pass"), F.lit("not found"), F.lit(None).cast("string")))


def checks(t: dict[str, DataFrame]) -> DataFrame:
    """All 53 checks of every file: file_id, id, group, title, status, detail, evidence, place."""
    names = {k: NAMES.get(k, k.replace("-", " ").capitalize()) for k in ORDER}
    lookup = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    both = measured(t).union(worded(t))
    place = F.try_element_at(lookup({k: n for n, k in enumerate(ORDER, 1)}), F.col("id"))
    return both.select("file_id", "id", "group", F.try_element_at(lookup(names), F.col("id")).alias("title"), "status", "detail", "evidence", place.alias("place"))
