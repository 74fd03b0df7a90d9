"""Findings that follow from numbers, all findings in one ranked table, and the recommended order of work.

Inputs are the bounded tables of a report (at most some hundred rows for each file). Defined results: a file without HTTP
lines or timings has no finding of that kind; null measures count as absent; equal ranks keep detectors before HTTP before
latency findings, and these in their own order. No files give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.sqltext import Sql, X
from timberline.functions.text import percent, round_half_up, short_ms
from timberline.operators.aggregate import top
from timberline.plans import rules

#: Our own words for what a detector or a computed finding means and what to do about it.
WORDS = {
    "memory": ("Memory ran out", "Compare the heap with its limit at that time and find what grows."),
    "timeouts": ("Calls time out", "Find the callee that is late and give each call a limit of its own."),
    "connection": ("Connections fail", "Check that the other side listens and that its limits fit."),
    "database": ("Database trouble", "Look at the statement, its locks and the pool's size."),
    "crash": ("A process crashed", "Read the first frame of the crash and the last lines before it."),
    "unhandled": ("Errors leave every handler", "Handle the error where it can be answered."),
    "nulls": ("Values are missing where code needs them", "Check the value at the failing line and where it comes from."),
    "resources": ("A limit of the system is reached", "Find what holds files, space or threads, and release it."),
    "auth": ("Access is refused", "Check whose credentials are refused, and since when."),
    "rate-limit": ("Requests are throttled", "Slow down, spread the calls, or ask for a higher limit."),
    "retries": ("Work is retried", "Find what fails first; retries only show it."),
    "dns-tls": ("Names or certificates fail", "Resolve the name from that host and look at the certificate's dates."),
    "corruption": ("Data is damaged", "Keep the bad input and find who wrote it."),
    "deprecation": ("Something in use will go away", "Plan the replacement before the stated version."),
    "slow": ("Operations are slow", "Profile the slowest and compare it with the median."),
    "gc-pause": ("Collections pause the process", "Look at allocation and heap size."),
    "lock-wait": ("Work waits for locks", "Shorten what the lock covers."),
    "circuit-breaker": ("Parts run in degraded mode", "Restore what the breaker protects from."),
    "container-restart": ("Containers restart", "Read the last events of the container."),
    "logging-noise": ("Logging is too verbose", "Raise the level where nobody reads it."),
    "http-5xx": ("Requests fail on the server's side", "Take the path with the most failures and find the frame that throws."),
    "http-4xx": ("Many client errors", "Look for a route or a parameter that these requests share."),
    "http-slowest-endpoint": ("A route takes over a second", "Profile that route and watch its response time."),
    "latency-p95": ("The tail exceeds the budget of 1 s", "Look at the slowest operations: a few of them often make the tail."),
    "latency-outlier": ("Outliers far above the 95th percentile", "See whether the outliers share a retry, a pause or a callee."),
    "latency-coverage": ("Most requests have no response time", "Log the response time of every request."),
    "latency-slowest-endpoint": ("The slowest request", "Repeat that request and profile it."),
}
SLOW_OPERATION = ("Slow operation", "Trace this operation and give it a limit.")
MOST_LATENCY, MOST_RECOMMENDATIONS = 6, 8


def _rows(df: DataFrame, *found: tuple[str, str, Sql, Sql, Sql]) -> DataFrame:
    """file_id, id, severity, occurrences, title, detail, order of (id, severity, condition, occurrences, detail)."""
    each = [
        X.when(condition, X.struct(X.lit(name).alias("id"), X.lit(severity).alias("severity"), n.cast("bigint").alias("occurrences"), X.lit(WORDS[name][0]).alias("title"), detail.alias("detail"), X.lit(k).alias("order")))
        for k, (name, severity, condition, n, detail) in enumerate(found)
    ]
    return df.select("file_id", F.explode(X.array_compact(X.array(*each)).column).alias("f")).select("file_id", "f.*")


def http_findings(http: DataFrame, classes: DataFrame, slowest: DataFrame) -> DataFrame:
    share = classes.groupBy("file_id").agg(*(F.sum(F.when(F.col("class") == f"{k}xx", F.col("count"))).alias(name) for k, name in ((5, "server"), (4, "client"))))
    one = http.where("requests >= 3").join(share, "file_id", "left").join(slowest.select("file_id", "path", "duration_ms"), "file_id", "left")
    part = lambda n: X.coalesce(X.col(n), 0) / X.col("requests")
    said = lambda n, code: X.concat(X.col(n), " of ", X.col("requests"), " requests (", percent(part(n)), f") returned {code}")
    return _rows(
        one, ("http-5xx", "critical", part("server") > 0.02, X.col("server"), said("server", "5xx")), ("http-4xx", "warning", part("client") > 0.1, X.col("client"), said("client", "4xx")),
        ("http-slowest-endpoint", "warning", X.col("duration_ms") >= 1000.0, X.lit(1), X.concat(X.col("path"), " took ", round_half_up(X.col("duration_ms")), "ms")),
    )


def latency_findings(latency: DataFrame, operations: DataFrame, http_latency: DataFrame, slowest: DataFrame) -> DataFrame:
    """At most six for each file, in the order: tail, outliers, the three slowest operations, coverage, slowest endpoint."""
    one = latency.join(http_latency.select("file_id", "requests", F.col("samples").alias("timed"), "coverage"), "file_id", "left").join(slowest.select("file_id", "path", "duration_ms"), "file_id", "left")
    c = X.col
    out = _rows(
        one, ("latency-p95", "warning", c("p95") > 1000.0, c("samples"), X.concat("median ", short_ms(c("p50")), ", p95 ", short_ms(c("p95")), ", p99 ", short_ms(c("p99")))),
        ("latency-outlier", "warning", (c("p95") > 0.0) & (c("max") > c("p95") * 4) & (c("max") > 1000.0), c("samples"), X.concat("slowest ", short_ms(c("max")), " against a p95 of ", short_ms(c("p95")))),
        ("latency-coverage", "info", (c("requests") >= 5) & (c("coverage") < 0.5), c("samples"), X.concat(c("timed"), " of ", c("requests"), " requests have a time")),
        ("latency-slowest-endpoint", "warning", c("duration_ms") > 1000.0, c("samples"), X.concat(c("path"), " took ", short_ms(c("duration_ms")))),
    )
    # Operations stand between the outliers (1) and the coverage (2).
    out = out.withColumn("order", F.when(F.col("order") < 2, F.col("order")).otherwise(F.col("order") + 10))
    slow = top(operations.where("samples >= 3").withColumnRenamed("place", "by_p95"), [F.asc("by_p95")], 3).where("p95 >= 1000")
    slow = slow.join(latency.select("file_id", F.col("samples").alias("all_samples")), "file_id").select(
        "file_id", F.concat(F.lit("latency-op-"), "name").alias("id"), F.when(F.col("p95") > 5000, "warning").otherwise("info").alias("severity"), F.col("all_samples").alias("occurrences"),
        F.concat(F.lit(SLOW_OPERATION[0] + ": "), "name").alias("title"), X.concat("p95 ", short_ms(c("p95")), " over ", c("samples"), " timings").alias("detail").column, (F.col("place") + 1).alias("order"),
    )
    return top(out.unionByName(slow), [F.asc("order")], MOST_LATENCY).drop("place")


def all_findings(t: dict[str, DataFrame]) -> DataFrame:
    """file_id, id, severity, occurrences, title, detail, advice, example, place: the most severe and frequent first."""
    said = rules.insights(t["issues"]).withColumn("order", F.col("place"))
    title = F.create_map(*(F.lit(x) for k, v in WORDS.items() for x in (k, v[0])))
    said = said.select("file_id", "id", "severity", "occurrences", F.try_element_at(title, F.col("id")).alias("title"), F.concat(F.lit("for example: "), "example").alias("detail"), "order", "example")
    none = F.lit(None).cast("string").alias("example")
    http = http_findings(t["http"], t["status_classes"], t["slowest"]).withColumn("order", F.col("order") + 100).select("*", none)
    late = latency_findings(t["latency"], t["operations"], t["http_latency"], t["slowest"]).withColumn("order", F.col("order") + 200).select("*", none)
    advice = F.create_map(*(F.lit(x) for k, v in WORDS.items() for x in (k, v[1])))
    out = said.unionByName(http).unionByName(late).withColumn("advice", F.coalesce(F.try_element_at(advice, F.col("id")), F.lit(SLOW_OPERATION[1])))
    weight = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return top(out.withColumn("w", weight), [F.desc("w"), F.desc("occurrences"), F.asc("order")], 1000).drop("w", "order")


def recommendations(issues: DataFrame, findings: DataFrame, levels: DataFrame) -> DataFrame:
    """file_id, place, kind, text: what to do first, at most eight for each file."""
    severe = F.col("level").isin("warn", "error", "fatal")
    noise = issues.where(~severe & (F.col("share") < 0.2)).groupBy("file_id").agg(F.count("*").alias("n")).where("n > 5")
    noise = noise.select("file_id", F.lit(0).alias("order"), F.lit("noise").alias("kind"), F.format_string("Lower the level of %d groups that only inform, so that problems stand out.", "n").alias("text"))
    worst = top(issues.where(severe).withColumnRenamed("place", "rank"), [F.asc("rank")], 3)
    text = X.concat('Start with "', X.col("title"), '": ', X.col("count"), " lines, ", percent(X.col("share")), " of the file.")
    worst = worst.select("file_id", (F.col("place") + 10).alias("order"), F.lit("issue").alias("kind"), text.alias("text").column)
    grave = top(findings.where("severity = 'critical'").withColumnRenamed("place", "rank"), [F.asc("rank")], 2)
    grave = grave.select("file_id", (F.col("place") + 20).alias("order"), F.lit("finding").alias("kind"), F.concat("title", F.lit(": "), "advice").alias("text"))
    burst = issues.where("last_seen - first_seen < 60000 and count > 20").groupBy("file_id").agg(F.count("*").alias("n"))
    burst = burst.select("file_id", F.lit(30).alias("order"), F.lit("burst").alias("kind"), F.format_string("%d groups came within one minute: see what changed just before.", "n").alias("text"))
    some = noise.union(worst).union(grave).union(burst)
    errors = levels.groupBy("file_id").agg(F.sum(F.when(F.col("level") == "error", F.col("count")).otherwise(0)).alias("errors"))
    rest = errors.join(some.select("file_id").distinct(), "file_id", "left_anti").select(
        "file_id", F.lit(40).alias("order"), F.lit("rest").alias("kind"),
        F.when(F.col("errors") > 0, "Log request ids and versions with each error, so that the next one is easier to place.").otherwise("No errors and no warnings. Watch how the volume grows.").alias("text"),
    )
    return top(some.union(rest), [F.asc("order")], MOST_RECOMMENDATIONS).select("file_id", "place", "kind", "text")


def throughput(counts: DataFrame, times: DataFrame) -> DataFrame:
    """file_id, per_second: entries for each second of the file's time range; null without one."""
    rate = F.when(F.col("duration_ms") > 0, F.col("parsed_lines") / (F.col("duration_ms") / 1000))
    return counts.join(times.select("file_id", "duration_ms"), "file_id", "left").select("file_id", rate.alias("per_second"))
