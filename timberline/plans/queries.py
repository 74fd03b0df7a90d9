"""Registered queries over derived logs, with the same answers in DuckDB's SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.levels import infer_level
from timberline.functions.normalize import REPLACEMENTS, normalize_message
from timberline.functions.sqltext import X
from timberline.functions.text import normalize_path
from timberline.operators import aggregate as A
from timberline.operators.parse import parse_lines
from timberline.operators.stitch import stitch
from timberline.plans import derived as D
from timberline.plans import directory, findings, rules, views
from timberline.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from timberline.sources.shared import pin

def _parsed(spark: SparkSession, sf_dir: str, kind: str, requests: bool = True) -> DataFrame:
    """Typed and stitched lines of a derived log; ``requests`` says whether requests in free lines are of use."""
    # The table is small on disk but its lines are costly to parse: deal them over all cores.
    cores = spark.sparkContext.defaultParallelism
    traces = {"trace": D.trace_lines, "lone": D.lone_lines}
    if kind in traces:
        return stitch(parse_lines(traces[kind](spark, sf_dir).repartition(cores, "line_no"), layout="text", requests=requests, signatures=False))
    makers = {
        "text": D.text_lines, "json": D.json_lines, "apache": D.access_lines, "syslog": D.syslog_lines, "trouble": D.trouble_lines, "clocked": D.clocked_lines, "timed": D.timed_lines,
        "checked": D.checked_lines, "framed": D.framed_lines, "headed": D.headed_lines, "caused": D.cause_lines, "tokens": D.token_lines, "shaped": D.shaped_lines,
    }
    lines = makers[kind](spark, sf_dir).repartition(cores, "line_no")
    layout = kind if kind in ("json", "apache", "syslog") else "text"
    # None of these lines continues another, so each is an entry.
    return parse_lines(lines, layout=layout, syslog_strict=True, requests=requests, signatures=False).withColumn("role", F.lit("entry")).withColumn("entry_id", F.col("line_no"))


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "text")


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of which no request is of use."""
    return _parsed(spark, sf_dir, "text", requests=False)


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "apache")


@query(
    """with {e}, n as (select level, count(*) as c from e group by level),
    l(level) as (values ('fatal'), ('error'), ('warn'), ('info'), ('debug'), ('trace'), ('unknown'))
    select lower(l.level) as level, cast(coalesce(n.c, 0) as bigint) as count from l left join n on lower(n.level) = l.level"""
)
def level_histogram(spark, sf_dir):
    return A.level_counts(_plain(spark, sf_dir)).select("level", "count")


@query(
    """with {e}, n as (select count(*) as parsed, count(*) filter (level = 'ERROR') as er, count(*) filter (level = 'WARN') as wa from e)
    select cast(parsed as bigint) as parsed, round(er / parsed, 6) as error_rate,
      cast(greatest(0, least(100, floor(100 - least(65.0, er / parsed * 420) - least(20.0, wa / parsed * 120) + 0.5))) as bigint) as health_score from n"""
)
def health_score(spark, sf_dir):
    return A.health(A.level_counts(_plain(spark, sf_dir))).select("parsed", F.round("error_rate", 6).alias("error_rate"), "health_score")


@query(
    """with {e} select event_id as line_no, lower(level) as level, ts_ms, 'w-' || (user_id % 8) as logger, method, '/api/users/:id' as path,
      cast(status as integer) as status, cast(ms as double) as duration_ms from e"""
)
def parse_text_lines(spark, sf_dir):
    p = _text(spark, sf_dir)
    return p.select("line_no", "level", "ts_ms", "logger", F.col("http.method").alias("method"), F.col("http.path").alias("path"), F.col("http.status").alias("status"), F.col("http.duration_ms").alias("duration_ms"))


@query(
    """with {e} select event_id as line_no, lower(level) as level, ts_ms, 'app.' || event_type as logger,
      'handled ' || event_type || ' of user ' || user_id as message, method, cast(status as integer) as status, cast(ms as double) as duration_ms from e"""
)
def parse_json_lines(spark, sf_dir):
    p = _parsed(spark, sf_dir, "json")
    return p.select("line_no", "level", "ts_ms", "logger", "message", F.col("http.method").alias("method"), F.col("http.status").alias("status"), F.col("http.duration_ms").alias("duration_ms"))


@query(
    """with {e} select event_id as line_no, case when status >= 500 then 'error' when status >= 400 then 'warn' else 'info' end as level,
      ts_ms // 1000 * 1000 as ts_ms, method || ' /api/users/:id ' || status as message, '10.0.0.' || (user_id % 250) as ip, cast(ms as bigint) as bytes from e"""
)
def parse_access_lines(spark, sf_dir):
    p = _access(spark, sf_dir)
    return p.select("line_no", "level", "ts_ms", "message", F.col("http.ip").alias("ip"), F.col("http.bytes").alias("bytes"))


@query("""select 'json' as format, cast(1.0 as double) as confidence union all select 'apache', 1.0 union all select 'text', 1.0""")
def detect_layouts(spark, sf_dir):
    from timberline.sources.lines import detect_format

    parts = [f(spark, sf_dir).withColumn("file_id", F.lit(n)) for n, f in (("a", D.json_lines), ("b", D.access_lines), ("c", D.text_lines))]
    return detect_format(parts[0].union(parts[1]).union(parts[2])).select("format", "confidence")


@query("""with {e} select cast(status as integer) as status, count(*) as count, count(*) filter (status >= 500) as errors from e group by status""")
def status_stats(spark, sf_dir):
    return A.status_stats(_access(spark, sf_dir)).select("status", "count", "errors")


@query("""with {e} select (status // 100) || 'xx' as class, count(*) as count from e group by 1""")
def status_classes(spark, sf_dir):
    return A.status_classes(_access(spark, sf_dir)).select("class", "count")


@query(
    """with {e} select '/api/users/:id' as path, count(*) as count, count(*) filter (status >= 500) as errors, round(sum(ms) / count(*), 6) as avg_ms,
    cast(max(ms) as double) as max_ms from e"""
)
def path_stats(spark, sf_dir):
    return A.path_stats(_text(spark, sf_dir)).select("path", "count", "errors", F.round("avg_ms", 6).alias("avg_ms"), "max_ms")


@query("""with {e} select '/api/users/:id' as path, cast(ms as double) as duration_ms, event_id as line_no from e order by ms desc, event_id limit 1""")
def slowest_request(spark, sf_dir):
    return A.slowest_request(_text(spark, sf_dir)).select("path", "duration_ms", "line_no")


@query("""with {e} select count(*) as requests, count(*) filter (status >= 500) as errors, round(count(*) filter (status >= 500) / count(*), 6) as error_rate from e""")
def http_totals(spark, sf_dir):
    return A.http_totals(_text(spark, sf_dir)).select("requests", "errors", F.round("error_rate", 6).alias("error_rate"))


_RANKED = "cast(list_sort(list(ms))[cast(floor({q} * (count(*) - 1) + 0.5) as int) + 1] as double)"


@query(
    "with {e} select count(*) as samples, round(avg(ms), 6) as avg, cast(max(ms) as double) as max, count(*) filter (ms > 1000) as over_budget, "
    "count(*) filter (ms > 5000) as severe, " + ", ".join(f"{_RANKED.format(q=q / 100)} as p{q}" for q in (50, 90, 95, 99)) + " from e"
)
def latency_overall(spark, sf_dir):
    out = A.latency_overall(pin(A.durations(_text(spark, sf_dir))))
    return out.select("samples", F.round("avg", 6).alias("avg"), "max", "over_budget", "severe", "p50", "p90", "p95", "p99")


@query(
    "with {e} select 'handled ' || event_type || ' of user n' as name, count(*) as samples, " + ", ".join(f"{_RANKED.format(q=q / 100)} as p{q}" for q in (50, 95)) + " from e group by 1"
)
def latency_by_operation(spark, sf_dir):
    p = _parsed(spark, sf_dir, "json")
    # Timed by operation here, not by path.
    p = p.withColumn("http", F.struct(F.lit(None).cast("string").alias("path"), F.col("http.duration_ms").alias("duration_ms")))
    return A.latency_by_operation(pin(A.durations(p))).select("name", "samples", "p50", "p95")


@query(
    """with {e}, s as (select min(ts_ms) as lo, max(ts_ms) as hi from e),
    z as (select lo, hi, coalesce((select min(b) from unnest([1000,5000,10000,30000,60000,300000,600000,900000,1800000,3600000,10800000,21600000,43200000,86400000,604800000]) t(b)
      where (hi - lo) / b <= 48), 604800000) as size from s),
    w as (select *, lo // size * size as t0, least(ceil((hi - lo // size * size) / size) + 1, 500) as n from z),
    d as (select t0 + k * size as t, k, size, t0, n from w, range(0, 500) r(k) where k < n),
    h as (select least((ts_ms - t0) // size, n - 1) as k, level from e, w)
    select cast(d.t as bigint) as t, count(h.level) as total, count(*) filter (h.level = 'ERROR') as error, count(*) filter (h.level = 'WARN') as warn,
      count(*) filter (h.level = 'INFO') as info from d left join h on h.k = d.k group by d.t"""
)
def timeline(spark, sf_dir):
    return A.timeline(_plain(spark, sf_dir)).select("t", "total", "error", "warn", "info")


@query(
    """with {e}, o as (select ts_ms, lag(ts_ms) over (order by event_id) as b from e)
    select min(ts_ms) as start_ms, max(ts_ms) as end_ms, max(ts_ms) - min(ts_ms) as duration_ms, coalesce(bool_or(ts_ms < b), false) as out_of_order from o"""
)
def time_range(spark, sf_dir):
    return A.time_range(_plain(spark, sf_dir)).select("start_ms", "end_ms", "duration_ms", "out_of_order")


@query(
    """with {e} select 'w-' || (user_id % 8) as logger, count(*) as total, count(*) filter (level = 'ERROR') as errors, count(*) filter (level = 'WARN') as warnings
    from e group by 1"""
)
def logger_stats(spark, sf_dir):
    return A.logger_stats(_plain(spark, sf_dir)).select("logger", "total", "errors", "warnings")


@query(
    """with {e} select count(*) filter (event_type = 'error') * 3 + count(*) as line_count, count(*) as parsed_lines,
    count(*) filter (event_type = 'error') * 3 as continuation_lines, count(*) filter (event_type = 'error') as multi_line_entries from e"""
)
def stitch_traces(spark, sf_dir):
    lines = _parsed(spark, sf_dir, "trace", requests=False)
    return A.line_counts(lines).select("line_count", "parsed_lines", "continuation_lines", "multi_line_entries")


@query("""with {e} select 'java.lang.IllegalStateException' as type, count(*) as count from e where event_type = 'error'""")
def exception_counts(spark, sf_dir):
    return A.exception_counts(_parsed(spark, sf_dir, "trace", requests=False)).select("type", "count")


@query(
    """with {e}, x as (select 'Job.java:' || (10 + user_id % 3) as location from e where event_type = 'error' union all select 'Main.java:7' from e where event_type = 'error')
    select location, count(*) as count from x group by 1"""
)
def source_refs(spark, sf_dir):
    return A.source_counts(_parsed(spark, sf_dir, "trace", requests=False)).select("location", "count")


@query(
    """with {e}, g as (select lower(level) as level, 'w-' || (user_id % 8) as logger,
      'app.' || upper(event_type[1]) || event_type[2:] || 'Svc - ' || method || ' /api/users/<n> -> <n> (<duration>)' as pattern, event_id from e)
    select level, pattern, logger, count(*) as count, min(event_id) as first_line, max(event_id) as last_line from g group by 1, 2, 3
"""
)
def issue_groups(spark, sf_dir):
    g = A.issues(pin(_plain(spark, sf_dir)), most=1000)
    return g.select("level", "pattern", F.col("loggers")[0].alias("logger"), "count", "first_line", "last_line")


@query(
    """with {e}, s as (select event_id, lower(level) as level, row_number() over (order by event_id) as k,
      level in ('ERROR', 'WARN') or status = 500 as notable from e),
    t as (select *, sum(case when notable and k > 200 then 1 else 0 end) over (order by event_id) as m from s)
    select event_id as line_no, level from t where k <= 200 or (notable and m <= 1800)"""
)
def sample_retention(spark, sf_dir):
    return A.sample_lines(pin(_text(spark, sf_dir).select("file_id", "line_no", "raw", "role", "level", "http"))).select("line_no", "level")


@query(
    r"""with h as (select page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as p from pages),
    s as (select page_id, list_transform(string_split(p, '/'), lambda x: case when regexp_full_match(x, '[0-9]+') then ':id'
      when regexp_matches(x, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-') then ':uuid' when regexp_full_match(x, '(?i)[0-9a-f]{16,}') then ':hash'
      when length(x) > 24 and regexp_matches(x, '[0-9]') then ':id' else x end) as q from h)
    select page_id, array_to_string(q, '/') as path from s"""
)
def normalized_paths(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", normalize_path(X.regexp_extract(X.col("url"), r"://[^/?#]*([^#]*)", 1)).alias("path").column)


@query(
    """select conv_id, turn, case when regexp_matches(lower(text), 'exception|traceback|stack trace|fatal|panic:|segmentation fault|assertionerror|assertion failed|failed|failure|cannot |unable to|refused|denied|not found|timed out|timeout|out of memory|crash|invalid|expected ') then 'error'
      when regexp_matches(lower(text), 'warn|deprecated|deprecation|retry|slow|approaching|fallback|falling back|soft ') then 'warn'
      when regexp_matches(lower(text), 'debug|trace|verbose') then 'debug' else 'info' end as level from conversations"""
)
def inferred_levels(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", infer_level(X.coalesce(X.col("text"), "")).alias("level").column)


def _talk(spark: SparkSession, sf_dir: str, titled: bool = False) -> DataFrame:
    """Issue-shaped groups of conversation turns with equal text, for the wording rules.

    Rules look at a group's pattern, title and sample in a row, where a match may begin in one and end in the next; only
    ``titled`` groups have the text as their title and sample, too.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    # Few bytes but many patterns for each text: the groups are dealt over all cores.
    g = turns.groupBy("text").agg(F.count("*").alias("count")).repartition(4 * spark.sparkContext.defaultParallelism, "text")
    samples = F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.col("text").alias("raw")))
    return g.select(
        F.lit("talk").alias("file_id"), F.col("text").alias("pattern"), (F.col("text") if titled else F.lit(None).cast("string")).alias("title"), F.lit(None).cast("string").alias("exception_type"), "count",
        (samples if titled else F.slice(samples, 1, 0)).alias("samples"), F.xxhash64("text").alias("place"),
    )


def _sql_rules(rows: tuple) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(r[0])}, {quoted(r[1])}, {quoted('(?i)' + r[-1])})" for r in rows)


@query(
    f"""with r(id, severity, p) as (values {_sql_rules(rules.DETECTORS)}), t as (select text, count(*) as c from conversations where text is not null group by text)
    select id, severity, cast(sum(c) as bigint) as occurrences from r join t on regexp_matches(text, p) group by 1, 2"""
)
def insight_detectors(spark, sf_dir):
    return rules.insights(_talk(spark, sf_dir)).select("id", "severity", "occurrences")


@query(
    f"""with r(id, "group", p) as (values {_sql_rules(rules.SCANS)}), t as (select text, count(*) as c from conversations where text is not null group by text)
    select id, "group", cast(coalesce(sum(c), 0) as bigint) as lines, count(c) as groups from r left join t on regexp_matches(text, p) group by 1, 2"""
)
def wording_checks(spark, sf_dir):
    return rules.scans(_talk(spark, sf_dir)).select("id", "group", "lines", "groups")


_GROUPS = (
    "m as (select event_id, lower(level) as level, " + D.TROUBLE_SQL + " as text, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S,%g') || ' ' || level || ' app.core.Svc - ' || "
    + D.TROUBLE_SQL + " as raw from e), g as (select level, text, count(*) as c, list(raw order by event_id)[1:3] as samples from m group by 1, 2)"
)


def _troubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pin(A.issues(pin(_parsed(spark, sf_dir, "trouble", requests=False)), most=1000))


@query(
    "with {e}, " + _GROUPS + f", r(id, severity, p) as (values {_sql_rules(rules.DETECTORS)}) "
    "select id, severity, cast(sum(c) as bigint) as occurrences from r join g on regexp_matches(text || ' ' || text || ' ', p) group by 1, 2"
)
def trouble_detectors(spark, sf_dir):
    return rules.insights(_troubles(spark, sf_dir)).select("id", "severity", "occurrences")


@query(
    "with {e}, " + _GROUPS + f""", r(id, "group", p) as (values {_sql_rules(rules.SCANS)})
    select id, "group", cast(coalesce(sum(c), 0) as bigint) as lines, count(c) as groups
    from r left join g on regexp_matches(text || ' ' || text || '  ' || samples[1], p) group by 1, 2"""
)
def trouble_checks(spark, sf_dir):
    return rules.scans(_troubles(spark, sf_dir)).select("id", "group", "lines", "groups")


_RULES_SQL = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (r[0], r[1], r[2], r[3], " ".join(r[4]), directory.alternation(r))) + ")" for r in directory.RULES)


@query(
    "with {e}, " + _GROUPS + f""", r(id, category, severity, title, languages, p) as (values {_RULES_SQL})
    select id, category, severity, cast(sum(c) as bigint) as occurrences, count(*) as issues from r join g
    on regexp_matches(lower(text || ' ' || text || '  trouble.log'), p) or regexp_matches(lower(array_to_string(samples, ' ')), p) group by 1, 2, 3"""
)
def known_problems(spark, sf_dir):
    none = spark.createDataFrame([], "file_id string, type string, count long, first_line long")
    return directory.known_problems(_troubles(spark, sf_dir), none).select("id", "category", "severity", "occurrences", F.size("issue_ids").cast("long").alias("issues"))


@query(
    f"""with r(id, category, severity, title, languages, p) as (values {_RULES_SQL}), t as (select text, count(*) as c from conversations where text is not null group by text)
    select id, cast(sum(c) as bigint) as occurrences from r join t on regexp_matches(lower(text || ' ' || text || '  talk'), p) or regexp_matches(lower(text), p) group by 1"""
)
def known_problems_in_talk(spark, sf_dir):
    none = spark.createDataFrame([], "file_id string, type string, count long, first_line long")
    talk = _talk(spark, sf_dir, titled=True).withColumn("signature", F.col("place").cast("string"))
    return directory.known_problems(talk, none).select("id", "occurrences")


_MET_SQL = """, met as (select id, cast(sum(c) as bigint) as occurrences from r join g
    on regexp_matches(lower(text || ' ' || text || '  trouble.log'), p) or regexp_matches(lower(array_to_string(samples, ' ')), p) group by 1)"""


def _met(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "file_id string, type string, count long, first_line long")
    return directory.known_problems(_troubles(spark, sf_dir), none).select("id", "occurrences")


@query(
    "with {e}, " + _GROUPS + f", r(id, category, severity, title, languages, p) as (values {_RULES_SQL})" + _MET_SQL
    + " select category, count(*) as count, count(met.id) as met, cast(coalesce(sum(occurrences), 0) as bigint) as lines from r left join met using (id) group by 1"
)
def category_counts(spark, sf_dir):
    """For each category of the directory: its entries, how many of them a log meets, and lines."""
    both = directory.rules_table(spark).join(_met(spark, sf_dir).withColumn("hit", F.lit(1)), "id", "left")
    counts = directory.category_counts(both)
    return counts.join(both.groupBy("category").agg(F.count("hit").alias("met"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("lines")), "category")


_ADVICE_SQL = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (k, *v)) + ")" for k, v in directory.ADVICE.items())


@query(
    "with {e}, " + _GROUPS + f", r(id, category, severity, title, languages, p) as (values {_RULES_SQL}), a(id, why, fix) as (values {_ADVICE_SQL})" + _MET_SQL
    + """, t as (select *, lower(title || chr(10) || why || chr(10) || fix || chr(10) || languages) as said from r join a using (id))
    select id, title, occurrences from t join met using (id) where contains(said, 'lock') or (severity = 'warning' and contains(said, 'limit'))"""
)
def directory_search(spark, sf_dir):
    """Entries that a log meets and that a search of the directory finds."""
    rules_ = directory.rules_table(spark)
    found = directory.search(rules_, "LOCK").union(directory.search(rules_, "limit", severity="warning")).select("id", "title").distinct()
    return found.join(_met(spark, sf_dir), "id")


_LATE = "s as (select count(*) as n, count(*) filter (status >= 500) as c5, count(*) filter (status between 400 and 499) as c4, max(ms) as hi, " + f"{_RANKED.format(q=0.95)} as p95 from e)"


@query(
    "with {e}, " + _LATE + """, f(id, severity, yes, occurrences) as (
      select 'http-5xx', 'critical', c5 / n > 0.02, c5 from s union all select 'http-4xx', 'warning', c4 / n > 0.1, c4 from s union all
      select 'http-slowest-endpoint', 'warning', hi >= 1000, 1 from s union all select 'latency-p95', 'warning', p95 > 1000, n from s union all
      select 'latency-outlier', 'warning', hi > 4 * p95 and hi > 1000, n from s union all
      select 'latency-op-/api/users/:id', case when p95 > 5000 then 'warning' else 'info' end, p95 >= 1000, n from s union all
      select 'latency-slowest-endpoint', 'warning', hi > 1000, n from s)
    select id, severity, cast(occurrences as bigint) as occurrences from f where yes"""
)
def computed_findings(spark, sf_dir):
    lines = pin(_text(spark, sf_dir))
    timed = pin(A.durations(lines))
    http, slowest = A.http_totals(lines), A.slowest_request(lines)
    found = findings.http_findings(http, A.status_classes(lines), slowest)
    late = findings.latency_findings(A.latency_overall(timed), A.latency_by_operation(timed), A.http_latency(lines), slowest)
    return found.unionByName(late).select("id", "severity", "occurrences")


@query("with {e} select round(count(*) / ((max(ts_ms) - min(ts_ms)) / 1000), 6) as per_second from e")
def throughput(spark, sf_dir):
    lines = pin(_plain(spark, sf_dir).select("file_id", "line_no", "role", "entry_id", "level", "frame", "ts_ms"))
    return findings.throughput(A.line_counts(lines), A.time_range(lines)).select(F.round("per_second", 6).alias("per_second"))


@query("with {e}, n as (select lower(level) as level, count(*) as count from e group by 1) select level, count, round(count / sum(count) over (), 6) as share from n")
def severity_slices(spark, sf_dir):
    return views.severity_slices(A.level_counts(_plain(spark, sf_dir))).select("level", "count", F.round("share", 6).alias("share"))


@query(
    "with {e} select event_id as line_no, 'app-' || event_type as logger, case when event_type = 'error' then 'error' else 'info' end as level, ts_ms // 1000 * 1000 as ts_ms, "
    "'user ' || user_id || ' was ' || case when event_type = 'error' then 'denied' else 'served' end as message from e"
)
def parse_syslog_lines(spark, sf_dir):
    return _parsed(spark, sf_dir, "syslog").select("line_no", "logger", "level", "ts_ms", "message")


@query("with {e} select event_id as line_no, case when event_id % 6 in (0, 5) then ts_ms else ts_ms // 1000 * 1000 end as ts_ms, 'tick' as message from e")
def time_layouts(spark, sf_dir):
    return _parsed(spark, sf_dir, "clocked").select("line_no", "ts_ms", "message")


_SPANS_SQL = " ".join(f"when {k} then " + (f"(1 + ms % 90) * {x}" if x else "null") for k, (_, _, x) in enumerate(D.SPANS))


@query("with {e}, d as (select event_id, case event_id % 6 " + _SPANS_SQL + " end as ms from e) select event_id as line_no, cast(ms as double) as ms from d where ms is not null")
def message_durations(spark, sf_dir):
    return A.durations(_parsed(spark, sf_dir, "timed")).select("line_no", "ms")


def _sql_normalized(column: str) -> str:
    out = column
    for pattern, put, _ in REPLACEMENTS:
        quoted = lambda x: "'" + x.replace("'", "''") + "'"
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(put.replace('$', chr(92)))}, 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("select doc_id, " + _sql_normalized("coalesce(text, '')") + " as pattern from documents")
def normalized_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", normalize_message(X.coalesce(X.col("text"), "")).alias("pattern").column)


@query(f"select page_id, {_sql_normalized('url')} as pattern from pages")
def normalized_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", normalize_message(X.coalesce(X.col("url"), "")).alias("pattern").column)


@query(
    """with {e}, u as (select 'u' || (user_id % 40) as name, event_id as saved_at, 'r' || event_id as id from e),
    l as (select *, row_number() over (partition by name order by saved_at desc) as k from u) select id, name, saved_at from l where k = 1 order by saved_at desc limit 30"""
)
def history_upsert(spark, sf_dir):
    from timberline.operators import history

    rows = D.events(spark, sf_dir).selectExpr("concat('r', event_id) as id", "concat('u', user_id % 40) as name", "event_id as saved_at")
    return history.upsert(rows.where("saved_at % 2 = 0"), rows.where("saved_at % 2 = 1"))


_FILES_SQL = """with {e}, w as (select count(*) as n, count(*) filter (level = 'ERROR') as er, count(*) filter (status >= 500) as c5, count(*) filter (event_type = 'error') as t from e)
    select 'text' as layout, 'text' as format, n as line_count, n as parsed, er as errors, n as requests from w union all select 'json', 'json', n, n, er, n from w union all
    select 'apache', 'apache', n, n, c5, n from w union all select 'syslog', 'syslog', n, n, er, 0 from w union all
    select 'trace', 'text', n + 3 * t, n, er, 0 from w"""


@query(_FILES_SQL)
def triage_files(spark, sf_dir):
    """The whole path from files of five layouts to a report's figures."""
    from timberline.plans import report
    from timberline.sources.shared import shared_dir

    folder = f"{shared_dir(spark)}/timberline/{uuid.uuid4().hex}"
    makers = {"text": D.text_lines, "json": D.json_lines, "apache": D.access_lines, "syslog": D.syslog_lines, "trace": D.trace_lines}
    logs = [make(spark, sf_dir).select(F.lit(name).alias("log"), "line_no", "raw") for name, make in makers.items()]
    D.write_logs(reduce(DataFrame.union, logs), folder, list(makers))
    t = report.triage(spark, [f"{folder}/log={name}" for name in makers], syslog_strict=True)
    levels = t["levels"].groupBy("file_id").agg(F.sum("count").alias("parsed"), F.sum(F.when(F.col("level").isin("error", "fatal"), F.col("count")).otherwise(0)).alias("errors"))
    out = t["formats"].join(levels, "file_id").join(t["counts"].select("file_id", "line_count"), "file_id").join(t["http"].select("file_id", "requests"), "file_id", "left")
    return out.select(D.log_name(F.col("file_id")).alias("layout"), "format", "line_count", "parsed", "errors", F.coalesce("requests", F.lit(0)).alias("requests"))


from timberline.plans import report_queries, view_queries  # noqa: E402, F401  (registers their queries)
