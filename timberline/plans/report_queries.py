"""Registered queries over reports: checks, documents, texts, history, streams, dialects, with their SQL."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.operators import aggregate as A
from timberline.operators import history
from timberline.plans import checks, documents, findings, report, rules, views
from timberline.plans import derived as D
from timberline.plans.queries import _RANKED, _parsed, _plain, _text
from timberline.plans.registry import query
from timberline.sources.shared import pin, shared_dir

_CHECKED_SQL = "k as (select *, " + ", ".join(f"{x} as {n}" for n, x in D.CHECKED.items()) + " from e)"
_SHORT = "case when {0} >= 60000 then printf('%.1fm', {0} / 60000.0) when {0} >= 1000 then printf('%.2fs', {0} / 1000.0) else cast(floor({0} + 0.5) as bigint) || 'ms' end"
_PCT = "printf('%.{1}f%%', {0} * 100)"
_N = "format('{{:,}}', {0})"
_RANK_OF = lambda q: f"list_sort(list(dur) filter (dur is not null))[cast(floor({q} * (count(dur) - 1) + 0.5) as int) + 1]"


def _checks_sql() -> str:
    pct, short, n = (lambda x, d=1: _PCT.format(x, d)), _SHORT.format, _N.format
    budget = f"'p95 ' || {short('p95')} || ', median ' || {short('p50')} || ', p99 ' || {short('p99')} || ', most ' || {short('hi')} || ', ' || {n('timed')} || ' timings'"
    rows = {
        "fatal-lines": [("fatal > 0", "fail", f"{n('fatal')} || ' fatal lines'"), ("true", "pass", "'no fatal line'")],
        "error-rate": [
            ("er > 0.05", "fail", f"{pct('er', 2)} || ' of the lines are errors'"), ("er > 0.01", "warn", f"{pct('er', 2)} || ' of the lines are errors (' || {n('errs')} || ')'"), ("true", "pass", f"{pct('er', 2)} || ' of the lines are errors'"),
        ],
        "latency-p95": [("timed = 0", "unknown", "'no timings'"), ("p95 > 1000", "warn", budget), ("true", "pass", budget)],
        "latency-outliers": [
            ("timed < 5", "unknown", "'fewer than 5 timings'"), ("hi > greatest(1000, 4 * p95)", "warn", f"'most ' || {short('hi')} || ' against p95 ' || {short('p95')} || '; ' || {n('severe')} || ' over 5 s'"),
            ("true", "pass", f"'most ' || {short('hi')} || ' against p95 ' || {short('p95')}"),
        ],
        "latency-over-budget": [("timed = 0", "unknown", "'no timings'"), ("over > 0", "warn", f"{n('over')} || ' of ' || {n('timed')} || ' timings (' || {pct('over / timed')} || ') over 1 s'"), ("true", "pass", "'no timing over 1 s'")],
        "http-latency-coverage": [("asked < 3", "unknown", "'fewer than 3 requests'"), ("true", "pass", f"'100% of the requests have a time, p95 ' || {short('p95')}")],
        "http-5xx": [("asked < 3", "unknown", "'fewer than 3 requests'"), *((c, s, f"{n('c5')} || ' of ' || {n('asked')} || ' requests (' || {pct('c5 / asked', 2)} || ')'") for c, s in (("c5 / asked > 0.05", "fail"), ("c5 > 0", "warn"), ("true", "pass")))],
        "http-4xx": [("asked < 3", "unknown", "'fewer than 3 requests'"), *((c, s, f"{n('c4')} || ' of ' || {n('asked')} || ' requests (' || {pct('c4 / asked', 2)} || ')'") for c, s in (("c4 / asked > 0.1", "warn"), ("true", "pass")))],
        "timestamps": [("back", "warn", "'times go back'"), ("true", "pass", f"'times span ' || {short('span')}")],
        "malformed-lines": [("true", "pass", "'0% of the entries have no level'")],
        "log-noise": [("noise > 0.4", "warn", f"{pct('noise', 0)} || ' of the entries are debug or trace'"), ("true", "pass", f"{pct('noise', 0)} || ' of the entries are debug or trace'")],
        "correlation-id": [("n < 200", "unknown", "'fewer than 200 entries'"), ("f <> 4", "warn", "'no request or trace id'"), ("true", "pass", f"{n('n')} || ' lines hold a request or trace id'")],
        "structure": [("true", "warn", "'free text, fields are guessed'")],
        "error-context": [("grave = 0", "pass", "'no error groups'"), ("true", "warn", "'none of ' || grave || ' error groups has a type or frames'")],
    }
    one = lambda ways, k: "case " + " ".join(f"when {w[0]} then " + (f"'{w[1]}'" if k == 1 else w[2]) for w in ways) + " end"
    each = " union all ".join(f"select file, '{name}' as id, {one(ways, 1)} as status, {one(ways, 2)} as detail from a" for name, ways in rows.items())
    # A group of errors is told by logger and by wording: requests differ in method-free wording by nothing, jobs likewise.
    return (
        "with {e}, " + _CHECKED_SQL + ", o as (select *, lag(ts_ms) over (partition by f order by event_id) as b from k), a as (select 'f' || f || '.log' as file, f, count(*) as n, count(*) filter (lvl = 'FATAL') as fatal, "
        "count(*) filter (lvl in ('FATAL', 'ERROR')) as errs, errs / n as er, count(*) filter (lvl = 'DEBUG') / n as noise, count(st) as asked, count(*) filter (st = 500) as c5, count(*) filter (st = 404) as c4, "
        "count(dur) as timed, max(dur) as hi, count(*) filter (dur > 1000) as over, count(*) filter (dur > 5000) as severe, "
        + ", ".join(f"{_RANK_OF(q / 100)} as p{q}" for q in (50, 95, 99))
        + ", coalesce(bool_or(ts_ms < b), false) as back, max(ts_ms) - min(ts_ms) as span, count(distinct lg) filter (lvl in ('FATAL', 'ERROR')) as grave from o group by f) "
        f"select file, id, status, detail from ({each})"
    )


def _tables(spark: SparkSession, lines: DataFrame) -> dict[str, DataFrame]:
    lines = pin(lines)  # first, since the files' names alone would parse all lines again
    formats = lines.select("file_id").distinct().select("file_id", F.lit("text").alias("format"), F.lit(1.0).alias("confidence"))
    return report.report_of(lines, pin(formats), 1000)


@query(_checks_sql())
def measured_checks(spark, sf_dir):
    """Status and detail of measured checks in files that differ in what they set off."""
    t = _tables(spark, _parsed(spark, sf_dir, "checked"))
    shown = [k for k in checks.ORDER if f"'{k}' as id" in _checks_sql()]
    return checks.measured(t).where(F.col("id").isin(shown)).select(F.col("file_id").alias("file"), "id", "status", "detail")


_BUCKETS_SQL = """with {e}, s as (select min(ts_ms) as lo, max(ts_ms) as hi from e),
    z as (select lo, hi, coalesce((select min(b) from unnest([1000,5000,10000,30000,60000,300000,600000,900000,1800000,3600000,10800000,21600000,43200000,86400000,604800000]) t(b)
      where (hi - lo) / b <= 48), 604800000) as size from s),
    w as (select *, lo // size * size as t0, least(ceil((hi - lo // size * size) / size) + 1, 500) as n from z),
    d as (select k, n from w, range(0, 500) r(k) where k < n),
    h as (select least((ts_ms - t0) // size, n - 1) as k, level from e, w),
    b as (select d.k, count(h.level) as total, count(*) filter (h.level = 'ERROR') as error from d left join h on h.k = d.k group by d.k),
    c as (select *, row_number() over (partition by total > 0 order by k desc) as back from b)
    select count(*) as buckets, count(*) filter (total > 0) as filled, max(total) as peak, median(total) as typical, median(total) filter (total > 0) as typical_filled,
      round(max(error / total) filter (total > 0), 6) as peak_errors, round(median(error / total) filter (total > 0), 6) as typical_errors, round(avg(total) filter (total > 0 and back <= 3), 6) as tail from c"""


@query(_BUCKETS_SQL)
def timeline_facts(spark, sf_dir):
    f = checks.timeline_facts(A.timeline(_text(spark, sf_dir)))
    rounded = ("peak_errors", "typical_errors", "tail")
    return f.select("buckets", "filled", "peak", "typical", "typical_filled", *(F.round(c, 6).alias(c) for c in rounded))


_DIALECT_SQL = (
    "with {e} select event_id as line_no, " + D._chosen([d[1] for d in D.DIALECTS], f"event_id % {len(D.DIALECTS)}") + ' as "function", ' + D._chosen([d[2] for d in D.DIALECTS], f"event_id % {len(D.DIALECTS)}")
    + " as file, cast(user_id + 1 as integer) as line from e"
)


@query(_DIALECT_SQL)
def frame_dialects(spark, sf_dir):
    p = _parsed(spark, sf_dir, "framed")
    return p.where("continuation").select("line_no", F.col("frame.function").alias("function"), F.col("frame.file").alias("file"), F.col("frame.line").alias("line"))


@query(
    "with {e} select event_id as line_no, " + D._chosen([h[1] for h in D.HEADERS], f"event_id % {len(D.HEADERS)}") + " as type, "
    + f"case event_id % {len(D.HEADERS)} " + " ".join(f"when {k} then {str(h[2]).lower()}" for k, h in enumerate(D.HEADERS)) + " end as continuation from e"
)
def exception_headers(spark, sf_dir):
    return _parsed(spark, sf_dir, "headed").select("line_no", F.col("exc.type").alias("type"), "continuation")


@query("with {e} select event_id as line_no, " + D._chosen([x for _, x in D.TOKENS], f"event_id % {len(D.TOKENS)}") + " as level, 'step ' || event_id as message from e")
def level_words(spark, sf_dir):
    return _parsed(spark, sf_dir, "tokens").select("line_no", "level", "message")


@query(
    """with {e} select event_id as line_no, case event_id % 4 when 1 then 'warn' when 2 then 'error' else 'info' end as level, case event_id % 4 when 2 then 'store.Cart' end as logger,
    case event_id % 4 when 1 then 'main' end as thread, case event_id % 4 when 3 then 1709366400000 else 0 end as ts_ms from e"""
)
def free_shapes(spark, sf_dir):
    """Lines without a layout of their own, among them RFC 5424, which the text parser reads."""
    return _parsed(spark, sf_dir, "shaped").select("line_no", "level", "logger", "thread", F.coalesce("ts_ms", F.lit(0).cast("long")).alias("ts_ms"))


def _fnv_sql(x: str) -> str:
    step = f"list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split({x}, ''), lambda c: unicode(c)::hugeint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
    digits = "'0123456789abcdefghijklmnopqrstuvwxyz'"
    return f"ltrim(array_to_string(list_transform(range(6, -1, -1), lambda k: {digits}[cast(({step}) // cast(power(36, k) as hugeint) % 36 as int) + 1]), ''), '0')"


@query(
    "with {e}, g as (select lower(level) || '|w-' || (user_id % 8) || '|app.' || upper(event_type[1]) || event_type[2:] || 'Svc - ' || method || ' /api/users/<n> -> <n> (<duration>)' as said, count(*) as count from e group by 1) "
    f"select {_fnv_sql('said')} as signature, count from g"
)
def fingerprints(spark, sf_dir):
    """FNV-1a of severity, logger and normalised message, in base 36."""
    return A.issues(pin(_plain(spark, sf_dir)), most=1000).select("signature", "count")


@query(
    """with {e}, x as (select event_id, user_id from e where event_type = 'error'), f as (select '/srv/w' || (user_id % 2) || '.py:' || (41 + user_id % 3) as location from x)
    select location, 2 * count(*) as count from f group by 1"""
)
def inherited_sources(spark, sf_dir):
    """Frames that a header on its own line takes over from the entry before count again."""
    return A.source_counts(_parsed(spark, sf_dir, "lone", requests=False)).select("location", "count")


@query(
    """with {e}, x as (select *, row_number() over (partition by user_id % 4 order by event_id) as k from e where event_type = 'error')
    select 'KeyError: k' || (user_id % 4) as title, 'KeyError' as exception_type, count(*) as count, list('/srv/w' || (user_id % 2) || '.py:' || (41 + user_id % 3) order by event_id)[1] as top_frame,
      min(event_id * 4 + 3) as first_line from x group by user_id % 4"""
)
def inherited_frames(spark, sf_dir):
    g = A.issues(_parsed(spark, sf_dir, "lone", requests=False), most=1000).where("exception_type = 'KeyError'")
    place = F.concat_ws(":", F.get("frames", F.lit(0))["file"], F.get("frames", F.lit(0))["line"])
    return g.select("title", "exception_type", "count", place.alias("top_frame"), "first_line")


@query(
    """with {e}, g as (select event_type, lower(level) as level, count(*) as count, min(event_id) as low, max(event_id) as high, arg_min(ts_ms, event_id) as first_seen, arg_max(ts_ms, event_id) as last_seen from e group by 1, 2)
    select level, case when event_type = 'error' then 'java.lang.IllegalStateException: ' else '' end || 'job ' || low as title, case when event_type = 'error' then 'java.lang.IllegalStateException' end as exception_type,
      count, round(count / sum(count) over (), 6) as share, low * 4 as first_line, high * 4 as last_line, first_seen, last_seen, case when event_type = 'error' then least(24, 2 * count) else 0 end as frames,
      least(3, count) as samples from g"""
)
def trace_issues(spark, sf_dir):
    """Titles that a cause rewrites, frames that gather over occurrences, shares, times and samples of issue groups."""
    g = A.issues(_parsed(spark, sf_dir, "trace", requests=False), most=1000)
    sizes = (F.size(c).cast("long").alias(c) for c in ("frames", "samples"))
    return g.select("level", "title", "exception_type", "count", F.round("share", 6).alias("share"), "first_line", "last_line", "first_seen", "last_seen", *sizes)


_SEVERE = "case severity when 'critical' then 3 when 'warning' then 2 else 1 end"


@query(
    "with {e}, s as (select count(*) as n, count(*) filter (status >= 500) as c5, count(*) filter (status between 400 and 499) as c4, max(ms) as hi, " + f"{_RANKED.format(q=0.95)} as p95 from e)" + """,
    f(id, severity, yes, occurrences, o) as (
      select 'http-5xx', 'critical', c5 / n > 0.02, c5, 1 from s union all select 'http-4xx', 'warning', c4 / n > 0.1, c4, 2 from s union all
      select 'http-slowest-endpoint', 'warning', hi >= 1000, 1, 3 from s union all select 'latency-p95', 'warning', p95 > 1000, n, 4 from s union all
      select 'latency-outlier', 'warning', hi > 4 * p95 and hi > 1000, n, 5 from s union all
      select 'latency-op-/api/users/:id', case when p95 > 5000 then 'warning' else 'info' end, p95 >= 1000, n, 6 from s union all
      select 'latency-slowest-endpoint', 'warning', hi > 1000, n, 7 from s)
    select id, cast(row_number() over (order by """ + _SEVERE + " desc, occurrences desc, o) as integer) as place from f where yes"
)
def ranked_findings(spark, sf_dir):
    """The computed findings of a log by severity and lines, as they stand among all findings."""
    found = findings.all_findings(_tables(spark, _text(spark, sf_dir))).where(~F.col("id").isin(*(d[0] for d in rules.DETECTORS)))
    return found.select("id", F.row_number().over(W.partitionBy("file_id").orderBy("place")).alias("place"))


@query(
    """with {e}, s as (select event_id, lower(level) as level, row_number() over (order by event_id) as k, level in ('ERROR', 'WARN') or status = 500 as notable, method from e),
    t as (select *, sum(case when notable and k > 200 then 1 else 0 end) over (order by event_id) as m from s), v as (select * from t where k <= 200 or (notable and m <= 1800))
    select event_id as line_no, level from v where level = 'error' and method = 'POST' order by event_id limit 300"""
)
def raw_viewer(spark, sf_dir):
    samples = A.sample_lines(pin(_text(spark, sf_dir).select("file_id", "line_no", "raw", "role", "level", "http")))
    return history.search_lines(samples, "post /API", "error").select("line_no", "level")


@query(
    """with {e}, n as (select lower(level) as level, count(*) as c from e group by 1), k as (select (status // 100) || 'xx' as class, count(*) as c from e group by 1),
    h as (select cast(greatest(0, least(100, floor(100 - least(65.0, count(*) filter (level = 'ERROR') / count(*) * 420) - least(20.0, count(*) filter (level = 'WARN') / count(*) * 120) + 0.5))) as bigint) as s from e),
    l as (select 'w-' || (user_id % 8) as logger, count(*) as total, count(*) filter (level = 'ERROR') as errors from e group by 1)
    select 'class ' || class as what, case class when '5xx' then 'error' when '4xx' then 'warn' else 'info' end as shown, c as value from k union all
    select 'health', case when s >= 75 then 'good' when s >= 50 then 'fair' else 'poor' end, s from h union all
    select 'logger ' || logger, 'bar', case when errors > 0 then errors else total end from l"""
)
def shown_values(spark, sf_dir):
    """What a report's view shows: the tone of the health score, colours of classes and the bars of loggers."""
    lines = pin(_text(spark, sf_dir))
    classes = A.status_classes(lines).select(F.concat(F.lit("class "), "class").alias("what"), views.class_level(F.col("class")).alias("shown"), F.col("count").alias("value"))
    health = A.health(A.level_counts(lines)).select(F.lit("health").alias("what"), views.health_tone(F.col("health_score")).alias("shown"), F.col("health_score").alias("value"))
    bars = A.logger_stats(lines).select(F.concat(F.lit("logger "), "logger").alias("what"), F.lit("bar").alias("shown"), views.shown_value(F.col("errors"), F.col("total")).alias("value"))
    return classes.union(health).union(bars)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of four files, told apart by user."""
    folder = f"{shared_dir(spark)}/timberline/{uuid.uuid4().hex}"
    lines = D.events(spark, sf_dir).select(F.concat(F.lit("f"), F.col("user_id") % 4, F.lit(".log")).alias("log"), F.col("event_id").alias("line_no"), F.expr(D.TEXT).alias("raw"))
    D.write_logs(lines, folder, [f"f{k}.log" for k in range(4)])
    return pin(report.reports(spark, [f"{folder}/log=f{k}.log" for k in range(4)], at_ms=0))


@query(
    """with {e} select 'f' || (user_id % 4) || '.log' as name, count(*) as line_count, count(*) filter (level = 'ERROR') as errors, count(*) filter (level = 'WARN') as warnings, count(*) as requests,
      count(*) filter (status >= 500) as failed, min(ts_ms) as start_ms, max(ts_ms) as end_ms, cast(max(ms) as double) as slowest, """
    + f"{_RANKED.format(q=0.95)} as p95, " + """cast(53 as bigint) as checks, least(count(*), 200 + least(1800, greatest(0, count(*) - 200))) >= 0 as fine,
      format('{:,}', count(*)) || ' lines, ' || format('{:,}', count(*) filter (level = 'ERROR')) || ' errors (' || printf('%.2f%%', count(*) filter (level = 'ERROR') / count(*) * 100) || ')' as said
    from e group by user_id % 4"""
)
def report_documents(spark, sf_dir):
    """From files to one document and one summary for each: what the documents hold."""
    docs = _documents(spark, sf_dir)
    said = documents.texts(docs, ("summary",)).select("file_id", F.regexp_extract("text", r"\n([^\n]*?\)), [0-9,]+ warnings", 1).alias("said"))
    r = F.col("report")
    return docs.join(said, "file_id").select(
        D.log_name(F.col("file_id")).alias("name"), r["lineCount"].alias("line_count"), r["levels"]["error"].alias("errors"), r["levels"]["warn"].alias("warnings"), r["http"]["total"].alias("requests"),
        F.aggregate(r["http"]["statuses"], F.lit(0).cast("long"), lambda a, s: a + s["errors"]).alias("failed"), r["timeRange"]["start"].alias("start_ms"), r["timeRange"]["end"].alias("end_ms"),
        r["http"]["slowest"]["durationMs"].alias("slowest"), r["latency"]["p95"].alias("p95"), F.size(r["checks"]).cast("long").alias("checks"), (F.size(r["samples"]) == r["sampledLines"]).alias("fine"), "said",
    )


_STORED_SQL = """with {e}, u as (select 'u' || (user_id % 40) as name, event_id as saved_at, 'r' || event_id as id, ms from e),
    l as (select *, row_number() over (partition by name order by saved_at desc) as k from u), n as (select id, name, saved_at, ms from l where k = 1 order by saved_at desc limit 30),
    d as (select *, struct_pack(samples := list_transform(range(1 + ms % 90), lambda k: struct_pack("index" := k, raw := repeat('x', cast(1 + ms % 250 as int)))),
      issues := list_transform(range(1 + ms % 30), lambda k: struct_pack(id := k, samples := [struct_pack("index" := k, raw := 'y')], frames := list_transform(range(7), lambda j: struct_pack(line := j, raw := 'at f'))))) as report from n),
    t as (select *, struct_pack(samples := report.samples[:0], issues := list_transform(report.issues[1:20], lambda i: struct_pack(id := i.id, samples := i.samples[:0], frames := i.frames[1:5]))) as tight from d),
    w as (select *, octet_length(encode(to_json(report)::varchar)) as w, octet_length(encode(to_json(tight)::varchar)) as t from t),
    c as (select *, sum(w) over (order by saved_at desc, id desc) as upto from w), g as (select *, upto <= 60000 as fits, coalesce(max(case when upto <= 60000 then upto end) over (), 0) as taken from c),
    m as (select *, taken + sum(case when fits then 0 else t end) over (order by saved_at desc, id desc) as more from g)
    select id, name, case when fits then 'whole' else 'tight' end as form, cast(case when fits then w else t end as bigint) as bytes from m where fits or more <= 60000"""


@query(_STORED_SQL)
def history_quota(spark, sf_dir):
    """Which of the latest entries a store of 60,000 bytes holds whole, which without samples, which not."""
    rows = D.events(spark, sf_dir).selectExpr("concat('r', event_id) as id", "concat('u', user_id % 40) as name", "event_id as saved_at", "ms")
    latest = history.upsert(rows.where("saved_at % 2 = 0"), rows.where("saved_at % 2 = 1"))
    made = (
        "named_struct('samples', transform(sequence(0L, ms % 90), k -> named_struct('index', k, 'raw', repeat('x', cast(1 + ms % 250 as int)))), 'issues', transform(sequence(0L, ms % 30), "
        "k -> named_struct('id', k, 'samples', array(named_struct('index', k, 'raw', 'y')), 'frames', transform(sequence(0, 6), j -> named_struct('line', j, 'raw', 'at f')))))"
    )
    stored = latest.select("id", "name", "saved_at", F.lit("whole").alias("form"), F.expr(made).alias("report"))
    out = history.fitted(stored, 60_000)
    return out.select("id", "name", "form", history.stored_bytes(F.col("report")).alias("bytes"))


@contextmanager
def _streaming(spark: SparkSession, sf_dir: str):
    """A folder with a log under ``in``, and the state store that states need while it is read as a stream."""
    from timberline.streaming.stitch import STATE_STORE

    folder = f"{shared_dir(spark)}/timberline/{uuid.uuid4().hex}"
    D.trace_lines(spark, sf_dir).repartitionByRange(1, "line_no").sortWithinPartitions("line_no").select("raw").write.text(f"{folder}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield folder
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@query(
    """with {e} select 'entry' as role, count(*) as lines, count(*) as entries from e union all
    select 'continuation', 3 * count(*) filter (event_type = 'error'), count(*) filter (event_type = 'error') from e"""
)
def streamed_traces(spark, sf_dir):
    """A log read as a stream and stitched by state."""
    from timberline.streaming import stitch as S

    with _streaming(spark, sf_dir) as folder:
        rows = S.stitched_lines(S.stitched(S.located_lines(spark, f"{folder}/in"), "text", for_issues=False)).select("file_id", "line_no", "role", "entry_id")
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("role").agg(F.count("*").alias("lines"), F.countDistinct("entry_id").alias("entries"))


@query(
    """with {e}, g as (select event_type, lower(level) as level, count(*) as count, min(event_id) as low, arg_min(ts_ms, event_id) as first_seen, arg_max(ts_ms, event_id) as last_seen from e group by 1, 2)
    select level, case when event_type = 'error' then 'java.lang.IllegalStateException: ' else '' end || 'job ' || low as title, case when event_type = 'error' then 'java.lang.IllegalStateException' end as exception_type,
      count, round(count / sum(count) over (), 6) as share, first_seen, last_seen, case when event_type = 'error' then least(24, 2 * count) else 0 end as frames, least(3, count) as samples from g"""
)
def streamed_issues(spark, sf_dir):
    """Issue groups of a log read as a stream, from the table of their changes."""
    from timberline.streaming import stitch as S

    with _streaming(spark, sf_dir) as folder:
        changes = S.issue_changes(S.stitched(S.located_lines(spark, f"{folder}/in"), "text", for_lines=False))
        S.keep_issues(changes, f"{folder}/issues", f"{folder}/at").awaitTermination()
    g = S.issues_of(S.issue_table(spark, f"{folder}/issues"), most=1000)
    sizes = (F.size(c).cast("long").alias(c) for c in ("frames", "samples"))
    return g.select("level", "title", "exception_type", "count", F.round("share", 6).alias("share"), "first_seen", "last_seen", *sizes)
