"""Registered queries over what a report shows: formats, scales, lists of checks, texts, order of work, windows of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions import text as T
from timberline.functions.sqltext import X
from timberline.functions.stack import compact_frames, frame_owner
from timberline.operators import aggregate as A
from timberline.plans import checks, directory, documents, findings, views
from timberline.plans import derived as D
from timberline.plans.queries import _GROUPS, _RANKED, _RULES_SQL, _parsed, _text, _troubles
from timberline.plans.registry import ORACLES, query
from timberline.plans.report_queries import _documents, _tables
from timberline.sources.shared import pin, shared_dir

# Lengths and sizes from milliseconds to hours and from bytes to terabytes; none lies in the middle between two shown figures.
SPAN, SIZE = "(12 * (ms * ms % 2000003) + 4)", "(1 + 2 * (ms * ms * ms * (event_id % 5) * (user_id % 3)))"
_HALF_UP = "cast(floor({0} + 0.5) as bigint)"


def _bytes_sql(n: str, units: tuple[str, ...]) -> str:
    out = f"else {n} || ' B' end"
    for k, unit in enumerate(units, 1):
        v = f"({n} / {1024.0**k})"
        out = f"when {n} >= {1024**k} then printf(case when {v} >= 10 then '%.0f' else '%.1f' end, {v}) || ' {unit}' {out}"
    return f"case {out}"


@query(
    f"""with {{e}}, x as (select *, cast({SPAN} as bigint) as span, cast({SIZE} as bigint) as size from e), y as (select *, span / 1000 as s, span // 60000 as m from x)
    select event_id, case when span < 1000 then span || 'ms' when s < 10 then printf('%.2fs', s) when s < 60 then printf('%.1fs', s)
        when m < 60 then m || 'm ' || {_HALF_UP.format('(s % 60)')} || 's' else m // 60 || 'h ' || m % 60 || 'm' end as duration,
      case when span < 1000 then span || 'ms' when s < 60 then printf('%.1fs', s) when s < 3600 then {_HALF_UP.format('(s / 60)')} || 'm' else printf('%.1fh', span / 3600000) end as shown_span,
      {_bytes_sql('size', ('KB', 'MB', 'GB', 'TB'))} as bytes, {_bytes_sql('size', ('KB', 'MB', 'GB'))} as shown_size,
      strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g UTC') as stamp, strftime(make_timestamp(ts_ms * 1000), '%b %-d %H:%M:%S') as day_time,
      strftime(make_timestamp(ts_ms * 1000), '%H:%M:%S') as day_clock from y"""
)
def formatted_figures(spark, sf_dir):
    """Durations, sizes and times of every event in the forms that reports and views show."""
    df = D.events(spark, sf_dir).selectExpr("event_id", f"{SPAN} as span", f"{SIZE} as size", "ts_ms")
    span, size, at = X.col("span"), X.col("size"), X.col("ts_ms")
    shown = {
        "duration": T.format_duration(span), "shown_span": T.view_span(span), "bytes": T.format_bytes(size), "shown_size": T.view_size(size), "stamp": T.stamp(at),
        "day_time": T.format_time(at), "day_clock": T.format_time(at, with_date=False),
    }
    return df.select("event_id", *(x.alias(name).column for name, x in shown.items()))


@query(
    "with {e}, f as (select " + D._chosen([d[1] for d in D.DIALECTS], f"event_id % {len(D.DIALECTS)}") + ' as fn, ' + D._chosen([d[2] for d in D.DIALECTS], f"event_id % {len(D.DIALECTS)}") + """ as file, ms from e)
    select case when fn is null then file when contains(fn, '.') then regexp_replace(fn, '[.][^.]*$', '') else fn end as owner, count(*) as lines,
      cast(sum(case when 1 + ms % 90 > 40 then 18 else 1 + ms % 90 end) as bigint) as kept,
      cast(sum(case when 1 + ms % 90 > 40 then 78 + 6 * (1 + ms % 90) - 15 else (1 + ms % 90) * (2 + ms % 90) // 2 end) as bigint) as numbers from f group by 1"""
)
def frame_owners(spark, sf_dir):
    """Who frames belong to, and which frames of a long trace are shown: the first 12 and the last 6."""
    p = _parsed(spark, sf_dir, "framed").where("continuation").select("frame", "line_no")
    p = p.join(D.events(spark, sf_dir).select(F.col("event_id").alias("line_no"), "ms"), "line_no")
    shown = compact_frames(X.sequence(1, X.lit(1) + X.col("ms") % 90))
    p = p.select(frame_owner(X.col("frame")).alias("owner").column, shown.alias("shown").column)
    return p.groupBy("owner").agg(F.count("*").alias("lines"), F.sum(F.size("shown")).alias("kept"), F.sum(F.aggregate("shown", F.lit(0).cast("long"), lambda a, x: a + x)).alias("numbers"))


@query(
    "with {e}, " + "k as (select *, " + ", ".join(f"{x} as {n}" for n, x in D.CHECKED.items()) + " from e), t as (select f, case when event_id % 3 = 0 then null else dur end as ms, st from k where st is not null) "
    "select 'f' || f || '.log' as file, count(*) as requests, count(ms) as samples, round(count(ms) / count(*), 6) as coverage, cast(max(ms) as double) as max, "
    + ", ".join(f"cast(list_sort(list(ms) filter (ms is not null))[cast(floor({q} * (count(ms) - 1) + 0.5) as int) + 1] as double) as p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + " from t group by f"
)
def http_latency_block(spark, sf_dir):
    """Requests, of which a third has no response time, and the percentiles of the others, by file."""
    lines = _parsed(spark, sf_dir, "checked")
    untimed = F.struct(*(F.col(f"http.{c}").alias(c) if c != "duration_ms" else F.when(F.col("line_no") % 3 != 0, F.col("http.duration_ms")).alias(c) for c in ("method", "path", "status", "bytes", "ip", "referer", "user_agent", "duration_ms")))
    lines = lines.withColumn("http", F.when(F.col("http").isNotNull(), untimed))
    return A.http_latency(pin(lines.select("file_id", "line_no", "raw", "role", "http", "message"))).select(F.col("file_id").alias("file"), "requests", "samples", F.round("coverage", 6).alias("coverage"), "max", "p50", "p95", "p99")


@query(
    "select file, status as what, count(*) as checks from (" + ORACLES["measured_checks"] + ") group by 1, 2 union all "
    "select file, 'open: ' || id, 1 from (" + ORACLES["measured_checks"] + ") where status in ('warn', 'fail')"
)
def check_lists(spark, sf_dir):
    """How many measured checks have which status, and which of them are open, by file."""
    from timberline.plans.report_queries import _checks_sql

    t = _tables(spark, _parsed(spark, sf_dir, "checked"))
    found = pin(checks.measured(t).where(F.col("id").isin([k for k in checks.ORDER if f"'{k}' as id" in _checks_sql()])).select("file_id", "id", "status"))
    counts = views.check_counts(found).select(F.col("file_id").alias("file"), F.col("status").alias("what"), F.col("count").alias("checks"))
    return counts.union(views.open_checks(found).select("file_id", F.concat(F.lit("open: "), "id"), F.lit(1).cast("long")))


_WEIGHT = "case severity when 'critical' then 3 when 'warning' then 2 else 1 end"


@query(
    "with {e}, h as (select event_id, " + D._chosen(list(D.CAUSES), f"event_id % {len(D.CAUSES)}") + f" as type, event_type from e), r(id, category, severity, title, languages, p) as (values {_RULES_SQL}), "
    f"g as (select type || ': lost ' || event_type as raw from h where event_id % {len(D.CAUSES)} = 1 group by 1), met as (select distinct id from r join g on regexp_matches(lower(raw || '  events.log'), p)), "
    "t as (select type, count(*) as c, min(event_id) as low from h group by 1) "
    "select id, category, severity, arg_min(c, low) as occurrences, arg_min(type, low) as type from r join t on regexp_matches(lower(type), p) where id not in (select id from met) group by 1, 2, 3"
)
def known_by_exception(spark, sf_dir):
    """Problems that no issue meets but the type of an exception does; the first type in the file counts."""
    lines = pin(_parsed(spark, sf_dir, "caused"))
    issues = A.issues(lines.where(F.col("line_no") % len(D.CAUSES) == 1), most=1000)
    problems = directory.known_problems(pin(issues), A.exception_counts(lines))
    return problems.where(F.size("issue_ids") == 0).select("id", "category", "severity", "occurrences", F.col("example").alias("type"))


@query(
    "with {e}, " + _GROUPS + f""", r(id, category, severity, title, languages, p) as (values {_RULES_SQL}), o as (select *, row_number() over () as rule from r),
    hit as (select o.*, g.level, g.text, g.c from o join g on regexp_matches(lower(text || ' ' || text || '  trouble.log'), p) or regexp_matches(lower(array_to_string(samples, ' ')), p)),
    w as (select id, {_WEIGHT} as w, sum(c) as occurrences, min(rule) as rule from hit group by 1, 2), k as (select id, row_number() over (order by w desc, occurrences desc, rule) as place from w),
    last as (select level, text, arg_max(hit.category || ': ' || hit.title, place) as label from hit join k using (id) group by 1, 2)
    select label, count(*) as issues, cast((select sum(occurrences) from w) as bigint) as problem_lines from last group by 1"""
)
def directory_labels(spark, sf_dir):
    """The directory's entries by which issues are shown, and the lines of all known problems together."""
    none = spark.createDataFrame([], "file_id string, type string, count long, first_line long")
    problems = pin(directory.known_problems(_troubles(spark, sf_dir), none))
    labels = directory.issue_labels(problems).groupBy("file_id", "label").agg(F.count("*").alias("issues"))
    return labels.join(views.problem_lines(problems), "file_id").select("label", "issues", F.col("lines").alias("problem_lines"))


@query(
    "with {e}, o as (select 'handled ' || event_type || ' of user n' as name, " + _RANKED.format(q=0.95) + " as p95 from e group by 1) "
    "select name, round(p95 / greatest(max(p95) over (), 1), 6) as scale, greatest(max(p95) over (), 1.0) as worst from o"
)
def latency_bars(spark, sf_dir):
    """Bars of operations: their 95th percentile over the worst one's."""
    p = _parsed(spark, sf_dir, "json")
    p = p.withColumn("http", F.struct(F.lit(None).cast("string").alias("path"), F.col("http.duration_ms").alias("duration_ms")))
    ops = pin(A.latency_by_operation(pin(A.durations(p))))
    return views.scaled(ops, "p95").join(views.worst_p95(ops), "file_id").select("name", F.round("scale", 6).alias("scale"), "worst")


@query(
    """with {e}, g as (select level, user_id % 8 as w, event_type, method, count(*) as c, min(event_id) as low,
        arg_min('app.' || upper(event_type[1]) || event_type[2:] || 'Svc - ' || method || ' /api/users/' || user_id || ' -> ' || status || ' (' || ms || 'ms)', event_id) as title from e group by 1, 2, 3, 4),
    n as (select sum(c) as n, count(*) filter (level = 'INFO' and c < 0.2 * (select count(*) from e)) as noise from g),
    s as (select *, row_number() over (order by case level when 'ERROR' then 5 else 4 end desc, c desc, lower(title), low) as k from g where level in ('ERROR', 'WARN'))
    select k as place, 'issue' as kind, 'Start with "' || title || '": ' || c || ' lines, ' || printf('%.1f%%', c / n * 100) || ' of the file.' as text from s, n where k <= 3 """
    f"""union all select 0, 'noise', 'Lower the level of ' || noise || ' groups that only inform, so that problems stand out.' from n where noise > 5
    union all select 4, 'finding', '{findings.WORDS["http-5xx"][0].replace("'", "''")}: {findings.WORDS["http-5xx"][1].replace("'", "''")}' from (select count(*) filter (status >= 500) as c5, count(*) as n from e) where c5 / n > 0.02"""
)
def order_of_work(spark, sf_dir):
    """What to do first: what is noise, the worst issues, the gravest findings."""
    lines = pin(_text(spark, sf_dir))
    issues, levels = pin(A.issues(lines, most=1000)), pin(A.level_counts(lines))
    http = findings.http_findings(A.http_totals(lines), A.status_classes(lines), A.slowest_request(lines))
    words = F.create_map(*(F.lit(x) for k, v in findings.WORDS.items() for x in (k, v[1])))
    ranked = http.withColumn("advice", F.try_element_at(words, F.col("id"))).withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy(F.desc(F.expr("severity = 'critical'")), F.asc("order"))))
    # Noise comes first, where there is any, and takes place 0 here.
    out = findings.recommendations(issues, ranked, levels)
    noisy = F.max((F.col("kind") == "noise").cast("int")).over(W.partitionBy("file_id"))
    return out.withColumn("noisy", noisy).select((F.col("place") - F.col("noisy")).cast("long").alias("place"), "kind", "text")


@query(
    """with {e}, f as (select 'f' || (user_id % 4) as file, count(*) as n, count(*) filter (level = 'ERROR') as er from e group by 1),
    k(kind, ending) as (values ('json', 'report.json'), ('csv', 'issues.csv'), ('markdown', 'report.md'), ('html', 'report.html'), ('summary', 'summary.txt'))
    select file, kind, ending, n as lines, er as errors from f, k"""
)
def report_texts(spark, sf_dir):
    """What each text of a report says of its file's lines and errors; of the CSV, the sums over its issues."""
    docs = _documents(spark, sf_dir)
    number = lambda pattern: F.replace(F.regexp_extract("text", pattern, 1), F.lit(","), F.lit("")).cast("long")
    pick = lambda ways: F.coalesce(*(F.when(F.col("kind") == k, x) for k, x in ways.items()))
    rows = F.filter(F.split("text", "\n"), lambda x, k: (k > 0) & (x != ""))
    summed = lambda keep: F.aggregate(F.filter(rows, keep), F.lit(0).cast("long"), lambda a, x: a + F.split(x, ",")[1].cast("long"))
    lines = {
        "json": number(r'"lineCount" : (\d+)'), "csv": summed(lambda x: F.lit(True)), "markdown": number(r"\| Lines \| ([\d,]+) \|"), "html": number(r"<td>Lines</td><td>([\d,]+)</td>"),
        "summary": number(r"\n([\d,]+) lines, "),
    }
    errors = {
        "json": number(r'"error" : (\d+)'), "csv": summed(lambda x: x.startswith("Error,")), "markdown": number(r"\| Errors and fatal \| ([\d,]+) \("), "html": number(r"<td>Errors and fatal</td><td>([\d,]+) \("),
        "summary": number(r" lines, ([\d,]+) errors"),
    }
    out = documents.texts(docs).withColumn("file", D.log_name(F.col("file_id")))
    return out.select(F.regexp_replace("file", r"\.log$", "").alias("file"), "kind", F.regexp_extract("name", r"([a-z]+\.[a-z]+)$", 1).alias("ending"), pick(lines).alias("lines"), pick(errors).alias("errors"))


@query("""with {e} select ts_ms // 3600000 * 3600000 as start_ms, lower(level) as level, count(*) as count from e group by 1, 2""")
def streamed_windows(spark, sf_dir):
    """Severities in hourly windows of a log read as a stream; each batch updates the windows that it meets."""
    from timberline.streaming.triage import stream_lines, windowed_levels

    folder = f"{shared_dir(spark)}/timberline/{uuid.uuid4().hex}"
    D.text_lines(spark, sf_dir).select("raw").write.text(f"{folder}/in")
    counts = windowed_levels(stream_lines(spark, f"{folder}/in"), "text", "1 hour")
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}")
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{folder}/out").groupBy("start", "level").agg(F.max_by("count", "batch").alias("count"))
    return done.select(F.unix_millis("start").alias("start_ms"), "level", "count")
