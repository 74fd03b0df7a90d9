"""Log lines made from the ``events`` table, the same in Spark SQL and DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL = "case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end"
STATUS = "case when event_id % 11 = 0 then 500 when event_id % 7 = 0 then 404 else 200 end"
METHOD = "case when event_id % 3 = 0 then 'POST' else 'GET' end"
MS = "cast(floor(value * 10 + 0.5) as bigint)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.selectExpr(
        "event_id", "user_id", "event_type", "value", "props", "unix_millis(cast(ts as timestamp)) as ts_ms",
        f"{LEVEL} as level", f"{STATUS} as status", f"{METHOD} as method", f"{MS} as ms",
    )


#: The same columns in DuckDB's SQL.
EVENTS_SQL = f"""
e as (select event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 as ts_ms, {LEVEL} as level, {STATUS} as status,
  {METHOD} as method, {MS} as ms from events)
"""


def _lines(df: DataFrame, raw: str) -> DataFrame:
    return df.select(F.lit("events.log").alias("file_id"), F.col("event_id").alias("line_no"), F.expr(raw).alias("raw"))


def write_logs(lines: DataFrame, folder: str, names: list[str]) -> None:
    """Writes lines(log, line_no, raw) as one file a log, in order, in a folder ``log=name`` of its own; one task a log, all at once."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("log")) - 1
    dealt = lines.repartitionById(len(names), place.cast("int")).sortWithinPartitions("log", "line_no")
    dealt.select("log", "raw").write.partitionBy("log").text(folder)


def log_name(file_id: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(file_id, "/"), -2), "^log=", "")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(events(spark, sf_dir), TEXT)


CLOCK = "date_format(timestamp_millis(ts_ms), 'yyyy-MM-dd HH:mm:ss,SSS')"
TEXT = (
    f"concat({CLOCK}, ' ', level, ' [w-', user_id % 8, '] app.', initcap(event_type), 'Svc - ', method, ' /api/users/', user_id, "
    "' -> ', status, ' (', ms, 'ms)')"
)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (
        "to_json(named_struct('timestamp', date_format(timestamp_millis(ts_ms), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), 'level', lower(level), "
        "'msg', concat('handled ', event_type, ' of user ', user_id), 'logger', concat('app.', event_type), 'status', status, "
        "'method', method, 'path', concat('/api/users/', user_id), 'durationMs', ms))"
    )
    return _lines(events(spark, sf_dir), raw)


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (
        "concat('10.0.0.', user_id % 250, ' - - [', date_format(timestamp_millis(ts_ms), 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"', method, "
        "' /api/users/', user_id, '?k=1 HTTP/1.1\" ', status, ' ', ms, ' \"-\" \"agent\"')"
    )
    return _lines(events(spark, sf_dir), raw)


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error event is an entry, an exception header and two frames; other events are entries."""
    head = f"concat({CLOCK}, ' ', level, ' app.', initcap(event_type), 'Svc - job ', event_id)"
    trace = (
        f"case when event_type = 'error' then array({head}, concat('Caused by: java.lang.IllegalStateException: bad k ', user_id % 5), "
        "concat('\\tat com.acme.Job', user_id % 3, '.run(Job.java:', 10 + user_id % 3, ')'), '\\tat com.acme.Main.main(Main.java:7)') "
        f"else array({head}) end"
    )
    df = events(spark, sf_dir).select("event_id", F.posexplode(F.expr(trace)).alias("k", "raw"))
    return df.select(F.lit("trace.log").alias("file_id"), (F.col("event_id") * 4 + F.col("k")).alias("line_no"), "raw")


#: Messages without volatile parts, each of which sets off a detector, a check or a rule of the directory.
TROUBLES = (
    "heap space is used up", "upstream call timed out", "connection refused by peer", "duplicate key in orders table", "segmentation fault in worker",
    "unhandled exception in handler", "undefined is not a function", "no space left on device", "permission denied for user", "too many requests from client",
    "retrying the upload", "tls handshake with peer broke off", "checksum mismatch in block", "legacy api will be removed", "slow answer from store",
    "full gc in old space", "waiting for lock on account", "circuit breaker is open", "liveness probe failed", "verbose logging is on",
    "cart was saved", "cache stampede on shelf", "consumer lag is high", "smtp relay is away", "job nightly did not run", "no module named cart",
    "circular import in boot", "field name is required", "shelf is out of stock", "unknown encoding in file", "log rotation is done", "address already in use",
)
TROUBLE = "array(" + ", ".join(f"'{t}'" for t in TROUBLES) + f")[event_id % {len(TROUBLES)}]"
TROUBLE_SQL = "[" + ", ".join(f"'{t}'" for t in TROUBLES) + f"][1 + event_id % {len(TROUBLES)}]"


def trouble_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(events(spark, sf_dir), f"concat({CLOCK}, ' ', level, ' app.core.Svc - ', {TROUBLE})")
    return lines.withColumn("file_id", F.lit("trouble.log"))


MONTH_DAY = "concat(date_format(timestamp_millis(ts_ms), 'MMM '), lpad(cast(day(timestamp_millis(ts_ms)) as string), 2, ' '), date_format(timestamp_millis(ts_ms), ' HH:mm:ss'))"


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard lines: time, host, process and its number."""
    return _lines(events(spark, sf_dir), f"concat({MONTH_DAY}, ' node', user_id % 3, ' app-', event_type, '[', user_id, ']: user ', user_id, ' was ', if(event_type = 'error', 'denied', 'served'))")


def clocked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in one of six layouts of time."""
    at = lambda layout: f"date_format(timestamp_millis(ts_ms), '{layout}')"
    ways = (
        f"concat({at('yyyy-MM-dd HH:mm:ss')}, '.', lpad(cast(ts_ms % 1000 as string), 3, '0'), '+00:00')", f"concat('[', {at('dd/MMM/yyyy:HH:mm:ss')}, ' +0000]')", MONTH_DAY,
        at("yyyy/MM/dd HH:mm:ss"), at("MM/dd/yyyy HH:mm:ss"), "concat('[', ts_ms, ']')",
    )
    case = " ".join(f"when {k} then {w}" for k, w in enumerate(ways))
    return _lines(events(spark, sf_dir), f"concat(case event_id % {len(ways)} {case} end, ' tick')")


#: (what stands before and behind the number, milliseconds of the unit or None: no number with a unit that makes a line timed).
SPANS = (("sync took ", " ms", 1), ("load finished in ", "s", 1000), ("step ", " (2h)", None), ("spent ", " minutes", 60000), ("wait (", " sec)", 1000), ("seen ", " of them", None))


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = " ".join(f"when {k} then concat('{a}', 1 + ms % 90, '{b}')" for k, (a, b, _) in enumerate(SPANS))
    return _lines(events(spark, sf_dir), f"concat({CLOCK}, ' INFO app.core.Svc - ', case event_id % {len(SPANS)} {case} end)")


#: Six files, told apart by user, that differ in severities, requests, timings, loggers and wording. The same in both SQLs.
CHECKED = {
    "f": "user_id % 6",
    "lvl": "case when event_type = 'error' then case when user_id % 6 = 0 then 'FATAL' when user_id % 6 = 4 then 'INFO' else 'ERROR' end when user_id % 6 = 1 then 'DEBUG' else 'INFO' end",
    "st": "case when user_id % 6 = 2 then null when user_id % 6 = 4 then 200 when event_id % 11 = 0 then 500 when event_id % 7 = 0 then 404 else 200 end",
    "dur": "case when user_id % 6 = 2 then null when user_id % 6 = 3 then cast(floor(value * 10 + 0.5) as bigint) * 20 + 1 else 1 + event_id % 90 end",
    "lg": "case when user_id % 6 = 5 then 'w-0' else concat('w-', user_id % 7) end",
}


def checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("*", *(F.expr(x).alias(n) for n, x in CHECKED.items()))
    said = "case when st is null then concat('job ', event_id, ' ended') else concat('GET /api/', if(f = 4, 'request_id', 'carts'), '/', user_id, ' -> ', st, ' (', dur, 'ms)') end"
    raw = f"concat({CLOCK}, ' ', lvl, ' [', lg, '] app.Cart - ', {said})"
    return df.select(F.concat(F.lit("f"), "f", F.lit(".log")).alias("file_id"), F.col("event_id").alias("line_no"), F.expr(raw).alias("raw"))


#: (a frame's line with its number put in, function, file) of each dialect.
DIALECTS = (
    ("\\tat com.acme.Job.run(Job.java:#)", "com.acme.Job.run", "Job.java"), ('  File "/srv/w.py", line #, in run', "run", "/srv/w.py"), ("    at load (/srv/app.js:#:5)", "load", "/srv/app.js"),
    ("    at /srv/app.js:#:5", None, "/srv/app.js"), ("   at Acme.Store.Load() in /src/Store.cs:line #", "Acme.Store.Load", "/src/Store.cs"), ("\\tfrom /srv/app.rb:#:in `run'", "run", "/srv/app.rb"),
    ("main.run(0x1f) /srv/main.go:#", "main.run", "/srv/main.go"),
)


def _chosen(texts: list[str | None], by: str) -> str:
    """A CASE over ``by``, the same in both SQLs; quotes are doubled."""
    quoted = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    return f"case {by} " + " ".join(f"when {k} then {quoted(x)}" for k, x in enumerate(texts)) + " end"


def framed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit(None)
    for k, (line, _, _) in enumerate(DIALECTS):
        text = F.when(F.col("event_id") % len(DIALECTS) == k, F.lit(line.replace("\\t", "\t"))).otherwise(text)
    df = events(spark, sf_dir).withColumn("raw", F.replace(text, F.lit("#"), (F.col("user_id") + 1).cast("string")))
    return df.select(F.lit("framed.log").alias("file_id"), F.col("event_id").alias("line_no"), "raw")


#: (a header's line with a word put in, type, whether the line goes on a trace).
HEADERS = (
    ("com.acme.StoreException: lost #", "com.acme.StoreException", False), ("KeyError: #", "KeyError", False), ("Caused by: java.io.IOException: no #", "java.io.IOException", True),
    ("Uncaught TypeError: # is not here", "TypeError", False), ("Suppressed: a.b.CloseFailure - #", "a.b.CloseFailure", True),
)


def headed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _chosen([h[0] for h in HEADERS], f"event_id % {len(HEADERS)}")
    return _lines(events(spark, sf_dir), f"replace({text}, '#', event_type)")


#: Types of exceptions, most of which a rule of the directory knows.
CAUSES = (
    "java.lang.NullPointerException", "java.lang.OutOfMemoryError", "java.net.SocketTimeoutException", "com.acme.StoreException", "ModuleNotFoundError", "RecursionError", "java.net.ConnectException",
    "UnicodeDecodeError",
)


def cause_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(events(spark, sf_dir), f"concat({_chosen(list(CAUSES), f'event_id % {len(CAUSES)}')}, ': lost ', event_type)")


#: (word, severity) of the words that stand for severities.
TOKENS = (
    ("FATAL", "fatal"), ("CRITICAL", "fatal"), ("CRIT", "fatal"), ("PANIC", "fatal"), ("EMERG", "fatal"), ("ALERT", "fatal"), ("ERROR", "error"), ("ERR", "error"), ("EXCEPTION", "error"),
    ("FAILURE", "error"), ("FAILED", "error"), ("FAIL", "error"), ("WARN", "warn"), ("WARNING", "warn"), ("NOTICE", "warn"), ("INFO", "info"), ("LOG", "info"), ("DEBUG", "debug"), ("DBG", "debug"),
    ("TRACE", "trace"), ("VERBOSE", "trace"), ("FINE", "trace"), ("FINER", "trace"), ("FINEST", "trace"),
)


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(events(spark, sf_dir), f"concat('[', {_chosen([t for t, _ in TOKENS], f'event_id % {len(TOKENS)}')}, '] step ', event_id)")


def lone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error event is an entry, a frame with a line of code, and a header of its own line, which takes the frame over."""
    head = f"concat({CLOCK}, ' ', level, ' app.', initcap(event_type), 'Svc - job broke')"
    trace = (
        f"case when event_type = 'error' then array({head}, concat('  File \"/srv/w', user_id % 2, '.py\", line ', 41 + user_id % 3, ', in run'), '    value = table[key]', "
        f"concat('KeyError: k', user_id % 4)) else array({head}) end"
    )
    df = events(spark, sf_dir).select("event_id", F.posexplode(F.expr(trace)).alias("k", "raw"))
    return df.select(F.lit("lone.log").alias("file_id"), (F.col("event_id") * 4 + F.col("k")).alias("line_no"), "raw")


#: Lines of RFC 5424, of no layout, and with a thread, which the layouts' parsers leave to the text parser or read themselves.
SHAPES = ("plain words and number #", "WARN 12 - [main] pool of # is low", "level=error logger=store.Cart text # broke", "<34>1 2024-03-02T08:00:00Z host app - - - user # left")


def shaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(events(spark, sf_dir), f"replace({_chosen(list(SHAPES), f'event_id % {len(SHAPES)}')}, '#', user_id)")
