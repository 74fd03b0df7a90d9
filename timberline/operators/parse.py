"""One typed row for each line of a log.

A line is parsed in a few stages, each a generator, so that a filter or a projection on the rows never copies the parser's
expressions; every pattern runs once a line and every intermediate is bound once. The layout decides first which parser a
line meets.

Defined results: a null line is an empty one; so is a line of blanks. Rows stand for themselves, so repeated lines and ties
need no rule. Unit separators (U+001F) in a line count as blanks. No lines give no rows. Columns beside ``file_id``,
``line_no`` and ``raw`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.durations import request_line
from timberline.functions.levels import detect_level, infer_level, level_of_number, level_of_status
from timberline.functions.normalize import normalize_message, signature_of, signed_text
from timberline.functions.stack import FRAME_TYPE, exception_header, is_continuation, stack_frame
from timberline.functions.sqltext import Sql, X
from timberline.functions.text import any_of, clean, cut, groups, holds, normalize_path, part, strip, utc_text, without_lead
from timberline.functions.timestamps import extract_timestamp

# Layouts of access and syslog lines.
ACCESS_LINE = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([A-Z]+) (\S+)(?: HTTP/[\d.]+)?" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?(?: (\S+))?(?: (\S+))?'
SYSLOG_LINE = r"^(?:<\d{1,3}>)?[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"
RFC5424 = r"^<\d{1,3}>\d+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+"
SYSLOG_BODY = r"^(?:\S+:\s*)?(\S+?)\[\d+\]:\s*(.*)$"
SYSLOG_HOST_BODY = r"^\s*(?:\S+\s+)?(\S+?)(?:\[\d+\])?:\s*(.*)$"
LOGGER = r"(^|\s)((?:[a-z0-9_]+\.){1,6}[A-Z][\w$]*(?:\.[\w$]+)*|\[[^\]]{2,60}\])\s*(?:[-:|]\s*)?"
LOGGER_KEY = r'(?i)\b(?:logger|log|component|source|category)\s*[=:]\s*"?([\w.$:-]+)"?'
THREAD = r"^(?:\d+\s+)?-\s*\[([^\]]{1,40})\]"
LEAD = "])>|:,-"  # behind the time, beside white space
AFTER_LEVEL = ":-–—>|"  # behind the severity, beside white space
STATUS_IN_TEXT = r'(?i)\b(?:status(?:Code)?[=: ]|HTTP/\d\.\d"\s+|responded with )\s*([1-5]\d{2})\b'
# Names of JSON fields.
FIELDS = {
    "level": ("level", "severity", "lvl", "levelname", "severity_text", "log.level", "@level"),
    "message": ("message", "msg", "log", "@message", "short_message", "event", "description", "error"),
    "time": ("timestamp", "time", "ts", "@timestamp", "date", "eventTime", "asctime"),
    "logger": ("logger", "logger_name", "source", "service", "component", "channel", "name", "log.logger"),
    "thread": ("thread", "thread_name", "threadName", "tid", "threadId"),
    "error": ("error", "err", "exception", "errorObject"),
    "stack": ("stacktrace", "stack_trace", "stackTrace"),
    "status": ("status", "statusCode", "status_code", "http.status_code", "response_code"),
    "method": ("method", "http.method", "requestMethod", "verb"),
    "url": ("path", "url", "uri", "http.url", "request", "route", "endpoint"),
    "duration": ("duration", "durationMs", "duration_ms", "responseTime", "responseTimeMs", "elapsed", "elapsedMs", "latency", "latencyMs", "took", "tookMs"),
    "bytes": ("bytes", "size", "responseSize"),
    "ip": ("ip", "clientIp", "remoteAddr", "remote_addr", "client_ip"),
}
HTTP = "struct<method:string,path:string,status:int,bytes:long,ip:string,referer:string,user_agent:string,duration_ms:double>"
EXC = "struct<type:string,message:string,fatal:boolean>"
ENTRY = f"struct<level:string,message:string,ts_ms:long,ts_raw:string,logger:string,thread:string,http:{HTTP},exc:{EXC}>"


def _http(**parts: Sql) -> Sql:
    kinds = {"method": "string", "path": "string", "status": "int", "bytes": "long", "ip": "string", "referer": "string", "user_agent": "string", "duration_ms": "double"}
    return X.struct(*((parts.get(k, X.lit(None)) if isinstance(parts.get(k), Sql) else X.lit(parts.get(k))).cast(v).alias(k) for k, v in kinds.items()))


def _entry(**parts: Sql) -> Sql:
    kinds = {"level": "string", "message": "string", "ts_ms": "long", "ts_raw": "string", "logger": "string", "thread": "string", "http": HTTP, "exc": EXC}
    return X.struct(*((parts.get(k, X.lit(None)) if isinstance(parts.get(k), Sql) else X.lit(parts.get(k))).cast(v).alias(k) for k, v in kinds.items()))


def _seconds(text: Sql) -> Sql:
    # A failed cast costs more than the rest of the line: texts that are empty, or begin like no number, aren't cast.
    s = X.when(text.rlike(r'^["\x00-\x20]*[+\-.\d]'), X.replace(text, X.lit('"'), "").try_cast("double"))
    return X.when((s >= 0) & (s < float("inf")), s * 1000)


def _headed(exc: Sql, otherwise: Sql) -> Sql:
    """An exception's message, or its type if that is empty."""
    return X.when(exc.isNotNull(), X.coalesce(X.nullif(exc["message"], ""), exc["type"])).otherwise(otherwise)


def _titled(exc: Sql) -> Sql:
    return X.concat(exc["type"], ": ", exc["message"])


def _worst(exc: Sql) -> Sql:
    return X.when(exc["fatal"], "fatal").otherwise("error")


def access_entry(line: Sql, year: int) -> Sql:
    def made(g: Sql) -> Sql:
        def routed(r: Sql) -> Sql:
            status, path = r["status"], r["path"]
            http = _http(
                method=part(g, 4), path=path, status=status, bytes=g[7].try_cast("long"), ip=part(g, 0), referer=part(g, 8), user_agent=part(g, 9),
                duration_ms=X.coalesce(_seconds(g[10]), _seconds(g[11])),
            )
            ts = extract_timestamp(X.concat("[", g[3], "]"), year)["ts_ms"]
            return _entry(level=level_of_status(status), message=X.concat_ws(" ", part(g, 4), path, g[6]), ts_ms=ts, ts_raw=part(g, 3), http=http)

        route = X.struct(g[6].try_cast("int").alias("status"), normalize_path(g[5]).alias("path"))
        return X.when(g.isNotNull(), X.bind(route, routed))

    return X.bind(groups(line, ACCESS_LINE, 12), made)


def syslog_entry(line: Sql, year: int, strict: bool = False) -> Sql:
    """``strict`` reads the host that standard syslog lines have before the process, so that those lines parse, too."""
    body = SYSLOG_BODY if not strict else SYSLOG_HOST_BODY

    def timed(ts: Sql) -> Sql:
        rest = X.when(ts.isNotNull(), line.substr(ts["end"] + 1, X.length(line))).otherwise(line)

        def made(g: Sql) -> Sql:
            def judged(exc: Sql) -> Sql:
                level = X.when(exc.isNotNull(), _worst(exc)).otherwise(X.coalesce(detect_level(g[1])["level"], infer_level(g[1])))
                text = X.when(exc.isNotNull(), _titled(exc)).otherwise(g[1])
                return _entry(level=level, message=text, ts_ms=ts["ts_ms"], ts_raw=ts["raw"], logger=part(g, 0), exc=exc)

            return X.when(g.isNotNull(), X.bind(exception_header(strip(g[1])), judged))

        return X.bind(groups(rest, body, 2), made)

    return X.bind(extract_timestamp(line, year), timed)


def _is_text(x: Sql) -> Sql:
    return X.coalesce(X.schema_of_variant(x) == "STRING", X.lit(False))


def _is_number(x: Sql) -> Sql:
    return X.coalesce(X.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), X.lit(False))


def _is_nested(x: Sql) -> Sql:
    return X.coalesce(X.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"), X.lit(False))


def _text(x: Sql) -> Sql:
    return X.try_variant_get(x, "$", "string")


def _double(x: Sql) -> Sql:
    return X.try_variant_get(x, "$", "double")


def json_entry(line: Sql, year: int) -> Sql:
    """The entry of a line that is a JSON object; else null. Of a field's names the first that isn't null counts."""

    def of_object(fields: Sql) -> Sql:
        def pick(field: str) -> Sql:
            return X.coalesce(*(X.try_element_at(fields, name) for name in FIELDS[field]))

        def only(field: str, fine, value) -> Sql:
            return X.bind(pick(field), lambda x: X.when(fine(x), value(x)))

        def time(x: Sql) -> Sql:
            number = lambda n: X.when(n > 1e12, n).otherwise(n * 1000).cast("long")
            numbered = X.bind(X.bind(_double(x), number), lambda t: X.struct(t.alias("ms"), utc_text(t).alias("raw")))
            worded = X.bind(_text(x), lambda s: X.struct(extract_timestamp(clean(s), year)["ts_ms"].alias("ms"), s.alias("raw")))
            return X.when(_is_text(x), worded).when(_is_number(x), numbered)

        def error(x: Sql) -> Sql:
            inner = lambda key: X.try_variant_get(x, f"$.{key}", "variant")
            value = lambda key: X.bind(inner(key), lambda y: X.when(~X.is_variant_null(y), _text(y)))

            def told(r: Sql) -> Sql:
                named = X.when(X.coalesce(r["name"], "") == "", "").otherwise(X.concat(r["name"], ": "))
                return X.when(r["stack"].isNotNull(), X.concat(named, r["stack"])).when(
                    (X.coalesce(r["name"], "") != "") | (X.coalesce(r["message"], "") != ""), X.concat(named, X.coalesce(r["message"], ""))
                )

            parts = X.struct(
                X.coalesce(value("name"), value("type"), value("class")).alias("name"), value("message").alias("message"),
                X.bind(inner("stack"), lambda y: X.when(_is_text(y), _text(y))).alias("stack"),
            )
            return X.when(_is_text(x), X.nullif(_text(x), "")).otherwise(X.bind(parts, told))

        stack = X.bind(pick("stack"), lambda x: X.when(_is_text(x), _text(x)).otherwise(X.array_join(X.try_variant_get(x, "$", "array<string>"), "\n")))
        trouble = X.coalesce(X.nullif(X.bind(pick("error"), error), ""), X.nullif(stack, ""))

        def header(text: Sql) -> Sql:
            plain = X.struct(X.lit("exception").alias("type"), text.alias("message"), X.lit(False).alias("fatal")).cast(EXC)
            return X.when(text.isNotNull(), X.coalesce(exception_header(strip(clean(text))).cast(EXC), plain))

        status = X.bind(pick("status"), lambda x: X.when(_is_number(x), _double(x)).otherwise(X.nullif(_text(x).try_cast("double"), X.lit(0.0))))
        http = _http(
            method=only("method", _is_text, _text), path=only("url", _is_text, lambda x: normalize_path(_text(x))), status=status.try_cast("int"),
            bytes=only("bytes", _is_number, lambda x: _double(x).try_cast("long")), ip=only("ip", _is_text, _text), duration_ms=only("duration", _is_number, _double),
        )
        any_http = X.coalesce(*(pick(f) for f in ("status", "method", "url", "duration"))).isNotNull()
        level = X.bind(pick("level"), lambda x: X.when(_is_text(x), detect_level(clean(_text(x)), 40)["level"]).when(_is_number(x), level_of_number(_double(x))))
        # A variant sorts an object's keys; the line's own text has them in their order.
        nested = X.coalesce(*(X.get_json_object(line, f"$['{name}']") for name in FIELDS["message"]))
        message = X.bind(pick("message"), lambda x: X.when(_is_nested(x), nested).otherwise(_text(x)))
        found = X.struct(
            level.alias("level"), message.alias("message"), X.bind(pick("time"), time).alias("time"), X.bind(X.substring_index(trouble, "\n", 1), header).alias("exc"),
            X.when(any_http, http).alias("http"), only("logger", _is_text, _text).alias("logger"), only("thread", lambda x: _is_text(x) | _is_number(x), _text).alias("thread"),
        )

        def told(r: Sql) -> Sql:
            exc, status = r["exc"], r["http"]["status"]
            return X.bind(X.coalesce(r["message"], X.when(exc.isNotNull(), _titled(exc)), line), lambda m: _entry(
                level=X.coalesce(r["level"], X.when(exc.isNotNull(), infer_level(m)), X.when(X.coalesce(status, X.lit(0)) != 0, level_of_status(status)), "info"),
                message=m, ts_ms=r["time"]["ms"], ts_raw=r["time"]["raw"], logger=r["logger"], thread=r["thread"], http=r["http"], exc=exc,
            ))

        return X.when(fields.isNotNull(), X.bind(found, told))

    # The fields that aren't null; null unless the line is an object.
    fields = X.map_filter(X.try_variant_get(X.try_parse_json(line), "$", "map<string,variant>"), lambda k, x: ~X.is_variant_null(x))
    return X.when(line.startswith("{") & line.endswith("}"), X.bind(fields, of_object))


def text_entry(line: Sql, ts: Sql, layout: Sql | str, requests: bool = True) -> Sql:
    """The entry of a free line with its time: severity, thread, logger and message, each cut off from what is left of it."""
    after = lambda text: without_lead(text, AFTER_LEVEL)
    tail = lambda text, end: text.substr(end + 1, X.length(text))

    def finished(r: Sql) -> Sql:
        exc = r["exc"]

        def told(message: Sql) -> Sql:
            level = X.coalesce(r["level"], X.when(exc.isNotNull(), _worst(exc)), infer_level(message))
            if not requests:
                return _entry(level=level, message=message, ts_ms=ts["ts_ms"], ts_raw=ts["raw"], logger=r["logger"], thread=r["thread"], exc=exc)
            asked = X.bind(request_line(message), lambda q: X.when(q.isNotNull(), _http(method=q["method"], path=q["path"], status=q["status"], duration_ms=q["duration_ms"])))
            access = lambda g: _http(method=part(g, 4), path=normalize_path(g[5]), status=g[6].try_cast("int"), bytes=g[7].try_cast("long"), ip=part(g, 0))
            inside = X.when(X.lit(layout != "text") if isinstance(layout, str) else layout != "text", X.bind(groups(line, ACCESS_LINE, 12), lambda g: X.when(g.isNotNull(), access(g))))
            return _entry(level=level, message=message, ts_ms=ts["ts_ms"], ts_raw=ts["raw"], logger=r["logger"], thread=r["thread"], http=X.coalesce(inside, asked), exc=exc)

        return X.bind(_headed(exc, r["body"]), told)

    def state(body: Sql, level: Sql, thread: Sql, logger: Sql | None = None, exc: Sql | None = None) -> Sql:
        none = X.lit(None)
        return X.struct(
            body.alias("body"), level.cast("string").alias("level"), thread.cast("string").alias("thread"),
            (none if logger is None else logger).cast("string").alias("logger"), (none if exc is None else exc).cast(EXC).alias("exc"),
        )

    def levelled(rest: Sql) -> Sql:
        return X.bind(detect_level(rest), lambda hit: state(X.when(hit.isNotNull(), after(tail(rest, hit["end"]))).otherwise(rest), hit["level"], X.lit(None)))

    def threaded(r: Sql) -> Sql:
        found = X.when(holds(r["body"], "[", "-"), groups(r["body"], THREAD, 1))
        return X.bind(found, lambda g: X.when(g.isNotNull(), state(after(g[1]), r["level"], g[0])).otherwise(r))

    def inner(r: Sql) -> Sql:
        """``[main] INFO text``: the severity may stand behind a thread."""
        second = lambda g: X.bind(detect_level(g[1]), lambda hit: X.when(hit.isNotNull(), state(after(tail(g[1], hit["end"])), hit["level"], r["thread"])).otherwise(r))
        return X.when(r["level"].isNotNull(), r).otherwise(X.bind(groups(r["body"], r"^\[([^\]]{1,40})\]\s*(.*)$", 2), lambda g: X.when(g.isNotNull(), second(g)).otherwise(r)))

    def named(r: Sql) -> Sql:
        keyed = X.bind(X.when(any_of(r["body"], "=:"), cut(r["body"], LOGGER_KEY, 1)), lambda g: X.when(g.isNotNull(), state(X.concat(g[0], g[3]), r["level"], r["thread"], g[2])).otherwise(r))
        lead = lambda g: state(after(g[4]), r["level"], r["thread"], X.regexp_replace(strip(g[3]), r"^\[(.*)\]$", "$1"))
        return X.bind(X.when(any_of(r["body"], ".["), cut(r["body"], LOGGER, 2)), lambda g: X.when(g.isNotNull() & (X.length(g[0]) <= 2) & (strip(g[3]) != ""), lead(g)).otherwise(keyed))

    def excepted(r: Sql) -> Sql:
        again = lambda n: state(n["body"], n["level"], n["thread"], n["logger"], exception_header(strip(n["body"])))
        first = lambda exc: X.when(exc.isNotNull(), state(r["body"], r["level"], r["thread"], None, exc)).otherwise(X.bind(named(r), again))
        return X.bind(exception_header(strip(r["body"])), first)

    steps = X.bind(without_lead(X.when(ts.isNotNull(), tail(line, ts["end"])).otherwise(line), LEAD), levelled)
    for step in (threaded, inner, excepted, finished):
        steps = X.bind(steps, step)
    return steps


def special_entry(line: Sql, layout: Sql | str, year: int, strict: bool) -> Sql:
    """The entry of a line in its file's structured layout; null where it isn't one."""
    ways = {"json": lambda: json_entry(line, year), "apache": lambda: access_entry(line, year), "syslog": lambda: syslog_entry(line, year, strict)}
    if isinstance(layout, str):
        return (ways[layout]() if layout in ways else X.lit(None)).cast(ENTRY)
    out = X.lit(None)
    for name, way in ways.items():
        out = X.when(layout == name, way()).otherwise(out)
    return out.cast(ENTRY)


def _stage(df: DataFrame, **columns: Sql) -> DataFrame:
    """Adds columns by a generator: what comes after can't copy their expressions, and short texts are parsed faster than one long one."""
    return df.select("*", X.inline(X.array(X.struct(*(c.alias(name) for name, c in columns.items())))).column)


def parse_lines(lines: DataFrame, formats: DataFrame | None = None, year: int = 2024, layout: str | None = None, syslog_strict: bool = False, requests: bool = True, signatures: bool = True) -> DataFrame:
    """lines(file_id, line_no, raw) -> one typed row for each line.

    Without ``requests``, free lines aren't searched for requests, and their ``http`` is null. Without ``signatures``, the last
    two columns aren't there (``signed`` adds them).

    The layout comes from ``formats(file_id, format)`` (one row for each file) or is ``layout`` for all.
    Columns: file_id, line_no, raw, format, is_empty, continuation, level, message, ts_ms, ts_raw, logger, thread, http, exc,
    frame, normalized, signature.
    """
    df = lines.select("file_id", "line_no", F.coalesce("raw", F.lit("")).alias("raw"))
    df = df.join(formats.select("file_id", "format"), "file_id") if formats is not None else df.withColumn("format", F.lit(layout or "text"))
    line = X.col("line")
    df = _stage(df, line=strip(clean(X.col("raw"))))
    df = _stage(df, special=special_entry(line, X.col("format") if formats is not None else layout or "text", year, syslog_strict))
    free = X.col("special").isNull() & (line != "")
    df = _stage(df, frame=X.when(free, stack_frame(line)).cast(FRAME_TYPE))
    df = _stage(df, is_empty=line == "", continuation=X.col("special").isNull() & is_continuation(X.col("raw"), X.col("frame")))
    plain = free & ~X.col("continuation")
    df = _stage(df, ts=X.when(plain, extract_timestamp(line, year)), head=X.when(X.col("continuation"), exception_header(line)))
    # A continuation keeps its line, and its exception if it is a header.
    body = _entry(level="unknown", message=_headed(X.col("head"), line), exc=X.col("head"))
    entry = X.when(X.col("is_empty"), _entry(level="unknown", message="")).when(X.col("continuation"), body)
    text = text_entry(line, X.col("ts"), X.col("format") if formats is not None else layout or "text", requests)
    df = _stage(df, e=X.coalesce(X.col("special"), entry.when(plain, text)))
    df = df.select("file_id", "line_no", "raw", "format", "is_empty", "continuation", "e.*", "frame")
    return signed(df) if signatures else df


def signed(df: DataFrame) -> DataFrame:
    """Adds the normalised message and the fingerprint. A stitched orphan's severity is that of its line, as before stitching."""
    df = df.withColumn("normalized", normalize_message(X.col("message")).column)
    level = X.col("level") if "role" not in df.columns else X.when((X.col("role") == "orphan") & X.col("continuation"), "unknown").otherwise(X.col("level"))
    whole = signed_text(level, X.col("normalized"), X.col("exc.type"), X.col("logger"))
    return df.withColumn("signature", F.when(F.col("is_empty"), "empty").otherwise(signature_of(X.when(~X.col("is_empty"), whole).column)))
