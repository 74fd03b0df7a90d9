"""Durations in messages, and the operations they belong to."""

from __future__ import annotations

from timberline.functions.sqltext import Sql, X

from timberline.functions.text import any_of, clean, cut, flat, groups, normalize_path, part, strip

BUDGET_MS, SEVERE_MS = 1_000, 5_000
# Milliseconds of each unit.
UNIT_MS = {
    "ns": 1e-6, "us": 1e-3, "µs": 1e-3, "μs": 1e-3, "ms": 1.0, "msec": 1.0, "msecs": 1.0, "millis": 1.0, "millisecond": 1.0, "milliseconds": 1.0,
    "s": 1e3, "sec": 1e3, "secs": 1e3, "second": 1e3, "seconds": 1e3, "m": 6e4, "min": 6e4, "mins": 6e4, "minute": 6e4, "minutes": 6e4,
    "h": 3.6e6, "hour": 3.6e6, "hours": 3.6e6,
}
UNITS = "|".join(UNIT_MS)
# Words that make a number a duration.
CUES = (
    r"took|elapsed|latency|duration|dur\b|delay|waited\s+for|waiting\s+for|blocked\s+for|completed|finished|processed|handled|"
    r"responded|resolved|query\s+time|query\s+took|execution\s+time|execution\s+took|response\s*time|response\s+took|"
    r"round\s*trips?\s*in|cost|cost_ms|ttfb|rt\b"
)
CUED = rf"(?i)\b({CUES})\b[^0-9]{{0,18}}?(\d+(?:[.,]\d+)?)\s*({UNITS})\b"
BRACKETED = rf"(?i)[\[(]\s*(\d+(?:[.,]\d+)?)\s*({UNITS})\s*[\])]"
SPENT = rf"(?i)\b(spent|spent_time|took_time|time_taken|timings?|process_time|processing_time|total_time)\b[^0-9]{{0,12}}?(\d+(?:[.,]\d+)?)\s*({UNITS})\b"
# What a message with a duration holds, where an operation's name stands, and request lines.
TIMED = r"(?i)\d(?:\.\d+)?\s*(?:ns|us|µs|μs|ms|msec|millisecond|milliseconds|sec|seconds?|s|min|minutes?|m)\b"
QUOTED_NAME = r"[\"'`]([A-Za-z][\w .:/-]{2,48})[\"'`]"
NAMED_KEY = r"(?i)\b(?:operation|op|name|job|method|handler|action|query|sql|step|route|endpoint|command)\s*[=:]\s*[\"'`]?([\w.:/-]{2,48})"
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
METHOD_PATH = rf"(?i)\b({'|'.join(METHODS)})\s+(\S+)"
REQUEST = r"(?i)^\s*(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|TRACE)\s+(\S+)\s*(?:->|=>)\s*([1-5]\d{2})\b\s*(.*)$"
REQUEST_TIME = r"(?i)(\d+(?:[.,]\d+)?)\s*(ns|us|µs|μs|ms|msec|milliseconds|s|sec|secs|seconds?)\b"
LOGGER_LEAD = r"^[\w.$]{4,}\s+[-–—|]\s+"


def to_ms(value: Sql, unit: Sql) -> Sql:
    """Milliseconds; null for an unknown unit."""
    table = X.map(*(x for kv in UNIT_MS.items() for x in kv))
    return value * X.try_element_at(table, X.lower(unit))


def _ms(value: Sql, unit: Sql) -> Sql:
    return to_ms(X.replace(value, ",", ".").try_cast("double"), unit)


def compact_name(text: Sql) -> Sql:
    masked = X.regexp_replace(text, r"\b\d+(?:[.,]\d+)?\b", "n")
    return X.substring(flat(masked), 1, 48)


def operation_name(message: Sql, before: Sql | None = None) -> Sql:
    """Name of the timed operation; ``before`` is what stands before the cue word, if there is one."""
    no_brackets = lambda c: X.bind(c, lambda t: X.when(any_of(t, "[("), X.regexp_replace(t, r"[\[(][^\])]*[\])]", " ")).otherwise(t))
    words = X.filter(X.split(no_brackets(message), r"\s+"), lambda w: (X.length(w) > 2) & ~w.rlike("(?i)^(in|after|within|to|for|the|was|is)$"))
    last = X.coalesce(X.nullif(compact_name(X.array_join(X.slice(words, 1, 3), " ")), ""), "operation")
    named = X.bind(cut(message, NAMED_KEY, 1), lambda g: X.when(g.isNotNull(), strip(g[2])))

    def prefixed(prefix: Sql) -> Sql:
        bare = X.nullif(X.regexp_replace(compact_name(prefix), r"^[\s\-:>]+|[\s\-:,]+$", ""), "")
        return X.when(prefix.rlike(LOGGER_LEAD + ".+$"), compact_name(X.regexp_replace(prefix, LOGGER_LEAD, ""))).otherwise(X.coalesce(bare, named, last))

    quoted = X.bind(X.when(any_of(message, "\"'`"), cut(message, QUOTED_NAME, 1)), lambda g: X.when(g.isNotNull(), strip(g[2])))
    worded = X.bind(X.lower(message), lambda low: any_of(low, tuple(m.lower() for m in METHODS)))
    asked = X.bind(X.when(worded, cut(message, METHOD_PATH, 2)), lambda g: X.when(g.isNotNull(), compact_name(X.concat(g[2], " ", X.substring_index(g[3], "?", 1)))))
    return X.coalesce(quoted, asked, X.bind(strip(no_brackets(message if before is None else before)), prefixed))


def extract_duration(message: Sql) -> Sql:
    """struct(ms, name) of the first positive duration in a message, or null."""

    def ways(text: Sql) -> Sql:
        def way(pattern: str, count: int, cued: bool) -> Sql:
            def made(g: Sql) -> Sql:
                def hit(ms: Sql) -> Sql:
                    return X.when(ms > 0, X.struct(ms.alias("ms"), operation_name(text, g[0] if cued else None).alias("name")))

                return X.when(g.isNotNull(), X.bind(_ms(g[count], g[count + 1]), hit))

            return X.bind(cut(text, pattern, count), made)

        return X.coalesce(way(CUED, 3, True), way(BRACKETED, 2, False), way(SPENT, 3, True))

    return X.when(message.rlike(TIMED), X.bind(clean(message), ways))


def request_line(message: Sql) -> Sql:
    """struct(method, path, status, duration_ms) of ``GET /x -> 200 (12ms)``, or null."""

    def made(g: Sql) -> Sql:
        time = X.bind(cut(g[3], REQUEST_TIME, 2), lambda t: X.when(t.isNotNull(), _ms(t[2], t[3])))
        http = X.struct(
            X.upper(g[0]).alias("method"), normalize_path(X.substring_index(g[1], "?", 1)).alias("path"), part(g, 2).try_cast("int").alias("status"), time.alias("duration_ms"),
        )
        return X.when(g.isNotNull(), http)

    body = X.regexp_replace(clean(message), LOGGER_LEAD, "")
    return X.when(X.contains(message, "->") | X.contains(message, "=>"), X.bind(groups(body, REQUEST, 4), made))
