"""Exception headers and stack frames of common dialects."""

from __future__ import annotations

from timberline.functions.sqltext import Sql, X

from timberline.functions.text import any_of, groups, part, strip, without_lead

# Exception headers (pattern, type or None for group 1, fatal), tried in this order.
HEADERS = (
    (r"^(?:Caused by:\s*|Suppressed:\s*|Unhandled exception:\s*)?([\w$.]*(?:Exception|Error|Throwable|Fault|Failure))\b\s*[:-]?\s*(.*)$", None, False),
    (r"^([A-Z][\w+]*(?:Exception|Error))\s*:\s*(.*)$", None, False),
    (r"^([A-Z][\w.]*(?:Error|Exception|Warning|Interrupt|Exit))\s*:\s*(.*)$", None, False),
    (r"^(?:Uncaught\s+)?([A-Z][\w]*(?:Error|Exception))\s*:\s*(.*)$", None, False),
    (r"^panic:\s*(.*)$", "panic", True),
    (r"^fatal error:\s*(.*)$", "fatal error", True),
)
#: Every header holds one of these.
ENDINGS = ("Exception", "Error", "Throwable", "Fault", "Failure", "Warning", "Interrupt", "Exit", "panic:", "fatal error:")
# Stack frames, as (pattern, its groups, function's group, file's group, line's group or None if the file's has it).
FRAMES = (
    (r"^at\s+([\w$.<>]+\.[\w$<>]+)\(([^)]*)\)\s*$", 2, 1, 2, None),
    (r"^at\s+([\w$]+(?:\.[\w$]+)*)\(([^)]*)\)\s*$", 2, 1, 2, None),
    (r"^at\s+(?:async\s+)?(.+?)\s+\((.+?)\)\s*$", 2, 1, 2, None),
    (r"^at\s+(\S+?)(?::(\d+):(\d+))\s*$", 3, None, 1, 2),
    (r'^File\s+"([^"]+)",\s*line\s+(\d+)(?:,\s*in\s+(.+))?$', 3, 3, 1, 2),
    (r"(?i)^([\w./()*\[\]-]+)\((?:0x[0-9a-f]+)?\)?\s+(/[^:]+|\S+\.go):(\d+)", 3, 1, 2, 3),
    (r"(?i)^at\s+([\w.<>`]+)\(?\)?\s+in\s+(.+?):line\s+(\d+)$", 3, 1, 2, 3),
    (r"^from\s+(.+?):(\d+)(?::in\s+[`'](.+?)')?", 3, 3, 1, 2),
)
CONTINUATIONS = (
    "caused by:", "suppressed:", "during handling of the above exception", "the above exception was thrown", "... ",
    "traceback (most recent call last):", "stack trace:", "exception in thread", "unhandled exception", "unhandled rejection",
    "unhandledpromiserejection", "^",
)
FRAME_TYPE = "struct<function:string,file:string,line:int,raw:string>"


def exception_header(line: Sql) -> Sql:
    """struct(type, message, fatal) of an exception's first line (without white space at its ends), or null."""

    def way(text: Sql, pattern: str, kind: str | None, fatal: bool) -> Sql:
        def made(g: Sql) -> Sql:
            name, rest = (part(g, 0), g[1]) if kind is None else (X.lit(kind), g[0])
            return X.when(g.isNotNull(), X.struct(name.alias("type"), strip(rest).alias("message"), X.lit(fatal).alias("fatal")))

        return X.bind(groups(text, pattern, 2 if kind is None else 1), made)

    return X.bind(line, lambda text: X.when(any_of(text, ENDINGS), X.coalesce(*(way(text, *h) for h in HEADERS))))


def stack_frame(line: Sql) -> Sql:
    """struct(function, file, line, raw) of a stack frame (without white space at its ends), or null."""

    def way(pattern: str, count: int, function: int | None, place: int, number: int | None) -> Sql:
        def made(g: Sql) -> Sql:
            name = X.lit(None).cast("string") if function is None else strip(part(g, function - 1))

            def framed(where: Sql) -> Sql:
                if number is not None:
                    return _frame(name, where, part(g, number - 1), line)
                known = ~where.isin("", "Unknown Source", "<anonymous>")
                split = groups(where, r"^(.*?):(\d+)(?::\d+)?$", 2)
                return X.bind(split, lambda t: X.when(t.isNotNull(), _frame(name, t[0], t[1], line)).otherwise(_frame(name, X.when(known, where), X.lit(None), line)))

            return X.when(g.isNotNull(), X.bind(strip(g[place - 1]), framed))

        return X.bind(groups(line, pattern, count), made)

    return X.when(line.rlike(r"(?i)^(at |file |from |[\w./()*\[\]-]+\()"), X.coalesce(*(way(*f) for f in FRAMES)))


def _frame(function: Sql, file: Sql, number: Sql, raw: Sql) -> Sql:
    at = number.cast("string").try_cast("int")
    return X.struct(function.alias("function"), file.alias("file"), at.alias("line"), raw.alias("raw")).cast(FRAME_TYPE)


#: No mark of a continuation is longer.
MARK = max(map(len, CONTINUATIONS))


def is_continuation(raw: Sql, frame: Sql) -> Sql:
    def marked(low: Sql) -> Sql:
        marks = frame.isNotNull()
        for m in CONTINUATIONS:
            marks = marks | low.startswith(m)
        return (low != "") & marks

    return X.bind(X.lower(X.substring(without_lead(raw), 1, MARK)), marked)


def frame_owner(frame: Sql) -> Sql:
    """The class or module that a frame belongs to."""
    name = strip(X.regexp_replace(frame["function"], r"\(.*$", ""))
    owner = X.when(X.instr(name, ".") > 0, X.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return X.when(frame["function"].isNull(), frame["file"]).otherwise(owner)


def compact_frames(frames: Sql, most: int = 40, head: int = 12, tail: int = 6) -> Sql:
    return X.when(X.size(frames) > most, X.concat(X.slice(frames, 1, head), X.slice(frames, -tail, tail))).otherwise(frames)


# References to places in sources.
SOURCE_REFS = (
    r"\b((?:[\w.-]+/)+[\w.-]+\.\w{1,5}):(\d+)(?::(\d+))?",
    r"\b([A-Za-z]:\\[^\s:]+|[^\s:]+\.(?:java|kt|py|go|cs|js|jsx|ts|tsx|rb|php|c|h|cc|cpp|cs|rs|scala)):(\d+)(?::(\d+))?",
)


def source_refs(text: Sql, limit: int = 3) -> Sql:
    """The first ``file:line`` references, one for each file."""
    refs = X.concat(*(X.regexp_extract_all(text, p, 0) for p in SOURCE_REFS))
    refs = X.transform(refs, lambda r: X.regexp_extract(r, r"^(.*?:\d+)(?::\d+)?$", 1))
    file = lambda r: X.regexp_replace(r, r"\d+$", "")
    none = X.array().cast("array<string>")
    one = X.aggregate(refs, none, lambda acc, r: X.when(X.exists(acc, lambda a: a.startswith(file(r))), acc).otherwise(X.array_append(acc, r)))
    return X.when(text.rlike(r":\d"), X.slice(one, 1, limit)).otherwise(none)
