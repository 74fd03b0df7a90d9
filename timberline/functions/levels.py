"""Severity of log lines."""

from __future__ import annotations

from timberline.functions.sqltext import Sql, X

from timberline.functions.text import any_of, cut, holds

# Severities by rank, the words for them, and the wording that implies them.
RANK = {"fatal": 6, "error": 5, "warn": 4, "info": 3, "debug": 2, "trace": 1, "unknown": 0}
LEVEL_OF_WORD = {
    "FATAL": "fatal", "CRITICAL": "fatal", "CRIT": "fatal", "PANIC": "fatal", "EMERG": "fatal", "ALERT": "fatal",
    "ERROR": "error", "ERR": "error", "EXCEPTION": "error", "FAILURE": "error", "FAILED": "error", "FAIL": "error",
    "WARN": "warn", "WARNING": "warn", "NOTICE": "warn",
    "INFO": "info", "INFORMATION": "info", "LOG": "info",
    "DEBUG": "debug", "DBG": "debug",
    "TRACE": "trace", "VERBOSE": "trace", "FINE": "trace", "FINER": "trace", "FINEST": "trace",
}
ERROR_WORDING = (
    "exception", "traceback", "stack trace", "fatal", "panic:", "segmentation fault", "assertionerror", "assertion failed",
    "failed", "failure", "cannot ", "unable to", "refused", "denied", "not found", "timed out", "timeout", "out of memory",
    "crash", "invalid", "expected ",
)
WARN_WORDING = ("warn", "deprecated", "deprecation", "retry", "slow", "approaching", "fallback", "falling back", "soft ")
DEBUG_WORDING = ("debug", "trace", "verbose")

# Where a severity stands in a line, tried in this order: (pattern, group of the word, characters of which it needs one).
MARKERS = (
    (r"[\[({<]\s*([A-Za-z]{3,9})\s*[\])}>]", 1, "[({<"),
    (r'(?i)\b(?:level|severity|lvl|levelname|log_level|log\.level)\b\s*[=:]\s*"?([A-Za-z]{3,9})"?', 1, "=:"),
    (r"(?:^|[\s-])[*#=]?\s*([A-Za-z]{3,9})\s*[:|]\s*", 1, ":|"),
    (r"^([A-Z]{3,9}):\S+?:", 1, ":"),
    (r"(?:^|[\s\])>(|])([*#=]?\s*)([A-Za-z]{3,9})\s*(?=[-:|(\s]|$)", 2, ""),
    (r"^[*#=]?\s*([A-Z]{3,9})\b", 1, ""),
)
KEYED, SEPARATED = MARKERS[1][0], MARKERS[4][0]


def _lookup(pairs: dict[str, object], key: Sql) -> Sql:
    return X.try_element_at(X.map(*(x for kv in pairs.items() for x in kv)), key)


def rank(level: Sql) -> Sql:
    return X.coalesce(_lookup(RANK, level), 0)


def token_level(token: Sql) -> Sql:
    return _lookup(LEVEL_OF_WORD, X.upper(token))


def detect_level(text: Sql, scan: int = 160) -> Sql:
    """struct(level, start, end) of the explicit severity within the first ``scan`` characters, or null.

    Each kind of marker looks at its first match only; if that isn't a severity, the next kind is tried.
    """

    def all_of(head: Sql) -> Sql:
        def way(pattern: str, index: int, gate: str) -> Sql:
            def made(g: Sql) -> Sql:
                def hit(level: Sql) -> Sql:
                    at, whole = X.length(g[0]), g[1]
                    if pattern == SEPARATED:
                        at, whole = at + X.length(g[2]), g[3]
                    return X.when(level.isNotNull(), X.struct(level.alias("level"), at.alias("start"), (at + X.length(whole)).alias("end")))

                return X.when(g.isNotNull(), X.bind(token_level(g[index + 1]), hit))

            found = X.bind(cut(head, pattern, index), made)
            if pattern == KEYED:
                return X.when(holds(head, gate) & X.bind(X.lower(head), lambda low: any_of(low, ("level", "lvl", "severity"))), found)
            return X.when(any_of(head, gate), found) if gate else found

        return X.coalesce(*(way(*m) for m in MARKERS))

    return X.bind(X.substring(text, 1, scan), all_of)


def infer_level(message: Sql) -> Sql:
    """Severity by wording."""
    told = lambda low: X.when(any_of(low, ERROR_WORDING), "error").when(any_of(low, WARN_WORDING), "warn").when(any_of(low, DEBUG_WORDING), "debug").otherwise("info")
    return X.bind(X.lower(message), told)


def level_of_status(status: Sql) -> Sql:
    return X.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")


def level_of_number(n: Sql) -> Sql:
    """Syslog severity numbers."""
    return X.when(n <= 2, "fatal").when(n <= 3, "error").when(n <= 4, "warn").when(n <= 6, "info").otherwise("debug")
