"""Sql helpers for text."""

from __future__ import annotations

from timberline.functions.sqltext import Sql, X

#: Stands between the groups of a match while they are taken apart. Lines have blanks in its place (``clean``).
SEP = "\x1f"
SPACE = " \t\n\x0b\x0c\r\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAY_MS = 86_400_000


def clean(text: Sql) -> Sql:
    return X.replace(text, SEP, " ")


def groups(text: Sql, pattern: str, count: int) -> Sql:
    """The ``count`` groups of the match of a pattern that begins with ``^``, empty where a group has no part, and the text after it; else null.

    One run of the pattern gives all groups. The text holds no ``SEP`` (``clean``).
    """
    marked = X.regexp_replace(text, pattern, SEP.join(f"${k}" for k in range(1, count + 1)) + SEP)
    return X.bind(marked, lambda m: X.when(m.contains(SEP), X.split(m, SEP, -1)))


def any_of(text: Sql, characters: str | tuple[str, ...]) -> Sql:
    """Whether the text holds one of the characters (or words); much cheaper than a pattern that needs one."""
    out = text.contains(characters[0])
    for c in characters[1:]:
        out = out | text.contains(c)
    return Sql(f"({out.text})")


def holds(text: Sql, *needs: str | tuple[str, ...]) -> Sql:
    """Whether the text holds one of each: what a pattern can't do without."""
    out = any_of(text, needs[0])
    for need in needs[1:]:
        out = out & any_of(text, need)
    return out


def cut(text: Sql, pattern: str, count: int) -> Sql:
    """[text before, match, groups 1 to count, text after] of the first match; null without one.

    What is before it is matched, too, so that there is one match only; the text after it stays as it is and costs nothing.
    """
    flags, body = (pattern[:4], pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    marked = X.regexp_replace(text, rf"{flags}^((?s:.*?))({body})", SEP.join(f"${k}" for k in range(1, count + 3)) + SEP)
    return X.bind(marked, lambda m: X.when(m.contains(SEP), X.split(m, SEP, -1)))


def part(found: Sql, index: int) -> Sql:
    """A group by its place; null where it is empty."""
    return X.nullif(found[index], "")


def strip(text: Sql) -> Sql:
    """Without white space at both ends. A search of the whole set is dear: texts that begin and end with visible ASCII are spared it."""
    visible = lambda c: (c > 32) & (c < 127)
    return X.bind(text, lambda t: X.when(visible(X.ascii(t)) & visible(X.ascii(X.substring(t, -1, 1))), t).otherwise(X.btrim(t, SPACE)))


def without_lead(text: Sql, extra: str = "") -> Sql:
    """Without white space, and the characters of ``extra``, at the beginning."""
    return X.ltrim(SPACE + extra, text)


def flat(text: Sql) -> Sql:
    """White space as one blank, none at the ends; texts whose only white space is single blanks aren't rewritten."""
    rewritten = lambda t: X.when(any_of(t, ("  ", "\t", "\n", "\x0b", "\x0c", "\r")), X.regexp_replace(t, r"\s+", " ")).otherwise(t)
    return strip(X.bind(text, rewritten))


def truncate(text: Sql, limit: int) -> Sql:
    """At most ``limit`` characters, the last one an ellipsis if any were cut."""
    return X.when(X.length(text) > limit, X.concat(X.substring(text, 1, limit - 1), "…")).otherwise(text)


def round_half_up(x: Sql) -> Sql:
    return X.floor(x + 0.5)


#: Up to here a figure and its digits behind the point are a whole number that a double holds.
LARGE = 1e9


def shortened(x, digits: int, floor, when):
    """``x * 10^digits`` (a double, not negative) rounded to a whole number; x is an ``Sql`` or a column.

    What counts is the double itself, so 1.005, which is a little less than that, has 1.00 as its nearest. A plain product
    can't tell. Its error is exact here: the upper half of x's bits and the rest, each times the power, lose nothing.
    """
    power = float(10**digits)
    upper = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * power
    error = (upper * power - product) + (x - upper) * power
    whole = floor(product)
    return whole + when(product - whole - 0.5 + error >= 0, 1).otherwise(0)


def fixed(x: Sql, digits: int) -> Sql:
    """With so many digits behind the point; the nearest, the larger one of two (from ``LARGE`` on as Java rounds)."""
    shown = lambda v: X.when(v < LARGE, shortened(v, digits, X.floor, X.when) / float(10**digits)).otherwise(v)
    return X.bind(x.cast("double"), lambda v: X.when(v.isNotNull(), X.format_string(f"%.{digits}f", shown(v))))


def percent(x: Sql, digits: int = 1) -> Sql:
    return X.concat(fixed(x * 100, digits), "%")


def short_ms(ms: Sql) -> Sql:
    """``850ms``, ``4.20s``, ``2.5m``."""
    return (
        X.when(ms >= 60_000, X.concat(fixed(ms / 60_000, 1), "m"))
        .when(ms >= 1_000, X.concat(fixed(ms / 1_000, 2), "s"))
        .otherwise(X.concat(round_half_up(ms).cast("string"), "ms"))
    )


def normalize_path(path: Sql) -> Sql:
    """Path without query, with ids, uuids and hashes replaced so that requests of a route group together."""

    def segment(s: Sql) -> Sql:
        return (
            X.when(s.rlike("^[0-9]+$"), ":id")
            .when((X.length(s) > 13) & s.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-"), ":uuid")
            .when((X.length(s) > 15) & s.rlike("(?i)^[0-9a-f]{16,}$"), ":hash")
            .when((X.length(s) > 24) & s.rlike("[0-9]"), ":id")
            .otherwise(s)
        )

    bare = X.bind(path, lambda p: X.when(any_of(p, "?#"), X.regexp_replace(p, r"(?s)[?#].*$", "")).otherwise(p))
    return X.array_join(X.transform(X.split(bare, "/"), segment), "/")


def format_duration(ms: Sql) -> Sql:
    """``850ms``, ``4.20s``, ``32.1s``, ``5m 3s``, ``2h 5m``."""
    s = ms / 1000
    minutes = X.floor(s / 60)
    return (
        X.when(ms < 1000, X.concat(round_half_up(ms).cast("string"), "ms"))
        .when(s < 10, X.concat(fixed(s, 2), "s"))
        .when(s < 60, X.concat(fixed(s, 1), "s"))
        .when(minutes < 60, X.concat(minutes.cast("string"), "m ", round_half_up(s % 60).cast("string"), "s"))
        .otherwise(X.concat(X.floor(minutes / 60).cast("string"), "h ", (minutes % 60).cast("string"), "m"))
    )


def format_bytes(n: Sql, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Sql:
    out = X.concat(n.cast("string"), " B")
    for k, unit in enumerate(units, 1):
        v = n / 1024.0**k
        out = X.when(n >= 1024**k, X.concat(X.when(v >= 10, fixed(v, 0)).otherwise(fixed(v, 1)), f" {unit}")).otherwise(out)
    return out


def view_size(n: Sql) -> Sql:
    """Bytes as a report's head shows them: gigabytes at most."""
    return format_bytes(n, ("KB", "MB", "GB"))


def view_span(ms: Sql) -> Sql:
    """A length of time as a report's head shows it: ``850ms``, ``32.1s``, ``5m``, ``2.1h``."""
    return (
        X.when(ms < 1000, X.concat(round_half_up(ms).cast("string"), "ms"))
        .when(ms < 60_000, X.concat(fixed(ms / 1000, 1), "s"))
        .when(ms < 3_600_000, X.concat(round_half_up(ms / 60_000).cast("string"), "m"))
        .otherwise(X.concat(fixed(ms / 3_600_000, 1), "h"))
    )


def _date(ts_ms: Sql) -> Sql:
    return X.date_from_unix_date(X.floor(ts_ms / DAY_MS).cast("int"))


def _clock(ts_ms: Sql) -> Sql:
    """``HH:mm:ss`` in UTC."""
    s = X.floor(X.pmod(ts_ms, DAY_MS) / 1000).cast("int")
    two = lambda x: X.lpad(x.cast("string"), 2, "0")
    return X.concat(two(X.floor(s / 3600)), ":", two(X.floor(s / 60) % 60), ":", two(s % 60))


def utc_text(ts_ms: Sql, between: str = "T", behind: str = "Z") -> Sql:
    """``2024-05-01T12:34:56.789Z``, in UTC whatever the session's zone."""
    ms = X.lpad(X.pmod(ts_ms, 1000).cast("string"), 3, "0")
    return X.concat(_date(ts_ms).cast("string"), between, _clock(ts_ms), ".", ms, behind)


def stamp(ts_ms: Sql) -> Sql:
    return utc_text(ts_ms, " ", " UTC")


def format_time(ts_ms: Sql, with_date: bool = True) -> Sql:
    """``May 1 12:34:56``, in UTC."""
    day = _date(ts_ms)
    name = X.element_at(X.array(*MONTHS), X.month(day))
    return X.concat(name, " ", X.dayofmonth(day).cast("string"), " ", _clock(ts_ms)) if with_date else _clock(ts_ms)


def csv_cell(text: Sql) -> Sql:
    text = X.coalesce(text.cast("string"), "")
    return X.when(text.rlike('[",\n]'), X.concat('"', X.replace(text, '"', '""'), '"')).otherwise(text)
