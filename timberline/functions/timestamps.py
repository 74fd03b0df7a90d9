"""Timestamps in log lines, as epoch milliseconds with their place in the line.

Times without a zone are UTC, whatever the session's zone; syslog times take the given year.
"""

from __future__ import annotations

from timberline.functions.sqltext import Sql, X

from timberline.functions.text import DAY_MS, MONTHS, cut, holds, strip

# The layouts that are looked for, most specific first.
ISO = r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,6}))?(Z|[+-]\d{2}:?\d{2})?"
ACCESS = r"(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})\s*([+-]\d{4})?"
SYSLOG = r"([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})"
YEAR_FIRST = r"(\d{4})/(\d{2})/(\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
MONTH_FIRST = r"(\d{2})/(\d{2})/(\d{4})\s+(\d{2}):(\d{2}):(\d{2})"
EPOCH = r"(?:^|[\[({| ])(1[0-9]{12}|20[0-9]{11})(?:[\])}| ,:]|$)"

TIME = "struct<ts_ms:bigint,raw:string,start:int,end:int>"


def _number(x: Sql) -> Sql:
    return x.cast("long")


def _month(name: Sql) -> Sql:
    """1 to 12; null for another word."""
    at = X.array_position(X.array(*MONTHS), X.initcap(name))
    return X.when(at > 0, at)


def _millis(year: Sql, month: Sql, day: Sql, clock: list[Sql], millis: Sql | None = None) -> Sql:
    """Null unless the parts are in range; a day that the month doesn't have counts on into the next."""
    hour, minute, second = clock
    days = X.unix_date(X.make_date(year.cast("int"), month.cast("int"), X.lit(1))) + day - 1
    value = days.cast("long") * DAY_MS + hour * 3_600_000 + minute * 60_000 + second * 1000
    value = value if millis is None else value + millis
    return X.when(month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 59), value)


def _offset(zone: Sql) -> Sql:
    """Milliseconds east of UTC of ``+01:00`` or ``+0100``; 0 for Z or nothing."""
    digits = X.regexp_replace(zone, "[^0-9]", "")
    ms = (_number(X.substring(digits, 1, 2)) * 60 + _number(X.substring(digits, 3, 2))) * 60_000
    return X.when(zone.isin("", "Z"), 0).when(X.length(digits) == 4, X.when(zone.startswith("-"), -ms).otherwise(ms)).otherwise(0)


def _clock(g: Sql, at: int) -> list[Sql]:
    return [_number(g[at + k]) for k in range(3)]


def _iso(g: Sql, year: int) -> Sql:
    fraction = _number(X.rpad(X.substring(g[8], 1, 3), 3, "0"))
    return _millis(_number(g[2]), _number(g[3]), _number(g[4]), _clock(g, 5), fraction) - _offset(g[9])


def _access(g: Sql, year: int) -> Sql:
    return _millis(_number(g[4]), _month(g[3]), _number(g[2]), _clock(g, 5)) - _offset(g[8])


def _syslog(g: Sql, year: int) -> Sql:
    return _millis(X.lit(year), _month(g[2]), _number(g[3]), _clock(g, 4))


def _year_first(g: Sql, year: int) -> Sql:
    return _millis(_number(g[2]), _number(g[3]), _number(g[4]), _clock(g, 5))


def _month_first(g: Sql, year: int) -> Sql:
    return _millis(_number(g[4]), _number(g[2]), _number(g[3]), _clock(g, 5))


def _epoch(g: Sql, year: int) -> Sql:
    n = _number(g[2])
    return X.when(n.between(1_000_000_000_000, 4_102_444_800_000), n)


# The last part is what the layout can't do without.
_WAYS = (
    (ISO, 8, _iso, ("-", ":")), (ACCESS, 7, _access, ("/", ":")), (SYSLOG, 5, _syslog, (":",)), (YEAR_FIRST, 6, _year_first, ("/", ":")),
    (MONTH_FIRST, 6, _month_first, ("/", ":")), (EPOCH, 1, _epoch, ("12",)),
)


def extract_timestamp(line: Sql, year: int = 2024) -> Sql:
    """struct(ts_ms, raw, start, end) of the first layout, in order of specificity, whose value is a time; else null."""

    def way(text: Sql, pattern: str, count: int, value, needs: tuple[str, ...]) -> Sql:
        def made(g: Sql) -> Sql:
            def hit(ms: Sql) -> Sql:
                at = X.length(g[0])
                return X.when(
                    ms.isNotNull(),
                    X.struct(
                        ms.alias("ts_ms"), strip(g[1]).alias("raw"), (at + X.when(g[1].startswith(" "), 1).otherwise(0)).alias("start"), (at + X.length(g[1])).alias("end"),
                    ).cast(TIME),
                )

            return X.when(g.isNotNull(), X.bind(value(g, year), hit))

        return X.when(holds(text, *needs), X.bind(cut(text, pattern, count), made))

    # Every layout has two digits next to each other.
    return X.bind(line, lambda text: X.when(text.rlike(r"\d\d"), X.coalesce(*(way(text, *w) for w in _WAYS))))

