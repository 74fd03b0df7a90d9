"""Message normalisation and fingerprints: messages that differ in volatile values only become equal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.sqltext import Sql, X

from timberline.functions.text import any_of, flat, truncate

# Ordered replacements, the most specific first; a text without one of the third's characters or words can't match.
REPLACEMENTS = (
    (r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+(?:\.[A-Za-z_$][\w$]*)*Exception|\b[A-Za-z_$][\w$]*Error|\b[A-Za-z_$][\w$]*Exception)\b", "<type>", ("Exception", "Error")),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>", ("-",)),
    (r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s*[+-]\d{4}", "<ts>", ("/",)),
    (r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b", "<ts>", (":",)),
    (r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<time>", (":",)),
    (r"(?i)\b\d+(?:\.\d+)?\s?(?:ms|msec|millis|seconds?|secs?|s|minutes?|min|m)\b", "<duration>", ()),
    (r"(?i)\b\d+(?:\.\d+)?\s?(?:bytes?|kb|mb|gb|tb|kib|mib|gib)\b", "<size>", ("b", "B")),
    (r"\b\d+(?:\.\d+)?%", "<pct>", ("%",)),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>", ("-",)),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<email>", ("@",)),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>", (".",)),
    (r"(?i)\b(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}\b", "<ip>", (":",)),
    (r"(?i)0x[0-9a-f]+", "<hex>", ("0x", "0X")),
    (r"(?i)\b[0-9a-f]{16,}\b", "<hash>", ()),
    (r"\b[A-Za-z0-9+/]{32,}={0,2}\b", "<blob>", ()),
    (r'"(?:[^"\\]|\\.)*"', "<str>", ('"',)),
    (r'"[^"]*"?:', "<key>:", ('"',)),
    (r"'(?:[^'\\]|\\.)*'", "<str>", ("'",)),
    (r"([\w./\\-]+\.\w{1,5}):\d+(?::\d+)?", "<file>:<line>", (":",)),
    (r"(?i)\b(pid|tid|thread|status|code|id|index|offset|port|size|length|bytes|attempt|retry|connection|conn)\b(\s*[=:]\s*)\S+", "$1$2<val>", ("=", ":")),
    (r"\b\d{4,}\b", "<n>", ()),
    (r"(?i)([a-z][a-z0-9+.-]*://[^\s\"']+\?)[^\s\"']*", "$1<query>", ("://",)),
    (r"\b\d+(?:\.\d+)?\b", "<n>", ()),
)
SIGNATURE_CHARS, PATTERN_CHARS, TITLE_CHARS = 220, 240, 120


#: Rules that need a digit, and those that need 16 characters of a hash or of base 64 in a row; by place.
DIGITS, RUNS = (1, 2, 3, 4, 5, 6, 7, 10, 18, 20, 22), (13, 14)


def normalize_message(message: Sql) -> Sql:
    """Volatile values replaced. Rules are skipped where what they need is missing: no rule puts a digit or such a run there."""

    def way(pattern: str, put: str, needs: tuple[str, ...]):
        def replaced(text: Sql) -> Sql:
            new = X.regexp_replace(text, pattern, put)
            return X.when(any_of(text, needs), new).otherwise(text) if needs else new

        return replaced

    def all_of(text: Sql, places) -> Sql:
        for rule in (REPLACEMENTS[k] for k in places):
            text = X.bind(text, way(*rule)) if rule[2] else way(*rule)(text)
        return text

    def gated(text: Sql, digits: Sql) -> Sql:
        k = 0
        while k < len(REPLACEMENTS):
            gate = DIGITS if k in DIGITS else RUNS if k in RUNS else None
            run = [k]
            while gate and run[-1] + 1 in gate:
                run.append(run[-1] + 1)
            if gate is None:
                text = all_of(text, run)
            else:
                met = (lambda t: digits) if gate is DIGITS else (lambda t: t.rlike("[A-Za-z0-9+/]{16}"))
                text = X.bind(text, lambda t, run=run, met=met: X.when(met(t), all_of(t, run)).otherwise(t))
            k = run[-1] + 1
        return text

    return flat(X.bind(message.rlike(r"\d"), lambda digits: gated(message, digits)))


def fnv1a(text: Sql) -> Sql:
    """FNV-1a over the text's UTF-16 units, 32 bits, in base 36."""
    step = lambda h, unit: (h.xor(unit) * 16777619).bits(4294967295)

    def two(h: Sql, code: Sql) -> Sql:
        high = X.shiftright(code - 0x10000, 10) + 0xD800
        return X.when(code < 0x10000, step(h, code)).otherwise(step(step(h, high), code.bits(0x3FF) + 0xDC00))

    def hashed(text: Sql) -> Sql:
        codes = X.transform(X.split(text, ""), lambda c: X.ascii(c).cast("long"))
        plain = X.aggregate(X.split(text, ""), X.lit(2166136261), lambda h, c: step(h, X.ascii(c)))
        value = X.when(X.octet_length(text) == X.char_length(text), plain).otherwise(X.aggregate(codes, X.lit(2166136261), two))
        return X.when(text == "", "ztntfp").otherwise(X.lower(X.conv(value.cast("string"), 10, 36)))

    return X.bind(text, hashed)


def hashed(texts: pd.Series) -> pd.Series:
    """``fnv1a`` of a batch: every different text once, all texts at once unit by unit."""
    codes, different = pd.factorize(texts)
    if not len(different):
        return pd.Series([None] * len(texts), index=texts.index, dtype=object)
    coded = [t.encode("utf-16-le") for t in different]
    sizes = np.array([len(c) // 2 for c in coded])
    units, starts = np.frombuffer(b"".join(coded), "<u2").astype(np.uint32), np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # the longest first, so that those not at their end are a prefix
    left = np.searchsorted(-sizes[order], -np.arange(sizes.max()), "left")
    h, starts = np.full(len(sizes), 2166136261, np.uint32), starts[order]
    for k, n in enumerate(left):
        h[:n] = (h[:n] ^ units[starts[:n] + k]) * np.uint32(16777619)
    named = np.empty(len(sizes) + 1, dtype=object)  # the last is null's
    named[order] = [np.base_repr(x, 36).lower() for x in h]
    return pd.Series(named[codes], index=texts.index)


def signature(level: Sql, normalized: Sql, exception_type: Sql, logger: Sql) -> Sql:
    return fnv1a(signed_text(level, normalized, exception_type, logger))


def signed_text(level: Sql, normalized: Sql, exception_type: Sql, logger: Sql) -> Sql:
    """What a signature is the hash of."""
    scope = X.coalesce(exception_type, logger, "")
    return X.concat_ws("|", level, scope, X.substring(normalized, 1, SIGNATURE_CHARS))


def signature_of(text: Column) -> Column:
    """``fnv1a`` of a column, many rows at a time: few of a log's lines differ in what they are signed by."""
    return F.pandas_udf(hashed, "string")(text)


def title(message: Sql, exception_type: Sql, limit: int = TITLE_CHARS) -> Sql:
    lead = X.when(exception_type.isNull() | (exception_type == ""), "").otherwise(X.concat(exception_type, ": "))
    return truncate(flat(X.concat(lead, message)), limit)
