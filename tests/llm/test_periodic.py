"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import periodic


def brute_runs(words, least=6, exponent=4):
    """Every period is tried at every place."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            smallest = next(d for d in range(1, q + 1) if all(stretch[k] == stretch[k + d] for k in range(length - d)))
            if length >= max(least, exponent * q) and smallest == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def texts():
    rng = random.Random(5)
    out = ["", None, "  \t\n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "x " + "a b c " * 9 + "a b y", "a\x0bb\x0ca\rb a b a b a b", "a\xa0b c " * 5, "é ü " * 6, "w " * 3000, "x\x1cy " * 8]
    out += ["a a b a a b a a b a a b a", "a b a b c a b a b c a b a b c a b a b c", ("a " * 7 + "b ") * 5]
    out += [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    out += [" ".join(rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    for _ in range(60):  # planted powers between other words
        root = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
        length = rng.randrange(2, 8) * len(root) + rng.randrange(len(root) + 1)
        out.append(" ".join([rng.choice("xyz") for _ in range(5)] + [root[k % len(root)] for k in range(length)] + [rng.choice("xyz") for _ in range(5)]))
    return out


def test_refinement_equals_brute_force():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 3, 5):
        docs = [rng.integers(letters, size=int(rng.integers(0, 70))) for _ in range(150)]
        for least, exponent in ((6, 4), (2, 2), (4, 3)):
            got = periodic.runs_of(docs, least, exponent)
            assert got == [brute_runs(d.tolist(), least, exponent) for d in docs]


def test_classes_are_those_of_equal_factors():
    """Every step's classes and links, on one document with its end mark."""
    rng = np.random.default_rng(9)
    for _ in range(40):
        word = np.append(rng.integers(2, size=40), -1)
        part = periodic.Partition(word, np.zeros(41, np.int64), np.full(41, 40))
        for length in range(1, 12):
            factor = lambda i: tuple(word[i : i + length])
            groups = {}
            for i in range(41):
                groups.setdefault(factor(i), []).append(i)
            assert len({int(c) for c in part.of}) == len(groups)
            for members in groups.values():
                assert len({int(part.of[i]) for i in members}) == 1
                assert [int(part.after[i]) for i in members] == [*members[1:], -1] and [int(part.before[i]) for i in members] == [-1, *members[:-1]]
                c = int(part.of[members[0]])
                assert sorted(part.by_class[part.first[c] : part.first[c] + part.size[c]]) == members
            part.refine()


def test_report(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a b " * 9), (None, None), (7, "a a a a a a a"), (7, "a a a a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("h", F.lit(1)).withColumn("n", F.lit(2))
    want = sorted((brute_row(*r) for r in rows), key=repr)
    for places in (periodic.PLACES, 50):  # few words together: many groups of documents
        monkeypatch.setattr(periodic, "PLACES", places)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in periodic.report(df).collect()), key=repr) == want
    assert periodic.report(df.limit(0)).count() == 0


def test_spans_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "see here buy now buy now buy now buy now end"), (2, "plain text")], "key long, said string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df, id_col="key", text_col="said").collect()}
    assert [tuple(r) for r in got[1].runs] == [(2, 8, 2)] and got[1].collapsed == "see here buy now end"
    assert got[2].runs == [] and got[2].collapsed == "plain text" and got[2].n_words == 2
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, exponent=1)


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    rows = [(k, t) for k, t in enumerate(texts())]
    con.register("documents", spark.createDataFrame(rows, "doc_id long, text string").toPandas())
    assert sorted((tuple(r) for r in con.sql(f"select {', '.join(COLUMNS)} from ({periodic.SQL})").fetchall()), key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
