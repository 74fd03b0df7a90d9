"""Work that a query repeated or did for nothing: signatures, tables, files of logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions.durations import operation_name
from timberline.functions.normalize import fnv1a, signature_of
from timberline.functions.sqltext import X
from timberline.functions.stack import exception_header, is_continuation
from timberline.functions.text import SPACE, cut, groups, strip
from timberline.functions.timestamps import extract_timestamp
from timberline.operators import aggregate as A
from timberline.operators import stitch as stitching
from timberline.operators.parse import parse_lines
from timberline.operators.stitch import stitch
from timberline.plans import derived as D
from timberline.plans.queries import _parsed
from timberline.plans.report import report_of
from timberline.sources.lines import read_lines
from timberline.sources.shared import pin

SF = "/root/testdata/sf0.001"
LOG = ("\tat a.B.c(B.java:1)", "2024-03-01 10:00:00 ERROR app.Svc - id=4 lost", "Caused by: a.IoException: no", "2024-03-01 10:00:01 INFO app.Svc - took 12 ms", "")


def test_tables_are_made_once_and_only_when_asked_for(spark):
    lines = pin(stitch(parse_lines(spark.createDataFrame([("f", k, x) for k, x in enumerate(LOG)], "file_id string, line_no long, raw string"), signatures=False)))
    t = report_of(lines, spark.createDataFrame([("f", "text", 1.0)], "file_id string, format string, confidence double"))
    assert not t
    assert t["health"].first()["parsed"] == 3 and set(t) == {"health", "levels"} and t["levels"] is t["levels"]


def test_issues_sign_lines_without_signatures_alike(spark):
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(LOG)], "file_id string, line_no long, raw string")
    early, late = (A.issues(stitch(parse_lines(df, signatures=s))).drop("place").orderBy("first_line").collect() for s in (True, False))
    assert early == late and early[0]["first_line"] == 0  # an orphan, whose severity stitching changes


def test_stitched_lines_of_queries_hold_no_signatures(spark):
    assert not {"signature", "normalized"} & set(_parsed(spark, SF, "trace", requests=False).columns)


def test_each_log_is_one_file_in_order(spark, tmp_path):
    rows = spark.range(3000).select((F.when(F.col("id") % 3 == 0, "a").otherwise("b.log")).alias("log"), (3000 - F.col("id")).alias("line_no"), (3000 - F.col("id")).cast("string").alias("raw")).repartition(7)
    D.write_logs(rows, str(tmp_path / "logs"), ["a", "b.log", "none"])
    for name, want in (("a", [n for n in range(1, 3001) if n % 3 == 0]), ("b.log", [n for n in range(1, 3001) if n % 3])):
        (file,) = (tmp_path / "logs" / f"log={name}").glob("part-*")
        assert [int(x) for x in file.read_text().split()] == want
    assert spark.range(1).select(D.log_name(F.lit("file:/x/log=b.log/part-0"))).first()[0] == "b.log"


def test_the_text_behind_a_match_is_left_alone(spark):
    row = spark.createDataFrame([("x 1 \n 2 1\n",)], "t string").select(cut(X.col("t"), r"(?i)\b(\d)\b", 1).column.alias("c"), groups(X.col("t"), r"^(\w)", 1).column.alias("g"))
    assert row.first() == (["x ", "1", "1", " \n 2 1\n"], ["x", " 1 \n 2 1\n"])


def test_bound_texts_are_named_once(spark):
    """What a parser is given as an expression is computed once a line, not once a pattern."""
    given = X.concat(X.col("t"), X.lit("given"))
    for made in (exception_header(given), is_continuation(given, X.lit(None)), extract_timestamp(given), fnv1a(given), strip(given)):
        assert made.text.count("given") == 1
    assert "transform" not in X.bind(X.col("t"), lambda t: t).text


def test_white_space_goes_whatever_stands_at_the_other_end(spark):
    texts = ["a", " a", "a ", " a", "a　", "é", " é ", "", "  ", "\x7f", "a\x1f", "﻿a b\t", None, "日本 ", "😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(X.col("t")).column.alias("s")).collect()
    assert {r.t: r.s for r in rows} == {t: None if t is None else t.strip(SPACE) for t in texts}


def test_bound_values_may_be_null_and_nest(spark):
    twice = X.bind(X.col("t"), lambda t: X.bind(X.concat(t, t), lambda u: X.struct(X.coalesce(t, "none").alias("one"), u.alias("two"))))
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "t string").select(twice.column.alias("x")).collect()
    assert [tuple(r.x) for r in rows] == [("a", "aa"), ("none", None), ("b", "bb")]


def test_operation_names_are_looked_for_where_they_may_stand(spark):
    texts = ["get /a?x=1 done", "forget it [now] (12)", "say 'load all' 3", "widget  x\t7", "pOsT   /b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(operation_name(X.col("t")).column.alias("n")).collect()
    assert [r.n for r in rows] == ["get /a", "forget it", "load all", "widget x n", "pOsT /b"]


def test_texts_hashed_together_are_hashed_alike(spark):
    texts = ["", "a", "info|app.Svc|took <n> ms", "äb\U0001f600|ß", "a", None, "x" * 1000, "\u0000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    rows = df.select(fnv1a(X.col("t")).column.alias("one"), signature_of(F.col("t")).alias("many")).collect()
    assert len({r.one for r in rows}) == 7 and all(r.one == r.many for r in rows)
    assert df.where("t is null").select(signature_of(F.col("t"))).first()[0] is None


def test_lines_that_go_on_nothing_are_stitched_without_a_join(spark, monkeypatch):
    written = []
    monkeypatch.setattr(stitching, "pin", lambda df: written.append(df) or pin(df))
    of = lambda lines: stitch(parse_lines(spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file_id string, line_no long, raw string"), signatures=False))
    alone = of([LOG[1], "", LOG[3]])
    assert len(written) == 1 and [tuple(r) for r in alone.select("line_no", "role", "entry_id").orderBy("line_no").collect()] == [(0, "entry", 0), (1, "empty", None), (2, "entry", 2)]
    traced = of(LOG)
    assert len(written) == 5 and traced.columns == alone.columns and traced.dtypes == alone.dtypes


def test_lines_are_numbered_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\r\ntwo\nthree\r")
    (tmp_path / "b.log").write_text("four\n")
    lines = read_lines(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted((r.line_no, r.raw) for r in lines.collect()) == [(0, "four"), (0, "one"), (1, "two"), (2, "three\r")]
