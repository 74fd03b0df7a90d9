"""A whole report, its sinks, the history and the streaming form."""

from __future__ import annotations

import csv
import json
import os
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_triage import JAVA_LOG
from timberline.functions import text as T
from timberline.functions.sqltext import X
from timberline.operators import history
from timberline.plans import checks, directory, documents, report, views


SHOP = JAVA_LOG + """2024-03-02 08:01:00,000 ERROR [x-1] com.acme.Mail - <b>api_key=notarealkey</b> timed out
2024-03-02 08:01:01,000 WARN [x-1] com.acme.Mail - smtp, the "mail" job took 2500ms
2024-03-02 08:01:02,000 INFO [x-1] com.acme.Web - GET /api/carts/1 -> 503 (1500ms)
2024-03-02 08:01:03,000 INFO [x-1] com.acme.Web - GET /api/carts/2 -> 200 (12ms)
2024-03-02 08:01:04,000 INFO [x-1] com.acme.Web - GET /api/carts/3 -> 404 (15ms)
"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "shop.log").write_text(SHOP)
    (folder / "other.log").write_text("2024-03-02 08:00:00,000 INFO app.Main - all is well\n")
    (folder / "void.log").write_text("")
    return report.triage(spark, str(folder))


@pytest.fixture(scope="module")
def shop(tables):
    """The rows of one file in every table."""
    file_id = tables["formats"].where(F.col("file_id").endswith("shop.log")).first()["file_id"]
    return {name: [r.asDict(recursive=True) for r in df.where(F.col("file_id") == file_id).drop("file_id").collect()] for name, df in tables.items()}


@pytest.fixture(scope="module")
def docs(spark, tables):
    sizes = spark.createDataFrame([(r["file_id"], len(SHOP)) for r in tables["counts"].where(F.col("file_id").endswith("shop.log")).collect()], "file_id string, bytes long")
    from timberline.sources.shared import pin

    return pin(documents.documents(tables, sizes, at_ms=5))


def test_report(tables, shop):
    assert tables["counts"].count() == 2  # the empty file gives no rows
    status = {c["id"]: c["status"] for c in shop["checks"]}
    assert len(shop["checks"]) == len(status) == 53
    assert status["secret-exposure"] == "fail" and status["error-rate"] == "fail" and status["fatal-lines"] == "pass"
    found = {x["id"]: x for x in shop["insights"]}
    assert {"timeouts", "nulls", "http-5xx", "http-4xx", "http-slowest-endpoint", "latency-slowest-endpoint"} <= set(found)
    assert found["http-5xx"]["occurrences"] == 1 and found["latency-slowest-endpoint"]["occurrences"] == 4
    ranks = [{"critical": 3, "warning": 2, "info": 1}[x["severity"]] for x in sorted(shop["insights"], key=lambda x: x["place"])]
    assert ranks == sorted(ranks, reverse=True)
    met = {x["id"]: x for x in shop["problems"]}
    assert {"null-reference", "timeout", "email-delivery", "http-5xx", "http-4xx"} <= set(met)
    assert met["null-reference"]["occurrences"] == 2 and len(met["null-reference"]["issue_ids"]) == 1
    assert met["timeout"]["example"].endswith("timed out")
    todo = sorted(shop["recommendations"], key=lambda x: x["place"])
    assert 1 <= len(todo) <= 8 and [x["kind"] for x in todo][:1] == ["issue"] and "finding" in {x["kind"] for x in todo}
    seconds = shop["time_range"][0]["duration_ms"] / 1000
    assert shop["throughput"][0]["per_second"] == pytest.approx(shop["health"][0]["parsed"] / seconds)


def test_document(docs, shop):
    rows = {r["report"]["fileName"]: r["report"].asDict(recursive=True) for r in docs.collect()}
    assert set(rows) == {"shop.log", "other.log"}
    doc, other = rows["shop.log"], rows["other.log"]
    assert (doc["version"], doc["sizeBytes"], doc["analyzedAt"], doc["format"]) == (1, len(SHOP), 5, "text")
    for name, table, order in (("issues", "issues", "place"), ("insights", "insights", "place"), ("samples", "samples", "line_no"), ("timeline", "timeline", "t"), ("checks", "checks", "place"), ("loggers", "loggers", "place")):
        assert len(doc[name]) == len(shop[table]), name
        assert [x.get("title") or x.get("raw") or x.get("t") or x.get("logger") for x in doc[name]] == [
            x.get("title") or x.get("raw") or x.get("t") or x.get("logger") for x in sorted(shop[table], key=lambda x: x[order])
        ], name
    assert sum(doc["levels"].values()) == doc["parsedLines"] == shop["counts"][0]["parsed_lines"]
    assert doc["latency"]["samples"] == shop["latency"][0]["samples"] and len(doc["latency"]["operations"]) == len(shop["operations"])
    assert doc["http"]["total"] == 3 and doc["http"]["slowest"]["durationMs"] == 1500.0 and doc["timeRange"]["start"] == shop["time_range"][0]["start_ms"]
    named = {p["catalogId"]: p for p in doc["knownProblems"]}
    assert named["null-reference"]["issueIds"] == [i["id"] for i in doc["issues"] if "NullPointer" in i["title"]]
    assert other["http"] is None and other["latency"] is None and other["timeline"] == [] and other["sizeBytes"] is None and len(other["checks"]) == 53
    text = json.loads(docs.where("report.fileName = 'other.log'").select(documents.json_text(F.col("report"))).first()[0])
    assert "http" not in text and text["levels"]["info"] == 1 and list(text)[:3] == ["version", "fileName", "format"]


def test_texts(docs, shop):
    got = {(r["kind"], r["name"]): r["text"] for r in documents.texts(docs).collect()}
    assert len(got) == 10 and {k for k, _ in got} == set(documents.KINDS)
    page = got["html", "shop.report.html"]
    assert "<b>" not in page and "&lt;b&gt;" in page and "<script" not in page and "http-equiv" not in page and "href" not in page
    text = got["markdown", "shop.report.md"]
    for title in ("# Log report: shop.log", "## Latency", "## Findings", "## Order of work", "## Directory matches", "## Checks", "## Issue groups", "## HTTP"):
        assert title in text and f">{title.lstrip('# ').removeprefix('Log report: ')}" in page, title
    assert "## HTTP" not in got["markdown", "other.report.md"] and "2024-03-02 08:00:00.100 UTC" in text
    said = got["summary", "shop.summary.txt"]
    assert "Findings:" in said and "Directory matches:" in said and "health" in said and "HTTP 3 requests, 33.33% 5xx" in said
    rows = list(csv.reader(got["csv", "shop.issues.csv"].splitlines()))
    assert rows[0] == list(documents.CSV_COLUMNS) and all(len(r) == 14 for r in rows) and len(rows) == 1 + len(shop["issues"])
    by_title = {r[3]: dict(zip(rows[0], r)) for r in rows[1:]}
    npe = next(v for k, v in by_title.items() if "NullPointer" in k)
    assert npe["count"] == "2" and npe["top_frame"].startswith("at com.acme.shop.CartService.load") and npe["level"] == "Error" and npe["directory_entry"].startswith("runtime-crash: ")
    quoted = next(v for k, v in by_title.items() if "smtp" in k)
    assert quoted["sample_line"].endswith('smtp, the "mail" job took 2500ms') and quoted["first_seen"] == "2024-03-02T08:01:01.000Z" and quoted["duration_in_file"] == "0ms"
    assert quoted["directory_entry"].count(": ") == 1
    assert json.loads(got["json", "shop.report.json"])["fileName"] == "shop.log"


def test_names(spark):
    names = spark.createDataFrame([("shop.log",), ("a.b.log",), ("plain",), (".log",)], "n string").select(documents.export_name(F.col("n"), "csv").alias("x"))
    assert [r.x for r in names.collect()] == ["shop.issues.csv", "a.b.issues.csv", "plain.issues.csv", "log.issues.csv"]


def test_written_texts(spark, docs, tmp_path):
    documents.write_texts(docs, str(tmp_path / "out"), ("markdown", "summary"))
    files = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "out") for f in fs if f.endswith(".txt")]
    assert len(files) == 4
    want = {(r["kind"], r["name"]): r["text"] for r in documents.texts(docs, ("markdown", "summary")).collect()}
    for path in files:
        kind, _, name = (p.split("=", 1)[1] for p in path.split(os.sep)[-4:-1])
        with open(path) as f:
            assert f.read() == want[kind, name] + "\n"


def test_many_files_at_once_equal_single_runs(spark, tmp_path):
    """Documents of a folder of files are those of each file by itself."""
    import random

    rng = random.Random(2)
    lines = SHOP.splitlines()
    for k in range(25):
        part = tmp_path / "all" / f"d{k}"
        part.mkdir(parents=True)
        (part / f"f {k}+%.log").write_text("\n".join(rng.sample(lines, rng.randrange(1, len(lines)))) + "\n")
    plain = lambda path: {r["file_id"]: json.loads(r["t"]) for r in report.reports(spark, path, at_ms=1).select("file_id", documents.json_text(F.col("report")).alias("t")).collect()}
    whole = plain(str(tmp_path / "all"))
    assert len(whole) == 25 and whole[next(iter(whole))]["fileName"].startswith("f ")
    for k in (7,):
        single = plain(str(tmp_path / "all" / f"d{k}"))
        for file_id, doc in single.items():
            assert whole[file_id] == doc and doc["sizeBytes"] == os.path.getsize(tmp_path / "all" / f"d{k}" / f"f {k}+%.log")


def test_views(tables):
    slices = views.severity_slices(tables["levels"]).where(F.col("file_id").endswith("shop.log")).collect()
    assert sum(r["share"] for r in slices) == pytest.approx(1.0) and all(r["count"] for r in slices)
    assert views.check_counts(tables["checks"]).groupBy("file_id").agg(F.sum("count").alias("n")).where("n <> 53").count() == 0
    assert {r["level"] for r in views.issue_list(tables["issues"], "warn").collect()} == {"warn"}
    assert views.worst_p95(tables["operations"]).first()["worst"] >= 1
    assert max(r["scale"] for r in views.scaled(tables["paths"].withColumn("count", F.col("count").cast("double")), "count").collect()) == 1.0
    assert {views.health_tone(F.lit(x)) is not None for x in (80, 60, 10)} == {True}
    assert {r["status"] for r in views.open_checks(tables["checks"]).collect()} == {"warn", "fail"}
    assert views.problem_lines(tables["problems"]).where(F.col("file_id").endswith("shop.log")).first()["lines"] > 3
    found = history.search_lines(tables["samples"], "TIMED out", "error").collect()
    assert [r["raw"].endswith("timed out") for r in found] == [True] and history.search_lines(tables["samples"], "timed out", "info").count() == 0


def test_sizes_and_spans(spark):
    """Where the forms of lengths and sizes change."""
    spans = {0: ("0ms", "0ms"), 999: ("999ms", "999ms"), 1000: ("1.00s", "1.0s"), 9990: ("9.99s", "10.0s"), 10_000: ("10.0s", "10.0s"), 60_000: ("1m 0s", "1m"), 3_599_000: ("59m 59s", "60m"), 3_600_000: ("1h 0m", "1.0h")}
    rows = spark.createDataFrame([(k,) for k in spans], "n long").select("n", T.format_duration(X.col("n")).alias("a").column, T.view_span(X.col("n")).alias("b").column).collect()
    assert {r["n"]: (r["a"], r["b"]) for r in rows} == spans
    sizes = {0: ("0 B", "0 B"), 1023: ("1023 B", "1023 B"), 1024: ("1.0 KB", "1.0 KB"), 10_240: ("10 KB", "10 KB"), 3 << 20: ("3.0 MB", "3.0 MB"), 5 << 40: ("5.0 TB", "5120 GB"), 7 << 50: ("7168 TB", "7340032 GB")}
    rows = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", T.format_bytes(X.col("n")).alias("a").column, T.view_size(X.col("n")).alias("b").column).collect()
    assert {r["n"]: (r["a"], r["b"]) for r in rows} == sizes


def test_digits_are_those_of_the_double(spark):
    """Against exact decimals: a figure just below the middle isn't rounded up, one in the middle is."""
    values = [k / 1000 for k in range(0, 12_000, 5)] + [0.125, 2.5, 0.5, 1.005, 1.115, 8.345, 99.95, 1e15 + 0.5, 7e-8, 123456.785]
    ways = {f"{kind}{d}": (lambda x, d=d, f=f: f(x, d)) for kind, f in (("s", lambda x, d: T.fixed(X.col("x"), d).column), ("c", lambda x, d: checks.fixed(F.col("x"), d))) for d in (0, 1, 2, 5)}
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").select("x", *(w(None).alias(n) for n, w in ways.items())).collect()
    for r in rows:
        for n in ways:
            want = None if r["x"] is None else format(Decimal(r["x"]).quantize(Decimal(1).scaleb(-int(n[1])), ROUND_HALF_UP), "f")
            assert r[n] == want, (r["x"], n)


def test_directory(spark):
    rules = directory.rules_table(spark)
    assert rules.count() == 102 and directory.category_counts(rules).count() == 19
    assert {r["severity"]: r["n"] for r in rules.groupBy("severity").agg(F.count("*").alias("n")).collect()} == {"critical": 38, "warning": 56, "info": 8}
    told = [(r["reasons"][0], r["fixes"][0]) for r in rules.collect()]
    assert len(set(told)) == 102 and all(len(a) > 20 and len(b) > 20 for a, b in told)  # of its own for each entry
    assert [r["id"] for r in directory.search(rules, "STAMPEDE", severity="warning").collect()] == ["cache-stampede"]
    assert directory.search(rules, "kotlin", category="runtime-crash").count() == 1
    lines = list(csv.reader(r["line"] for r in directory.csv_lines(rules).orderBy("place").collect()))
    assert len(lines) == 103 and lines[0] == list(directory.CSV_COLUMNS) and all(len(r) == len(directory.CSV_COLUMNS) for r in lines)
    assert len(json.loads(directory.to_json(rules))) == 102


def test_known_problems(spark):
    samples = lambda *raw: [(k, r) for k, r in enumerate(raw)]
    issues = [
        ("f", "a", "read timed out", "read timed out", None, 3, samples("read timed out of db-1"), 1),
        ("f", "b", "upstream timeout", "upstream timeout", None, 4, samples("x"), 2),
        ("f", "c", "10:00:12,400 all fine", "all fine", None, 9, samples(), 3),
        ("f", "d", "it failed", "it failed", None, 1, samples('{"err": "KeyError: 7"}'), 4),
        ("g", "a", "fine", None, None, 1, samples(), 1),
    ]
    kinds = "file_id string, signature string, pattern string, title string, exception_type string, count long, samples array<struct<line_no:long,raw:string>>, place int"
    types = spark.createDataFrame([("f", "java.lang.StackOverflowError", 5, 7), ("f", "StackOverflowError", 9, 2), ("f", "TimeoutException", 8, 1)], "file_id string, type string, count long, first_line long")
    got = {r["id"]: r for r in directory.known_problems(spark.createDataFrame(issues, kinds), types).where("file_id = 'f'").collect()}
    assert (got["timeout"]["occurrences"], got["timeout"]["issue_ids"], got["timeout"]["example"]) == (7, ["a", "b"], "read timed out of db-1")
    assert "http-4xx" not in got  # a fraction of a second isn't a status
    assert got["null-reference"]["issue_ids"] == ["d"]  # by its sample
    assert (got["stack-overflow"]["occurrences"], got["stack-overflow"]["issue_ids"]) == (9, [])  # the file's first such type
    # Of equal severity and lines, what issues met comes before what only a type meets, whatever the directory's order.
    tie = spark.createDataFrame([("f", "a", "request timed out", "request timed out", None, 5, samples("x"), 1)], kinds)
    order = directory.known_problems(tie, spark.createDataFrame([("f", "java.lang.NullPointerException", 5, 1)], types.schema)).orderBy("place").collect()
    ranks = [(r["id"], bool(r["issue_ids"])) for r in order if r["severity"] == "critical"]
    assert ("timeout", True) in ranks and ("null-reference", False) in ranks and [m for _, m in ranks] == sorted((m for _, m in ranks), reverse=True)
    empty = spark.createDataFrame([], kinds)
    assert directory.known_problems(empty, types.limit(0)).count() == 0
    # A file's name is text, too, unless that is turned off.
    named = spark.createDataFrame([("/logs/s3-app.log", *issues[4][1:])], kinds)
    assert [r["id"] for r in directory.known_problems(named, types.limit(0)).collect()] == ["object-storage"]
    assert directory.known_problems(named, types.limit(0), with_file_name=False).count() == 0


def test_history(spark):
    cols = "id string, name string, saved_at long, report string"
    old = spark.createDataFrame([("1", "a", 1, "x"), ("2", "b", 2, "y")], cols)
    new = history.upsert(old, spark.createDataFrame([("3", "a", 3, "z")], cols))
    assert [(r.id, r.name) for r in history.listed(new).collect()] == [("3", "a"), ("2", "b")]
    assert history.without(new, "2").count() == 1 and history.get(new, "3").count() == 1 and history.get(new, "x").count() == 0


def test_stored_history(spark, docs, tmp_path):
    store = history.History(spark, str(tmp_path / "h"))
    assert store.entries().count() == 0 and store.size_bytes() == 0
    assert documents.REPORT == docs.schema["report"].dataType.simpleString()
    store.save(docs, at_ms=100)
    names = lambda: {r.name: (r.saved_at, r.form) for r in store.entries().collect()}
    assert names() == {"shop.log": (100, "whole"), "other.log": (100, "whole")}
    store.save(docs.where("report.fileName = 'shop.log'"), at_ms=200)  # the same name takes the place of the older one
    assert names() == {"shop.log": (200, "whole"), "other.log": (100, "whole")}
    one = store.entries().where("name = 'shop.log'").first()
    assert (one.line_count, one.format, one.error_count, one.health_score) == (16, "text", 5, one.report.healthScore)
    assert all(len(i.samples) <= 1 and len(i.frames) <= 8 for i in one.report.issues) and len(one.report.samples) == 12
    whole = store.size_bytes()
    # Room for the newest whole and the other without samples, then for the newest only, then for it without samples.
    sizes = {r.name: (r.w, r.t) for r in history.measured(store.entries()).collect()}
    assert whole == sum(w for w, _ in sizes.values())
    for quota, want in ((whole, {"shop.log": "whole", "other.log": "whole"}), (whole - 1, {"shop.log": "whole", "other.log": "tight"}), (sizes["shop.log"][0], {"shop.log": "whole"}), (sizes["shop.log"][1], {"shop.log": "tight"}), (10, {})):
        fit = history.fitted(store.entries(), quota).collect()
        assert {r.name: r.form for r in fit} == want, quota
        assert all(r.report.samples == [] and all(not i.samples and len(i.frames) <= 5 for i in r.report.issues) for r in fit if r.form == "tight")
    store.delete(one.id)
    assert set(names()) == {"other.log"} and store.get(one.id).count() == 0
    store.clear()
    assert store.entries().count() == 0 and store.table.manifest()[0] == 4


def test_two_writers_of_a_history_both_survive(spark, docs, tmp_path):
    import threading

    parts = [docs.where(F.col("report.fileName") == n) for n in ("shop.log", "other.log")]
    threads = [threading.Thread(target=lambda d=d, k=k: history.History(spark, str(tmp_path / "h")).save(d, at_ms=k)) for k, d in enumerate(parts)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = history.History(spark, str(tmp_path / "h"))
    assert {r.name for r in store.entries().collect()} == {"shop.log", "other.log"} and store.table.versions() == [1, 2]


def test_stream(spark, tmp_path):
    from timberline.streaming.triage import stream_lines, windowed_levels

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(JAVA_LOG)
    counts = windowed_levels(stream_lines(spark, str(tmp_path / "in")), "text")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("levels_now").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["level"]: r["n"] for r in spark.table("levels_now").groupBy("level").agg(F.sum("count").alias("n")).collect()}
    assert got["warn"] == 1 and got["info"] == 2 and got["error"] >= 2
