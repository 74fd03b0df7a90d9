"""Lines, stitching and aggregates on small logs of each layout."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from timberline.functions.sqltext import X
from timberline.operators import aggregate as A
from timberline.operators.parse import parse_lines
from timberline.operators.stitch import stitch
from timberline.sources.lines import detect_format, read_lines

JSON_LOG = """{"timestamp":"2024-03-02T08:00:00.000Z","level":"info","msg":"service ready","logger":"boot"}
{"timestamp":"2024-03-02T08:00:01.000Z","level":"error","msg":"cannot reach shard 17","logger":"store"}
{"timestamp":"2024-03-02T08:00:02.000Z","level":"warn","msg":"queue is long","logger":"queue"}
{"timestamp":"2024-03-02T08:00:03.000Z","level":"error","msg":"cannot reach shard 23","logger":"store"}
"""
JAVA_LOG = """2024-03-02 08:00:00,100 INFO  [main] com.acme.shop.Boot - started
2024-03-02 08:00:01,200 ERROR [http-1] com.acme.shop.CartService - could not load cart 4711
java.lang.NullPointerException: cart is null
\tat com.acme.shop.CartService.load(CartService.java:88)
\tat com.acme.shop.CartController.show(CartController.java:31)
\tat com.acme.shop.Router.dispatch(Router.java:12)
2024-03-02 08:00:02,300 ERROR [http-2] com.acme.shop.CartService - could not load cart 4712
java.lang.NullPointerException: cart is null
\tat com.acme.shop.CartService.load(CartService.java:88)
2024-03-02 08:00:03,400 WARN  [http-2] com.acme.shop.Pool - pool is almost used up
2024-03-02 08:00:04,500 INFO  [main] com.acme.shop.Boot - stopping
"""
ACCESS_LOG = """10.1.1.1 - - [02/Mar/2024:08:00:00 +0000] "GET /api/carts/12 HTTP/1.1" 200 512 "-" "agent"
10.1.1.2 - - [02/Mar/2024:08:00:01 +0000] "GET /api/carts/13 HTTP/1.1" 500 12 "-" "agent"
10.1.1.3 - - [02/Mar/2024:08:00:02 +0000] "POST /api/carts HTTP/1.1" 201 44 "-" "agent"
10.1.1.4 - - [02/Mar/2024:08:00:03 +0000] "GET /api/carts/14 HTTP/1.1" 500 12 "-" "agent"
10.1.1.5 - - [02/Mar/2024:08:00:04 +0000] "GET /missing HTTP/1.1" 404 0 "-" "agent"
10.1.1.6 - - [02/Mar/2024:08:00:05 +0000] "GET /api/carts/15 HTTP/1.1" 200 99 "-" "agent" 0.250 0.200
"""
SYSLOG = """Mar  2 08:00:00 node1 sshd[812]: Failed password for invalid user bob from 10.0.0.9
Mar  2 08:00:01 node1 kernel: Out of memory: killed process 99
Mar  2 08:00:02 node1 cron[77]: job done
"""
PYTHON_LOG = """2024-03-02 08:00:00,000 ERROR worker - job broke
Traceback (most recent call last):
  File "/srv/worker.py", line 41, in run
    value = table[key]
KeyError: 'colour'
2024-03-02 08:00:05,000 INFO worker - next job
"""
FREE = "alpha\nbeta\n\n???\n"


def triage(spark, tmp_path, text, name="app.log"):
    (tmp_path / name).write_text(text)
    lines = read_lines(spark, str(tmp_path))
    formats = detect_format(lines)
    return formats.first()["format"], stitch(parse_lines(lines, formats))


def levels(df):
    return {r["level"]: r["count"] for r in A.level_counts(df).collect() if r["count"]}


def test_json(spark, tmp_path):
    layout, df = triage(spark, tmp_path, JSON_LOG)
    assert layout == "json"
    assert levels(df) == {"info": 1, "error": 2, "warn": 1}
    top = A.issues(df).orderBy("place").first()
    assert (top["count"], top["level"], top["loggers"]) == (2, "error", ["store"])
    assert A.health(A.level_counts(df)).first()["error_rate"] == 0.5


def test_java(spark, tmp_path):
    layout, df = triage(spark, tmp_path, JAVA_LOG)
    counts = A.line_counts(df).first()
    assert layout == "text" and counts["multi_line_entries"] == 2 and levels(df)["error"] == 4
    group = A.issues(df).where(F.col("exception_type").endswith("NullPointerException")).orderBy("place").first()
    assert group["count"] == 2 and len(group["frames"]) >= 3
    assert (group["frames"][0]["file"], group["frames"][0]["line"]) == ("CartService.java", 88)
    assert {r["type"]: r["count"] for r in A.exception_counts(df).collect()} == {"java.lang.NullPointerException": 2}


def test_access(spark, tmp_path):
    layout, df = triage(spark, tmp_path, ACCESS_LOG)
    assert layout == "apache"
    totals = A.http_totals(df).first()
    assert (totals["requests"], totals["errors"]) == (6, 2)
    carts = A.path_stats(df).where("path = '/api/carts/:id'").first()
    assert (carts["count"], carts["errors"], carts["max_ms"]) == (4, 2, 250.0)
    assert {r["class"]: r["count"] for r in A.status_classes(df).collect()} == {"2xx": 3, "4xx": 1, "5xx": 2}
    assert A.slowest_request(df).first()["duration_ms"] == 250.0


def test_syslog(spark, tmp_path):
    layout, df = triage(spark, tmp_path, SYSLOG)
    assert layout == "syslog"
    rows = df.orderBy("line_no").collect()
    assert rows[0]["logger"] is None or "sshd" in rows[0]["raw"]
    assert levels(df)["error"] == 2


def test_python_frames_are_inherited(spark, tmp_path):
    _, df = triage(spark, tmp_path, PYTHON_LOG)
    group = A.issues(df).where("exception_type = 'KeyError'").first()
    assert group["count"] == 1 and group["frames"][0]["file"] == "/srv/worker.py" and group["frames"][0]["line"] == 41


def test_free_text(spark, tmp_path):
    layout, df = triage(spark, tmp_path, FREE)
    counts = A.line_counts(df).first()
    assert layout == "generic"
    assert (counts["line_count"], counts["empty_lines"], counts["parsed_lines"]) == (4, 1, 3)
    assert levels(df) == {"info": 3}


def test_latency(spark, tmp_path):
    rows = [f"2024-03-02 08:00:{k % 60:02d},000 INFO app.orders - GET /api/orders/1 -> 200 ({10 + k}ms)" for k in range(30)]
    rows += [f"2024-03-02 08:01:0{k},000 INFO app.orders - GET /api/reports -> 200 ({ms}ms)" for k, ms in enumerate((1500, 3000))]
    rows += ["2024-03-02 08:02:00,000 WARN app.jobs - Report generation took 30000ms"]
    _, df = triage(spark, tmp_path, "\n".join(rows) + "\n")
    timed = A.durations(df)
    all_of = A.latency_overall(timed).first()
    assert (all_of["samples"], all_of["max"], all_of["over_budget"], all_of["severe"]) == (33, 30000.0, 3, 1)
    assert A.latency_by_operation(timed).orderBy("place").first()["name"] == "Report generation"


@pytest.mark.parametrize(
    "line, at",
    [
        ("2024-05-01T12:34:56.789Z x", 1714566896789),
        ("2024-05-01 12:34:56,123 +02:00 x".replace(" +", "+"), 1714559696123),
        ("[01/May/2024:12:34:56 +0000] x", 1714566896000),
        ("May  1 12:34:56 host x", 1714566896000),
        ("2024/05/01 12:34:56 x", 1714566896000),
        ("05/01/2024 12:34:56 x", 1714566896000),
        ("[1714566896789] x", 1714566896789),
        ("nothing 12 here", None),
    ],
)
def test_timestamps(spark, line, at):
    from timberline.functions.timestamps import extract_timestamp

    assert spark.range(1).select(extract_timestamp(X.lit(line))["ts_ms"].column).first()[0] == at


@pytest.mark.parametrize(
    "line, level",
    [("[ERROR] x", "error"), ("level=warn x", "warn"), ("ERROR: x", "error"), ("WARNING:root:x", "warn"), ("FATAL something broke", "fatal"), ("plain words", None)],
)
def test_levels(spark, line, level):
    from timberline.functions.levels import detect_level

    assert spark.range(1).select(detect_level(X.lit(line))["level"].column).first()[0] == level


def test_normalized_and_fingerprint(spark):
    from timberline.functions.normalize import fnv1a, normalize_message

    row = spark.range(1).select(
        normalize_message(X.lit("user 10.0.0.1 took 35ms on order-88912 at 2024-01-01 10:00:00 x@y.org")).column, fnv1a(X.lit("error||abc")).column
    ).first()
    assert row[0] == "user <ip> took <duration> on order-<n> at <ts> <email>"
    h = 2166136261
    for c in b"error||abc":
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    text = ""
    while h:
        h, r = divmod(h, 36)
        text = digits[r] + text
    assert row[1] == text


def test_stitching_equals_a_sequential_fold(spark):
    """Random line kinds, against a plain fold over the lines."""
    import random

    from timberline.operators import stitch as S

    kinds = {"entry": "2024-01-01 00:00:00 INFO hello", "frame": "\tat a.B.c(B.java:1)", "indented": "    x = 1", "blank": "", "marker": "Caused by: boom"}
    rng = random.Random(3)
    rows, want = [], {}
    for f in range(60):
        open_frames, opened, has = 0, None, False
        for n in range(rng.randint(1, 12)):
            kind = rng.choice(list(kinds))
            rows.append((f"f{f}", n, kinds[kind]))
            if kind == "blank":
                want[f"f{f}", n] = ("empty", None)
                continue
            attached = kind in ("frame", "marker") or (kind == "indented" and has and open_frames > 0)
            if attached and not has:
                has, opened, open_frames = True, n, int(kind == "frame")
                want[f"f{f}", n] = ("orphan", n)
            elif attached:
                open_frames += kind == "frame"
                want[f"f{f}", n] = ("continuation", opened)
            else:
                has, opened, open_frames = True, n, 0
                want[f"f{f}", n] = ("entry", n)
    old, S.CHUNK = S.CHUNK, 5
    try:
        df = S.stitch(parse_lines(spark.createDataFrame(rows, "file_id string, line_no long, raw string"), layout="text"))
        got = {(r["file_id"], r["line_no"]): (r["role"], r["entry_id"]) for r in df.select("file_id", "line_no", "role", "entry_id").collect()}
    finally:
        S.CHUNK = old
    assert got == want


def test_filter_on_typed_lines_is_planned_at_once(spark):
    import time

    lines = spark.createDataFrame([("f", k, "2024-01-01 00:00:00 INFO hello") for k in range(10)], "file_id string, line_no long, raw string")
    typed = parse_lines(lines, layout="text")
    began = time.perf_counter()
    kept = typed.where("not is_empty and not continuation and ts_ms is not null")
    kept._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 5
    assert kept.count() == 10


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_sessions_zone(spark, zone):
    from timberline.functions.text import format_time, stamp, utc_text
    from timberline.functions.timestamps import extract_timestamp

    lines = ("2024-03-10 02:30:00 x", "Mar 10 02:30:00 host x", "2024/03/10 02:30:00 x", "03/10/2024 02:30:00 x", "[10/Mar/2024:04:30:00 +0200] x")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = X.lit(1710037800000)
        got = spark.range(1).select(*(extract_timestamp(X.lit(x))["ts_ms"].column for x in lines), stamp(at).column, utc_text(at).column, format_time(at).column).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert list(got) == [1710037800000] * 5 + ["2024-03-10 02:30:00.000 UTC", "2024-03-10T02:30:00.000Z", "Mar 10 02:30:00"]


@pytest.mark.parametrize(
    "message, ms, name",
    [
        ("job (2h) after 5 ms", 7_200_000.0, None), ("spent 3 hours, 5 ms", 10_800_000.0, None), ("sync took 1,5 s", 1500.0, "sync"),
        ('"nightly load" finished in 4 minutes', 240_000.0, "nightly load"), ("took=812ms op=resize", 812.0, "resize"), ("queue 12 of 40", None, None), ("read block took 0ms", None, None),
    ],
)
def test_durations_in_messages(spark, message, ms, name):
    from timberline.functions.durations import extract_duration

    hit = spark.range(1).select(extract_duration(X.lit(message)).column.alias("d")).first()["d"]
    assert (hit and hit["ms"]) == ms
    if name:
        assert hit["name"] == name


def test_json_fields_by_type(spark, tmp_path):
    rows = [
        '{"logger":5,"path":7,"method":"GET","status":"404","msg":"no"}', '{"level":null,"severity":"ERROR","message":{"a":1},"time":1714566896}',
        '{"level":3,"msg":"m","bytes":"12","error":{"name":"TypeError","message":"x is not a function"},"thread":7,"duration":12.5}',
        '{"stack_trace":["ValueError: bad","  at a"],"ts":1714566896789}', '{"msg":"a","status":0}', '["not an object"]',
    ]
    lines = spark.createDataFrame([("f", k, r) for k, r in enumerate(rows)], "file_id string, line_no long, raw string")
    got = parse_lines(lines, layout="json").orderBy("line_no").collect()
    assert got[0]["logger"] is None and got[0]["http"]["path"] is None and got[0]["http"]["status"] == 404 and got[0]["level"] == "warn"
    assert (got[1]["level"], got[1]["message"], got[1]["ts_ms"], got[1]["ts_raw"]) == ("error", '{"a":1}', 1714566896000, "2024-05-01T12:34:56.000Z")
    assert (got[2]["level"], got[2]["exc"]["type"], got[2]["thread"], got[2]["http"]["bytes"], got[2]["http"]["duration_ms"]) == ("error", "TypeError", "7", None, 12.5)
    assert got[3]["exc"]["type"] == "ValueError" and got[3]["message"] == "ValueError: bad" and got[3]["ts_ms"] == 1714566896789
    assert got[4]["http"]["status"] == 0 and got[4]["level"] == "info" and got[5]["logger"] == "\"not an object\""


def test_frames_of_each_dialect(spark):
    from timberline.functions.stack import FRAME_TYPE, frame_owner, stack_frame

    lines = {
        "at com.acme.Job.run(Job.java:12)": ("com.acme.Job.run", "Job.java", 12, "com.acme.Job"), "at load (/srv/app.js:10:5)": ("load", "/srv/app.js", 10, "load"),
        "at /srv/app.js:3:9": (None, "/srv/app.js", 3, "/srv/app.js"), 'File "/srv/a.py", line 7, in run': ("run", "/srv/a.py", 7, "run"),
        "main.work(0x1f) /srv/main.go:44": ("main.work", "/srv/main.go", 44, "main"), "at Acme.Job.Run() in C:\\src\\Job.cs:line 9": ("Acme.Job.Run", "C:\\src\\Job.cs", 9, "Acme.Job"),
        "from /srv/a.rb:3:in `run'": ("run", "/srv/a.rb", 3, "run"), "at home": None,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string").select("line", stack_frame(X.col("line")).alias("f").column)
    for r in df.select("line", "f", frame_owner(X.col("f")).alias("owner").column).collect():
        want = lines[r["line"]]
        assert (r["f"] is None) == (want is None), r["line"]
        if want:
            assert (r["f"]["function"], r["f"]["file"], r["f"]["line"], r["owner"]) == want


def test_standard_syslog_lines_parse_in_strict_form(spark):
    lines = spark.createDataFrame([("f", k, r) for k, r in enumerate(SYSLOG.splitlines())], "file_id string, line_no long, raw string")
    got = [r["logger"] for r in parse_lines(lines, layout="syslog", syslog_strict=True).orderBy("line_no").collect()]
    assert got == ["sshd", "kernel", "cron"]


def test_odd_lines_and_empty_tables(spark):
    rows = [("f", 0, None), ("f", 1, ""), ("f", 2, "  \t"), ("f", 3, "x" * 20_000), ("f", 4, "a\x1fb"), ("f", 5, "😀 ERROR: caf\u00e9"), ("f", 6, "same"), ("f", 7, "same")]
    lines = spark.createDataFrame(rows, "file_id string, line_no long, raw string").withColumn("level", F.lit(1)).withColumn("message", F.lit("clash"))
    for layout in ("text", "json", "apache", "syslog", "generic"):
        got = parse_lines(lines, layout=layout).orderBy("line_no").collect()
        assert [r["is_empty"] for r in got] == [True, True, True, False, False, False, False, False]
        assert got[4]["message"] == "a b" and got[5]["level"] == "error" and got[6]["signature"] == got[7]["signature"]
    none = stitch(parse_lines(lines.limit(0), layout="text"))
    assert A.issues(none).count() == 0 and A.timeline(none).count() == 0 and A.level_counts(none).count() == 0 and A.latency_overall(A.durations(none)).count() == 0


def test_json_object_as_message_keeps_its_order(spark):
    raw = ['{"level":"info","message":{"zeta":1,"alpha":{"y":2,"b":[3,"x"]}}}', '{"msg":null,"log":["b","a"]}', '{"message":"plain"}', '{"message":7}']
    lines = spark.createDataFrame([("f", k, r) for k, r in enumerate(raw)], "file_id string, line_no long, raw string")
    got = [r["message"] for r in parse_lines(lines, layout="json").orderBy("line_no").collect()]
    assert got == ['{"zeta":1,"alpha":{"y":2,"b":[3,"x"]}}', '["b","a"]', "plain", "7"]


def test_frames_of_a_trace_over_several_chunks(spark, monkeypatch):
    """First and last frames, inheritance and titles are those of a plain fold, however the lines are cut into chunks."""
    from timberline.operators import aggregate, stitch as stitching

    text = ["2024-03-02 08:00:00,000 ERROR app.Deep - it broke"] + [f"\tat com.acme.D.f(D.java:{k})" for k in range(530)] + ["Caused by: a.XException: 1", "Caused by: a.XEx.YException: 2", "Caused by: a.XException: 3"]
    text += ["java.lang.RuntimeException: after", "2024-03-02 08:00:01,000 ERROR app.Deep - it broke", "\tat com.acme.E.g(E.java:9)", "Caused by: a.XException: 4"]
    lines = spark.createDataFrame([("f", k, r) for k, r in enumerate(text)], "file_id string, line_no long, raw string")
    wanted = None
    for chunk in (100_000, 64, 7):
        monkeypatch.setattr(aggregate, "CHUNK", chunk)
        monkeypatch.setattr(stitching, "CHUNK", chunk)
        groups = {g["title"]: g for g in aggregate.issues(stitch(parse_lines(lines, layout="text"))).collect()}
        deep = next(g for t, g in groups.items() if "it broke" in t)
        after = groups["java.lang.RuntimeException: after"]
        assert [f["line"] for f in deep["frames"]] == list(range(24)) and deep["count"] == 2
        assert [f["line"] for f in after["frames"]] == [*range(330, 342), *range(524, 530)]  # of the last 200: the first 12 and the last 6
        assert deep["title"] == "a.XException: a.XEx.YException: a.XException: it broke"
        wanted = wanted or {t: tuple(map(str, g)) for t, g in groups.items()}
        assert {t: tuple(map(str, g)) for t, g in groups.items()} == wanted
