"""Streams fed in pieces against the same lines as a whole, and tables in versions."""

from __future__ import annotations

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.test_triage import JAVA_LOG, PYTHON_LOG
from timberline.operators import aggregate as A
from timberline.operators.parse import parse_lines
from timberline.operators.stitch import stitch
from timberline.sources.lines import read_lines
from timberline.sources.snapshots import Snapshots
from timberline.streaming import stitch as S


def made_log(seed, count):
    """Entries, traces, indented bodies, headers, blank lines and frames without an entry, in any order."""
    rng = random.Random(seed)
    kinds = ("A", "B", "AB")
    out = []
    for k in range(count):
        at = f"2024-03-02 08:00:{k % 60:02d},{k % 1000:03d}"
        out.append(rng.choice([
            f"{at} ERROR [w-{k % 3}] app.Store - could not load cart {k}", f"{at} INFO [w-1] app.Main - step {k} of many", f"\tat com.acme.C{k % 5}.run(C{k % 5}.java:{k % 9})", f"\tat com.acme.M.go(M.java:{k % 4})",
            f"Caused by: com.acme.{rng.choice(kinds)}Exception: reason {k}", f"com.acme.{rng.choice(kinds)}Exception: lone {k}", "    value = table[key]", "", "   ", f"{at} WARN [w-2] app.Pool - almost full",
        ]))
    return "\n".join(out) + "\n"


LOGS = {"java.log": JAVA_LOG, "python.log": PYTHON_LOG, "orphan.log": "\tat com.acme.X.y(X.java:1)\n    body\nCaused by: a.BException: x\n" + JAVA_LOG, "made.log": made_log(1, 240), "long.log": JAVA_LOG + "\tat com.acme.Deep.er(Deep.java:5)\n" * 260 + "java.lang.RuntimeException: after\n"}


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(query):
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None


def feed(folder, piece, pieces):
    """The piece of every file that is next; cut anywhere, also inside a line."""
    for name, text in LOGS.items():
        data = text.encode()
        cuts = [len(data) * k // pieces for k in range(pieces + 1)]
        with open(folder / name, "ab") as f:
            f.write(data[cuts[piece] : cuts[piece + 1]])


ISSUE_COLUMNS = ["file_id", "signature", "level", "title", "pattern", "count", "share", "first_line", "last_line", "first_seen", "last_seen", "exception_type", "loggers", "frames", "samples", "place"]


def test_a_file_in_pieces_equals_the_whole(rocks, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table, lines_at = str(tmp_path / "issues"), str(tmp_path / "lines")
    for piece in range(3):  # each round starts the queries again from their checkpoints
        feed(folder, piece, 3)
        rows = S.stitched(S.located_lines(rocks, str(folder)), "text")
        query = S.stitched_lines(rows).writeStream.format("parquet").option("path", lines_at).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
        run(query)
        run(S.keep_issues(S.issue_changes(S.stitched(S.located_lines(rocks, str(folder)), "text")), table, str(tmp_path / "c2")))
    want = stitch(parse_lines(read_lines(rocks, str(folder)), layout="text"))
    got = rocks.read.parquet(lines_at).select(want.columns)
    key = lambda r: (r["file_id"], r["line_no"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    issues = {tuple(r) for r in map(tuple_of, A.issues(want).select(ISSUE_COLUMNS).collect())}
    kept = S.issue_table(rocks, table)
    assert {tuple(r) for r in map(tuple_of, S.issues_of(kept).select(ISSUE_COLUMNS).collect())} == issues
    assert S.compact(kept) == 4 and kept.read().count() == len(issues)
    assert {tuple(r) for r in map(tuple_of, S.issues_of(kept).select(ISSUE_COLUMNS).collect())} == issues


def tuple_of(row):
    return [str(v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in row]


def test_traces_are_closed_by_the_next_entry_or_by_time(rocks, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text(JAVA_LOG.split("2024-03-02 08:00:03")[0])  # ends inside the second trace
    rows = S.closed_traces(S.stitched(S.located_lines(rocks, str(folder)), "text", idle_ms=3000))
    query = rows.writeStream.format("memory").queryName("closed_now").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = {r["entry_id"]: len(r["frames"]) for r in rocks.table("closed_now").collect()}
            if len(got) == 2:
                break
        assert got == {2: 3, 7: 1}  # the second one by the timer
    finally:
        query.stop()


def test_parts_of_a_group_are_put_together(spark, tmp_path):
    """A state that was dropped between the pieces: what the table holds of both is one group."""
    entry = lambda n, ts, who, **more: {"rank": 5, "title": "boom", "pattern": "boom", "ts_ms": ts, "who": who, "raw": f"line {n}", **more}
    whole = {"part": None, "count": 0, "loggers": [], "frames": [], "samples": [], "heads": []}
    parts = []
    for lines in ([(3, "entry", entry(3, 10, "a")), (4, "continuation", {"type": "XError"})], [(9, "entry", entry(9, 20, "b", type="YError")), (10, "continuation", {"type": "ZError"}), (12, "entry", entry(12, 30, "a"))]):
        part = {"part": None, "count": 0, "loggers": [], "frames": [], "samples": [], "heads": []}
        for n, role, told in lines:
            frame = '{"function":"f","file":"F.java","line":%d,"raw":"at f"}' % n
            for g in (whole, part):
                S.IssueState.fold(g, n, role, None, frame if role == "continuation" else None, told)
        parts.append(part)
    import json

    def table_of(name, groups):
        table = S.issue_table(spark, str(tmp_path / name))
        table.append(spark.createDataFrame([(g["part"], json.dumps(g), "f", "s", 1) for g in groups], table.schema))
        return [r.asDict(recursive=True) for r in S.issues_of(table).collect()]

    assert table_of("parts", parts) == table_of("whole", [whole])
    got = table_of("again", parts)[0]
    assert (got["count"], got["title"], got["loggers"], got["first_seen"], got["last_seen"], len(got["frames"]), len(got["samples"])) == (3, "ZError: XError: boom", ["a", "b"], 10, 30, 2, 3)


def test_versions(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "id long, v string")
    assert table.read().count() == 0 and table.manifest()[0] == 0
    rows = lambda *ids: spark.createDataFrame([(k, f"v{k}") for k in ids], table.schema)
    assert table.append(rows(1), batch=0) == 1 and table.append(rows(1), batch=0) == 1 and table.append(rows(2), batch=1) == 2
    old = table.read()
    assert table.update(lambda df: df.where("id > 1").union(rows(7))) == 3
    assert {r.id for r in old.collect()} == {1, 2} and {r.id for r in table.read().collect()} == {2, 7}  # a reader keeps its version
    # A writer that dies before its version is there leaves the table as it was.
    table._written(rows(99))
    assert {r.id for r in table.read().collect()} == {2, 7}
    assert table.vacuum() == 3 and {r.id for r in table.read().collect()} == {2, 7}
    # Of two writers that made the same version, one has to begin again.
    assert table._published(4, {"folders": [], "done": 1}) and not table._published(4, {"folders": ["x"], "done": 1})


def test_writers_at_once_all_survive(spark, tmp_path):
    schema = "id long, v string"
    threads = [threading.Thread(target=lambda k=k: Snapshots(spark, str(tmp_path / "t"), schema).update(lambda df: df.union(spark.createDataFrame([(k, "x")], schema)))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = Snapshots(spark, str(tmp_path / "t"), schema)
    assert table.versions() == [1, 2, 3, 4] and {r.id for r in table.read().collect()} == {0, 1, 2, 3}
