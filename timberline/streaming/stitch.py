"""Stitching and issue groups of unbounded logs, by state.

Lines come with their place in the file (``sources.logsource``). One state a file (``FileState``) numbers them and attaches
continuation lines to their entries, by the rules of ``operators.stitch``: it holds the next number, the last sure entry,
frame and entry, the open entry's fingerprint and its last 200 frames. One state a file and fingerprint (``IssueState``)
folds those lines into an issue group, and every batch gives the groups that changed, which are appended to a versioned
table (``keep_issues``). With all pieces read, its issues (``issues_of``) are those that ``aggregate.issues`` finds in the
whole file.

Lines travel in packs of consecutive ones. A file's state sees of each pack only the lines from its last sure entry on and
hands every pack the state before it; roles are given, and lines folded into groups, by many tasks, pack by pack. A file
without lines for some time (``idle_ms``) gets its open trace reported (``closed_traces``); lines that come later still
belong to it. With a time to live, the state of an idle fingerprint is dropped; when that comes back it starts a new part of
its group, and parts are put together when the table is read.

Defined results: a null line counts as a blank one; blank lines attach to nothing; repeated lines are lines of their own. No
lines give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from timberline.functions.levels import RANK, rank
from timberline.functions.normalize import PATTERN_CHARS, TITLE_CHARS, title
from timberline.functions.sqltext import X
from timberline.functions.stack import FRAME_TYPE
from timberline.functions.text import truncate
from timberline.operators.aggregate import MOST, in_order, logger_of
from timberline.operators.parse import EXC, HTTP, parse_lines
from timberline.operators.stitch import flagged
from timberline.sources import logsource
from timberline.sources.snapshots import Snapshots

PARSED = (
    f"struct<raw:string,format:string,is_empty:boolean,continuation:boolean,level:string,message:string,ts_ms:bigint,ts_raw:string,logger:string,thread:string,"
    f"http:{HTTP},exc:{EXC},frame:{FRAME_TYPE},normalized:string,signature:string>"
)
TOLD = "struct<rank:int,title:string,pattern:string,type:string,who:string,ts_ms:bigint,raw:string>"
STITCHED = "line_no long, role string, entry_id long, opener string, inherited string, frame string, told string, line string, file_id string, chunk long"
STITCHED_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith(" long") else pa.string()) for c in STITCHED.split(", ")])
SEEN = ("is_empty", "continuation", "maybe_body", "has_frame", "has_exc", "signature", "frame")
PACKED = "file_id string, at long, upto long, lines long, fresh boolean, seen string, data binary"
PACKED_ARROW = pa.schema([("file_id", pa.string()), ("at", pa.int64()), ("upto", pa.int64()), ("lines", pa.int64()), ("fresh", pa.bool_()), ("seen", pa.string()), ("data", pa.binary())])
STARTED = "file_id string, start string, data binary, closed string"
FOLDED = "file_id string, signature string, low long, data string"
FOLDED_ARROW = pa.schema([("file_id", pa.string()), ("signature", pa.string()), ("low", pa.int64()), ("data", pa.string())])
CHANGED = "part long, data string, file_id string, signature string"
GROUP = (
    "struct<count:bigint,first_line:bigint,last_line:bigint,first_seen:bigint,last_seen:bigint,severity:int,title:string,pattern:string,type:string,"
    "loggers:array<string>,frames:array<string>,samples:array<struct<line_no:bigint,raw:string>>,heads:array<string>>"
)
RING, HEADS = 200, 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive lines of a file as one row: the lines themselves, compressed, and what of them the file's state has to see.

    A line that surely begins an entry leaves nothing of what was before, so that is the part from the last such line on.
    """
    for batch in batches:
        files = batch.column("file_id").to_pylist()
        cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            chunk = batch.slice(low, high - low)
            ats, seen = chunk.column("at").to_pylist(), list(zip(*(chunk.column(c).to_pylist() for c in SEEN)))
            sure = next((k for k in range(len(seen) - 1, -1, -1) if not any(seen[k][:3])), None)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, chunk.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(chunk)
            row = {"file_id": files[low], "at": ats[0], "upto": ats[-1], "lines": len(seen), "fresh": sure is not None, "seen": json.dumps(seen[sure or 0 :]), "data": sink.getvalue().to_pybytes()}
            yield pa.RecordBatch.from_pylist([row], schema=PACKED_ARROW)


def roles(s: dict, lines: Iterable[tuple]) -> Iterator[tuple]:
    """(line_no, role, entry_id, opener, inherited, whether the line's frame counts) of the lines behind state ``s``, which moves on; between them, ``closed`` entries."""
    for empty, goes_on, maybe, has_frame, has_exc, signature, frame in lines:
        n = s["next"]
        s["next"] = n + 1
        if empty:
            yield (n, "empty", None, None, None, False)
            continue
        attached = goes_on or (maybe and s["frame"] > s["sure"])
        if not attached:
            if s["lines"]:
                yield closed(s)
            lent = json.dumps(s["frames"]) if has_exc and s["frames"] else None
            s |= {"entry": n, "opener": signature, "frames": [], "lines": 0}
            yield (n, "entry", n, signature, lent, False)
        else:
            if s["entry"] is None and s["orphan"] is None:
                s |= {"orphan": n, "opener": signature}
                role = "orphan"
            else:
                role = "continuation"
            yield (n, role, s["orphan"] if s["entry"] is None else s["entry"], s["opener"], None, has_frame)
            s["lines"] += 1
            if has_frame:
                s["frames"] = [*s["frames"], frame][-RING:]
        if goes_on and has_frame:
            s["frame"] = n
        if not goes_on and not maybe:
            s["sure"] = n


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``STITCHED`` rows of packed lines, each pack with the state before it."""
    for batch in batches:
        for file_id, start, data, end in zip(*(batch.column(c) for c in ("file_id", "start", "data", "closed"))):
            if end.is_valid:
                rows, told, line, chunk = [tuple(json.loads(end.as_py()))], [None], [None], None
            else:
                lines = pa.ipc.open_stream(data.as_buffer()).read_all()
                columns = {c: lines.column(c).to_pylist() for c in (*SEEN, "told", "line")}
                s = json.loads(start.as_py())
                chunk, rows, told, line = s["next"], [], [], []
                for row in roles(s, zip(*(columns[c] for c in SEEN))):
                    k = None if row[0] is None else row[0] - chunk
                    rows.append((*row[:5], columns["frame"][k] if row[5] else None))
                    told.append(None if k is None else columns["told"][k])
                    line.append(None if k is None else columns["line"][k])
            made = [*(zip(*rows)), told, line, [file_id.as_py()] * len(rows), [chunk] * len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(made, STITCHED_ARROW)], schema=STITCHED_ARROW)


class FileState(StatefulProcessor):
    """The state before each pack of a file's lines, as they come."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "data string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.state.get()[0]) if self.state.exists() else {"next": 0, "sure": -1, "frame": -1, "entry": None, "orphan": None, "opener": None, "frames": [], "lines": 0, "timer": None}
        batch = pd.concat(list(rows)).sort_values("at")
        starts, before = [], -1
        for at, upto, lines, fresh, seen in zip(*(batch[c].tolist() for c in ("at", "upto", "lines", "fresh", "seen"))):
            if at <= before:
                raise ValueError(f"the lines of {key[0]} around byte {at} came out of order")
            before = upto
            starts.append(json.dumps(s))
            seen = json.loads(seen)
            if fresh:
                s |= {"next": s["next"] + lines - len(seen), "lines": 0}
            for _ in roles(s, seen):
                pass
        if s["timer"] is not None:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(s["timer"])
        self.state.update((json.dumps(s),))
        yield pd.DataFrame({"file_id": key[0], "start": starts, "data": batch["data"].tolist(), "closed": None})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = json.loads(self.state.get()[0])
        s["timer"] = None
        self.state.update((json.dumps(s),))
        if s["lines"]:
            yield pd.DataFrame({"file_id": [key[0]], "start": [None], "data": [None], "closed": [json.dumps(closed(s))]})

    def close(self) -> None:
        pass


def closed(s: dict) -> tuple:
    """A row that says that an entry has all its lines."""
    return (None, "closed", s["orphan"] if s["entry"] is None else s["entry"], s["opener"], json.dumps(s["frames"]), None)


def titled(text: str, kind: str) -> str:
    text = f"{kind}: {text}"
    return text if len(text) <= TITLE_CHARS else text[: TITLE_CHARS - 1] + "…"


def nothing() -> dict:
    return {"part": None, "count": 0, "loggers": [], "frames": [], "samples": [], "heads": []}


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of each pack of lines."""
    names = ("file_id", "signature", "chunk", "line_no", "role", "inherited", "frame", "told")
    for batch in batches:
        groups: dict = {}
        for file_id, signature, chunk, n, role, lent, frame, told in zip(*(batch.column(c).to_pylist() for c in names)):
            IssueState.fold(groups.setdefault((file_id, signature, chunk), nothing()), n, role, lent, frame, json.loads(told))
        rows = [{"file_id": f, "signature": x, "low": g["part"], "data": json.dumps(g)} for (f, x, _), g in groups.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=FOLDED_ARROW)


class IssueState(StatefulProcessor):
    """A group of equal problems in a file, from the groups of its packs of lines."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("group", "data string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g = json.loads(self.state.get()[0]) if self.state.exists() else nothing()
        for data in pd.concat(list(rows)).sort_values("low")["data"].tolist():
            g = self.joined(g, json.loads(data))
        self.state.update((json.dumps(g),))
        yield pd.DataFrame({"part": [g["part"]], "data": [json.dumps(g, ensure_ascii=False)], "file_id": [key[0]], "signature": [key[1]]})

    @staticmethod
    def joined(g: dict, p: dict) -> dict:
        """The group of the lines of ``g`` and, all behind them, those of ``p``, as ``fold`` makes it of all."""
        own = p.pop("own", [])
        if g["part"] is None:
            return p
        heads = g["heads"]
        for head in p["heads"]:
            if not heads or not heads[-1].startswith(head):
                heads = [*heads, head]
        if g["title"] is None:
            first, put = p.get("plain"), heads
        else:
            first, put = g["title"], p["heads"]
        for head in put if first is not None else ():
            first = first if first.startswith(head) else titled(first, head)
        who = [*g["loggers"], *(x for x in p["loggers"] if x not in g["loggers"])]
        return g | {
            "title": first, "plain": p.get("plain") if g["title"] is None else g.get("plain"), "pattern": p["pattern"] if g["title"] is None else g["pattern"], "heads": heads[-HEADS:],
            "count": g["count"] + p["count"], "last_line": p["last_line"] if p["count"] else g["last_line"], "severity": max(g["severity"], p["severity"]), "type": g["type"] or p["type"],
            "first_seen": p["first_seen"] if g["first_seen"] is None else g["first_seen"], "last_seen": g["last_seen"] if p["last_seen"] is None else p["last_seen"],
            "loggers": who[: MOST["issue_loggers"]], "samples": [*g["samples"], *p["samples"]][: MOST["samples"]], "frames": [*g["frames"], *own][: MOST["frames"]] if g["frames"] else p["frames"],
        }

    @staticmethod
    def fold(g: dict, n: int, role: str, lent: str | None, frame: str | None, told: dict) -> None:
        if g["part"] is None:
            g |= {"part": n, "first_line": n, "last_line": n, "first_seen": None, "last_seen": None, "severity": 0, "title": None, "pattern": None, "type": None}
        kind = told.get("type")
        if role in ("entry", "orphan"):
            if g["title"] is None:
                g |= {"title": told.get("title", ""), "plain": told.get("title", ""), "pattern": told.get("pattern", "")}
                for head in g["heads"]:  # of lines that came before in a part that begins inside a trace
                    g["title"] = g["title"] if g["title"].startswith(head) else titled(g["title"], head)
            g["count"] += 1
            g["last_line"] = n
            level = told.get("rank", 0)
            g["severity"] = max(g["severity"], RANK["error"] if role == "orphan" and level == RANK["unknown"] else level)
            g["type"] = g["type"] or kind
        if role == "entry":
            if told.get("ts_ms") is not None:
                g["last_seen"] = told["ts_ms"]
                g["first_seen"] = told["ts_ms"] if g["first_seen"] is None else g["first_seen"]
            who = told.get("who")
            if who is not None and who not in g["loggers"] and len(g["loggers"]) < MOST["issue_loggers"]:
                g["loggers"].append(who)
            if len(g["samples"]) < MOST["samples"]:
                g["samples"].append({"line_no": n, "raw": told.get("raw", "")})
            if lent and not g["frames"]:
                frames = json.loads(lent)
                g["frames"] = (frames if len(frames) <= 40 else frames[:12] + frames[-6:])[: MOST["frames"]]
        if frame is not None and len(g["frames"]) < MOST["frames"]:
            g["frames"].append(frame)
        if frame is not None and len(g.setdefault("own", [])) < MOST["frames"]:
            g["own"].append(frame)  # without those that an entry was lent
        if role == "continuation" and kind:
            g["type"] = g["type"] or kind
            if not g["heads"] or not g["heads"][-1].startswith(kind):
                g["heads"] = [*g["heads"], kind][-HEADS:]
            if g["title"] is not None and not g["title"].startswith(kind):
                g["title"] = titled(g["title"], kind)

    def close(self) -> None:
        pass


def located_lines(spark: SparkSession, path: str, glob: str | None = None, unterminated: str = "wait", block_bytes: int = 8 << 20) -> DataFrame:
    """A stream of file_id, at (the line's first byte), raw, from files that are added and that grow."""
    logsource.register(spark)
    reader = spark.readStream.format("timberline_lines").option("path", path).option("unterminated", unterminated).option("blockBytes", block_bytes)
    return (reader.option("glob", glob) if glob else reader).load().select("file_id", "at", "raw")


def stitched(lines: DataFrame, layout: str, idle_ms: int = 60_000, year: int = 2024, for_lines: bool = True, for_issues: bool = True) -> DataFrame:
    """lines(file_id, at, raw), a stream -> ``STITCHED`` rows: all lines with number, role and entry, and closed traces.

    Needs the state store of ``STATE_STORE``. A partition has consecutive lines of a file in their order, as ``located_lines``
    gives them. Without ``for_lines`` or ``for_issues`` the rows lack what ``stitched_lines`` or ``issue_changes`` need.
    """
    parsed = parse_lines(lines.withColumnRenamed("at", "line_no"), layout=layout, year=year, requests=for_lines)
    whole = F.struct(*(c for c in parsed.columns if c not in ("file_id", "line_no")))
    parsed = flagged(parsed)
    told = F.struct(
        rank(X.col("level")).column.cast("int").alias("rank"), title(X.col("message"), X.col("exc.type")).alias("title").column, F.substring("normalized", 1, PATTERN_CHARS).alias("pattern"),
        F.col("exc.type").alias("type"), logger_of().alias("who"), "ts_ms", truncate(X.col("raw"), 400).alias("raw").column,
    )
    rows = parsed.select(
        "file_id", F.col("line_no").alias("at"), "is_empty", "continuation", "maybe_body", F.col("frame").isNotNull().alias("has_frame"), F.col("exc").isNotNull().alias("has_exc"), "signature",
        F.to_json("frame").alias("frame"), (F.to_json(told) if for_issues else F.lit(None).cast("string")).alias("told"),
        (F.to_json(whole) if for_lines else F.lit(None).cast("string")).alias("line"),
    )
    started = rows.mapInArrow(packed, PACKED).groupBy("file_id").transformWithStateInPandas(FileState(idle_ms), STARTED, "Append", "ProcessingTime")
    return started.repartition(lines.sparkSession.sparkContext.defaultParallelism).mapInArrow(unpacked, STITCHED)


def stitched_lines(rows: DataFrame) -> DataFrame:
    """The columns of ``operators.stitch.stitch`` from the rows of ``stitched``."""
    out = rows.where("role <> 'closed'").select("file_id", "line_no", F.from_json("line", PARSED).alias("p"), "role", "entry_id").select("file_id", "line_no", "p.*", "role", "entry_id")
    return out.withColumn("level", F.when((F.col("role") == "orphan") & (F.col("level") == "unknown"), "error").otherwise(F.col("level")))


def closed_traces(rows: DataFrame) -> DataFrame:
    """file_id, entry_id, signature, frames (the last 200, as JSON) of entries whose attached lines are all there."""
    return rows.where("role = 'closed'").select("file_id", "entry_id", F.col("opener").alias("signature"), F.from_json("inherited", "array<string>").alias("frames"))


def issue_changes(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``CHANGED`` rows: every batch, the groups that it changed, as they are then."""
    lines = rows.where("role in ('entry', 'orphan', 'continuation')").select("file_id", F.col("opener").alias("signature"), "line_no", "role", "inherited", "frame", "told", "chunk")
    return lines.mapInArrow(folded, FOLDED).groupBy("file_id", "signature").transformWithStateInPandas(IssueState(ttl_ms), CHANGED, "Append", "ProcessingTime")


def issue_table(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, f"{CHANGED}, batch long")


def keep_issues(changes: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the query that appends each batch's changed groups to the table at ``path``; a batch done again adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        issue_table(batch.sparkSession, path).append(rows.select("part", "data", "file_id", "signature", "batch"), batch=number)

    return changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(add).start()


def compact(table: Snapshots) -> int:
    """Only the latest state of each part stays."""
    return table.update(latest)


def latest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("file_id", "signature", "part").agg(F.max_by(F.struct("data", "batch"), "batch").alias("l"))
    return last.select("part", "l.data", "file_id", "signature", "l.batch")


def issues_of(table: Snapshots, most: int = MOST["issues"], version: int | None = None) -> DataFrame:
    """The columns of ``aggregate.issues`` from a table of changes."""
    g = latest(table.read(version)).select("file_id", "signature", "part", F.from_json("data", GROUP).alias("g"))
    g = g.groupBy("file_id", "signature").agg(F.array_sort(F.collect_list(F.struct("part", "g"))).alias("parts"))
    parts, each = F.col("parts"), lambda c: F.flatten(F.transform("parts", lambda p: F.coalesce(p["g"][c], F.array())))
    known = lambda c: F.filter(F.transform("parts", lambda p: p["g"][c]), lambda x: x.isNotNull())
    later = F.flatten(F.transform(F.slice("parts", 2, 1_000_000), lambda p: p["g"]["heads"]))
    put = lambda t, h: X.when(t.startswith(h), t).otherwise(title(t, h))
    g = g.withColumn("later", later).withColumn("first_title", F.get(known("title"), F.lit(0)))
    level = F.element_at(F.map_from_arrays(F.array(*(F.lit(r) for r in RANK.values())), F.array(*(F.lit(x) for x in RANK))), F.array_max(known("severity")))
    g = g.select(
        "file_id", "signature", level.alias("level"), X.aggregate(X.col("later"), X.col("first_title"), put).alias("title").column, F.get(known("pattern"), F.lit(0)).alias("pattern"),
        F.aggregate(known("count"), F.lit(0).cast("long"), lambda a, b: a + b).alias("count"), parts[0]["g"]["first_line"].alias("first_line"), F.array_max(known("last_line")).alias("last_line"),
        F.get(known("first_seen"), F.lit(0)).alias("first_seen"), F.try_element_at(known("last_seen"), F.lit(-1)).alias("last_seen"), F.get(known("type"), F.lit(0)).alias("exception_type"),
        F.slice(F.array_distinct(each("loggers")), 1, MOST["issue_loggers"]).alias("loggers"), F.slice(F.transform(each("frames"), lambda f: F.from_json(f, FRAME_TYPE)), 1, MOST["frames"]).alias("frames"),
        F.slice(each("samples"), 1, MOST["samples"]).alias("samples"), F.array_max(known("severity")).alias("severity"),
    )
    parsed = g.groupBy("file_id").agg(F.sum("count").alias("parsed"))
    return in_order(g.join(parsed, "file_id").withColumn("share", F.col("count") / F.col("parsed")).drop("parsed"), most)
