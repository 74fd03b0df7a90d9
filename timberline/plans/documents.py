"""A report as one document a file, and its texts, all made by executors.

The bounded tables of a report (``report.triage``) are put together by file in one shuffle: every table's rows become one
column of a union, which one grouping collects in order. A document thus holds what a single file's report holds, however
many files there are; no list in it grows with the file. Texts (JSON, CSV, Markdown, HTML, summary) are expressions over a
document, one row each, and are written by the tasks that hold them.

Defined results: a file without requests, times or timings has no such part in its document; nulls are left out of JSON.
Cells of Markdown and HTML are escaped. No files give no documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.aggregate import RANK
from timberline.plans import directory
from timberline.plans.checks import fixed, grouped, percent, said, short_ms
from timberline.plans.views import GROUP_LABELS, LAYOUT_LABELS, LEVEL_LABELS, label

KINDS = ("json", "csv", "markdown", "html", "summary")
# How texts are named, and the header of the issues' CSV.
EXTENSIONS = {"json": "report.json", "csv": "issues.csv", "markdown": "report.md", "html": "report.html", "summary": "summary.txt"}
CSV_COLUMNS = (
    "level", "count", "share", "title", "exception_type", "first_line", "last_line", "first_seen", "last_seen", "duration_in_file", "loggers", "top_frame",
    "directory_entry", "sample_line",
)

#: The type of a document.
REPORT = (
    "struct<version:int,fileName:string,sizeBytes:bigint,format:string,formatConfidence:double,formatNotes:array<string>,lineCount:bigint,parsedLines:bigin"
    "t,emptyLines:bigint,unclassifiedLines:bigint,multiLineEntries:bigint,levels:struct<fatal:bigint,error:bigint,warn:bigint,info:bigint,debug:bigint,trac"
    "e:bigint,unknown:bigint>,errorRate:double,warningRate:double,issues:array<struct<id:string,level:string,title:string,pattern:string,count:bigint,share"
    ":double,firstIndex:bigint,lastIndex:bigint,firstSeen:bigint,lastSeen:bigint,loggers:array<string>,exceptionType:string,frames:array<struct<function:st"
    "ring,file:string,line:int,raw:string>>,samples:array<struct<index:bigint,raw:string>>>>,knownProblems:array<struct<catalogId:string,title:string,categ"
    "ory:string,severity:string,occurrences:bigint,issueIds:array<string>,example:string>>,latency:struct<samples:bigint,avg:double,p50:double,p90:double,p"
    "95:double,p99:double,max:double,overBudget:bigint,severe:bigint,overBudgetRate:double,operations:array<struct<name:string,samples:bigint,avg:double,p5"
    "0:double,p90:double,p95:double,p99:double,max:double,overBudget:bigint>>,linesWithoutTiming:bigint,http:struct<samples:bigint,requests:bigint,coverage"
    ":double,p50:double,p95:double,p99:double,max:double>>,checks:array<struct<id:string,group:string,title:string,status:string,detail:string,evidence:str"
    "ing>>,exceptionTypes:array<struct<type:string,count:bigint>>,loggers:array<struct<logger:string,total:bigint,errors:bigint,warnings:bigint>>,sources:a"
    "rray<struct<location:string,count:bigint>>,timeline:array<struct<t:bigint,total:bigint,error:bigint,warn:bigint,info:bigint,other:bigint>>,timeRange:s"
    "truct<start:bigint,end:bigint,durationMs:bigint,outOfOrder:boolean>,http:struct<total:bigint,classes:array<struct<class:string,count:bigint>>,statuses"
    ":array<struct<status:int,count:bigint,errors:bigint>>,paths:array<struct<path:string,count:bigint,errors:bigint,avgDurationMs:double,maxDurationMs:dou"
    "ble>>,errorRate:double,slowest:struct<path:string,durationMs:double,index:bigint,raw:string>>,insights:array<struct<id:string,severity:string,title:st"
    "ring,detail:string,occurrences:bigint,recommendation:string,example:string>>,recommendations:array<string>,samples:array<struct<index:bigint,raw:strin"
    "g,level:string>>,sampledLines:int,throughputPerSecond:double,healthScore:bigint,analyzedAt:bigint>"
)


def file_sizes(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """file_id, bytes, from the listing of the files; their content isn't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_size").alias("bytes"))


def _fields(**names: str) -> Column:
    return F.struct(*(F.col(c).alias(n) for n, c in names.items()))


def documents(t: dict[str, DataFrame], sizes: DataFrame | None = None, at_ms: int | None = None) -> DataFrame:
    """file_id, report: the whole report of each file, nested."""
    lists = {
        "issues": (t["issues"].withColumn("said", F.transform("samples", lambda s: F.struct(s["line_no"].alias("index"), s["raw"].alias("raw")))), "place", _fields(
            id="signature", level="level", title="title", pattern="pattern", count="count", share="share", firstIndex="first_line", lastIndex="last_line", firstSeen="first_seen",
            lastSeen="last_seen", loggers="loggers", exceptionType="exception_type", frames="frames", samples="said",
        )),
        "knownProblems": (t["problems"], "place", _fields(catalogId="id", title="title", category="category", severity="severity", occurrences="occurrences", issueIds="issue_ids", example="example")),
        "checks": (t["checks"], "place", _fields(id="id", group="group", title="title", status="status", detail="detail", evidence="evidence")),
        "exceptionTypes": (t["exceptions"], "place", _fields(type="type", count="count")),
        "loggers": (t["loggers"], "place", _fields(logger="logger", total="total", errors="errors", warnings="warnings")),
        "sources": (t["sources"], "place", _fields(location="location", count="count")),
        "timeline": (t["timeline"], "t", _fields(t="t", total="total", error="error", warn="warn", info="info", other="other")),
        "insights": (t["insights"], "place", _fields(id="id", severity="severity", title="title", detail="detail", occurrences="occurrences", recommendation="advice", example="example")),
        "recommendations": (t["recommendations"], "place", F.struct(F.col("text").alias("text"))),
        "samples": (t["samples"], "line_no", _fields(index="line_no", raw="raw", level="level")),
        "operations": (t["operations"], "place", _fields(name="name", samples="samples", avg="avg", p50="p50", p90="p90", p95="p95", p99="p99", max="max", overBudget="over_budget")),
        "classes": (t["status_classes"], "class", _fields(**{"class": "class", "count": "count"})),
        "statuses": (t["statuses"], "place", _fields(status="status", count="count", errors="errors")),
        "paths": (t["paths"], "place", _fields(path="path", count="count", errors="errors", avgDurationMs="avg_ms", maxDurationMs="max_ms")),
        "levels": (t["levels"], "level", _fields(level="level", count="count")),
    }
    ones = {
        "formats": t["formats"].select("file_id", F.struct("format", "confidence").alias("v")),
        "counts": t["counts"].select("file_id", F.struct("line_count", "parsed_lines", "empty_lines", "unclassified_lines", "multi_line_entries").alias("v")),
        "health": t["health"].select("file_id", F.struct("error_rate", "health_score").alias("v")),
        "latency": t["latency"].select("file_id", F.struct("samples", "avg", "p50", "p90", "p95", "p99", "max", "over_budget", "severe").alias("v")),
        "http": t["http"].select("file_id", F.struct("requests", "error_rate").alias("v")),
        "http_latency": t["http_latency"].where("samples > 0").select("file_id", _fields(samples="samples", requests="requests", coverage="coverage", p50="p50", p95="p95", p99="p99", max="max").alias("v")),
        "slowest": t["slowest"].select("file_id", _fields(path="path", durationMs="duration_ms", index="line_no", raw="raw").alias("v")),
        "range": t["time_range"].select("file_id", _fields(start="start_ms", end="end_ms", durationMs="duration_ms", outOfOrder="out_of_order").alias("v")),
        "rate": t["throughput"].where("per_second is not null").select("file_id", F.struct("per_second").alias("v")),
    }
    if sizes is not None:
        ones["size"] = sizes.join(t["counts"].select("file_id"), "file_id", "left_semi").select("file_id", F.struct("bytes").alias("v"))
    parts = [df.select("file_id", F.struct(F.col(order).alias("o"), v.alias("v")).alias(name)) for name, (df, order, v) in lists.items()]
    parts += [df.select("file_id", F.col("v").alias(name)) for name, df in ones.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    g = rows.groupBy("file_id").agg(*(F.transform(F.array_sort(F.collect_list(name)), lambda x: x["v"]).alias(name) for name in lists), *(F.first(name, True).alias(name) for name in ones))
    counted = lambda x: F.coalesce(F.get(F.filter("levels", lambda v: v["level"] == x), F.lit(0))["count"], F.lit(0))
    parsed = F.greatest(F.col("counts.parsed_lines"), F.lit(1))
    name = F.url_decode(F.replace(F.element_at(F.split("file_id", "/"), -1), F.lit("+"), F.lit("%2B")))
    latency = F.when(F.col("latency").isNotNull(), F.struct(
        *(F.col(f"latency.{c}").alias(c) for c in ("samples", "avg", "p50", "p90", "p95", "p99", "max")), F.col("latency.over_budget").alias("overBudget"), F.col("latency.severe").alias("severe"),
        (F.col("latency.over_budget") / F.col("latency.samples")).alias("overBudgetRate"), "operations", (F.col("counts.parsed_lines") - F.col("latency.samples")).alias("linesWithoutTiming"), F.col("http_latency").alias("http"),
    ))
    http = F.when(F.col("http").isNotNull(), F.struct(F.col("http.requests").alias("total"), "classes", "statuses", "paths", F.col("http.error_rate").alias("errorRate"), "slowest"))
    now = F.unix_millis(F.current_timestamp()) if at_ms is None else F.lit(at_ms).cast("long")
    report = F.struct(
        F.lit(1).alias("version"), name.alias("fileName"), (F.col("size.bytes") if sizes is not None else F.lit(None).cast("long")).alias("sizeBytes"), F.col("formats.format").alias("format"),
        F.col("formats.confidence").alias("formatConfidence"), F.array(said(percent(F.col("formats.confidence"), 0), " of the first lines are of this layout")).alias("formatNotes"),
        F.col("counts.line_count").alias("lineCount"), F.col("counts.parsed_lines").alias("parsedLines"), F.col("counts.empty_lines").alias("emptyLines"),
        F.col("counts.unclassified_lines").alias("unclassifiedLines"), F.col("counts.multi_line_entries").alias("multiLineEntries"), F.struct(*(counted(x).alias(x) for x in RANK)).alias("levels"),
        F.col("health.error_rate").alias("errorRate"), (counted("warn") / parsed).alias("warningRate"), "issues", "knownProblems", latency.alias("latency"), "checks", "exceptionTypes", "loggers", "sources",
        "timeline", F.col("range").alias("timeRange"), http.alias("http"), "insights", F.transform("recommendations", lambda r: r["text"]).alias("recommendations"), "samples",
        F.size("samples").alias("sampledLines"), F.col("rate.per_second").alias("throughputPerSecond"), F.col("health.health_score").alias("healthScore"), now.alias("analyzedAt"),
    )
    return g.where("counts is not null").select("file_id", report.alias("report"))


def _entry(r: Column, issue: Column) -> Column:
    """The directory's entry for an issue: that of the last problem that names it."""
    last = F.try_element_at(F.filter(r["knownProblems"], lambda p: F.array_contains(p["issueIds"], issue)), F.lit(-1))
    return F.when(last.isNotNull(), F.concat_ws(": ", last["category"], last["title"]))


def _cell(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS 'UTC'")


def csv_text(r: Column) -> Column:
    """A header and one line for each issue; lines count from 1."""

    def line(i: Column) -> Column:
        seen = i["firstSeen"].isNotNull() & i["lastSeen"].isNotNull()
        cells = (
            label(i["level"], LEVEL_LABELS), i["count"], fixed(i["share"], 5), i["title"], i["exceptionType"], i["firstIndex"] + 1, i["lastIndex"] + 1, _iso(i["firstSeen"]), _iso(i["lastSeen"]),
            F.when(seen, short_ms((i["lastSeen"] - i["firstSeen"]).cast("double"))), F.array_join(i["loggers"], " | "), F.get(i["frames"], F.lit(0))["raw"], _entry(r, i["id"]),
            F.get(i["samples"], F.lit(0))["raw"],
        )
        return F.concat_ws(",", *(_cell(c) for c in cells))

    return F.concat(F.array_join(F.concat(F.array(F.lit(",".join(CSV_COLUMNS))), F.transform(r["issues"], line)), "\n"), F.lit("\n"))


def _facts(r: Column) -> Column:
    """[[what, value]] of the headline figures."""
    n = r["levels"]
    errors = n["error"] + n["fatal"]
    some = lambda cond, what, value: F.when(cond, F.array(F.lit(what), value))
    always = F.lit(True)
    rng = r["timeRange"]
    return F.array_compact(F.array(
        some(always, "Lines", grouped(r["lineCount"])), some(always, "Layout", said(label(r["format"], LAYOUT_LABELS), " (", percent(r["formatConfidence"], 0), " of the sample)")),
        some(always, "Errors and fatal", said(grouped(errors), " (", percent(r["errorRate"], 2), ")")), some(always, "Warnings", said(grouped(n["warn"]), " (", percent(r["warningRate"], 2), ")")),
        some(always, "Issue groups", F.size(r["issues"]).cast("string")), some(always, "Directory matches", F.size(r["knownProblems"]).cast("string")), some(always, "Health", said(r["healthScore"].cast("string"), "/100")),
        some(rng.isNotNull(), "Time range", said(_stamp(rng["start"]), " to ", _stamp(rng["end"]), " (", short_ms(rng["durationMs"].cast("double")), ")")),
        some(r["throughputPerSecond"].isNotNull(), "Throughput", said(fixed(r["throughputPerSecond"], 1), " lines/s")),
    ))


def _sections(r: Column, issues: int, paths: int) -> list[tuple[Column, list[str], Column]]:
    """(title, header, rows of cells) of the tables that a text shows; a table without rows isn't shown."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    none = F.array().cast("array<array<string>>")
    lat, http = r["latency"], r["http"]
    advice = {k: F.create_map(*(F.lit(x) for c, words in directory.ADVICE.items() for x in (c, words[k]))) for k in (0, 1)}
    timing = lambda x: [short_ms(x[c]) for c in ("p50", "p95", "p99", "max")]
    row = lambda *cells: F.array(*(text(c) for c in cells))
    whole = F.array(row(F.lit("all"), lat["samples"], *timing(lat), said(lat["overBudget"].cast("string"), " (", percent(lat["overBudgetRate"]), ")")))
    each = F.transform(lat["operations"], lambda o: row(o["name"], o["samples"], *timing(o), o["overBudget"]))
    numbered = lambda arr, cells: F.transform(arr, lambda x, k: row(k + 1, *cells(x)))
    shown = lambda v: F.when(v > 0, short_ms(v)).otherwise("-")
    title = lambda t: F.lit(t)
    return [
        (title("Latency"), ["Operation", "Timings", "Median", "p95", "p99", "Max", "Over 1 s"], F.when(lat.isNotNull(), F.concat(whole, each)).otherwise(none)),
        (title("Findings"), ["Severity", "Finding", "Lines", "Detail", "What to do"], F.transform(r["insights"], lambda x: row(x["severity"], F.coalesce(x["title"], x["id"]), x["occurrences"], F.substring(x["detail"], 1, 300), x["recommendation"]))),
        (title("Order of work"), ["", "What"], numbered(r["recommendations"], lambda x: [x])),
        (
            title("Directory matches"), ["Severity", "Problem", "Lines", "Example", "Why", "What to do"],
            F.transform(r["knownProblems"], lambda x: row(x["severity"], said(label(x["category"], directory.CATEGORIES), ": ", x["title"]), x["occurrences"], F.substring(x["example"], 1, 300), F.try_element_at(advice[0], x["catalogId"]), F.try_element_at(advice[1], x["catalogId"]))),
        ),
        (title("Checks"), ["Check", "Group", "Status", "Found", "Example"], F.transform(r["checks"], lambda x: row(x["title"], label(x["group"], GROUP_LABELS), F.upper(x["status"]), x["detail"], F.substring(x["evidence"], 1, 300)))),
        (title("Issue groups"), ["#", "Severity", "Lines", "Title", "Exception"], numbered(F.slice(r["issues"], 1, issues), lambda x: [label(x["level"], LEVEL_LABELS), x["count"], F.substring(x["title"], 1, 140), x["exceptionType"]])),
        (
            F.coalesce(said("HTTP: ", grouped(http["total"]), " requests, ", percent(http["errorRate"], 2), " returned 5xx"), F.lit("HTTP")), ["Path", "Requests", "5xx", "Mean", "Max"],
            F.when(http.isNotNull(), F.transform(F.slice(http["paths"], 1, paths), lambda x: row(x["path"], x["count"], x["errors"], shown(x["avgDurationMs"]), shown(x["maxDurationMs"])))).otherwise(none),
        ),
    ]


def markdown_text(r: Column, issues: int = 25, paths: int = 15) -> Column:
    clean = lambda c: F.replace(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, clean), " | "), F.lit(" |"))
    table = lambda header, rows: F.concat(F.array(*(line(F.array(*map(F.lit, h))) for h in (header, ["---"] * len(header)))), F.transform(rows, line))
    out = F.concat(F.array(said("# Log report: ", r["fileName"]), F.lit("")), table(["What", "Value"], _facts(r)), F.array(F.lit("")))
    for title, header, rows in _sections(r, issues, paths):
        part = F.concat(F.array(said("## ", title), F.lit("")), table(header, rows), F.array(F.lit("")))
        out = F.concat(out, F.when(F.size(rows) > 0, part).otherwise(F.array().cast("array<string>")))
    return F.array_join(out, "\n")


STYLE = "body{font:15px/1.5 sans-serif;max-width:64rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse;width:100%}th,td{text-align:left;padding:.3rem .5rem;border-bottom:1px solid #ccc;vertical-align:top}"


def html_text(r: Column, issues: int = 30, paths: int = 20) -> Column:
    """A page of its own: no scripts, no links, all text escaped."""

    def safe(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    cells = lambda tag, row: F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(F.lit(f"<{tag}>"), safe(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    table = lambda header, rows: said("<table><thead>", cells("th", F.array(*map(F.lit, header))), "</thead><tbody>\n", F.array_join(F.transform(rows, lambda x: cells("td", x)), "\n"), "\n</tbody></table>\n")
    name = safe(r["fileName"])
    parts = [F.when(F.size(rows) > 0, said("<h2>", safe(title), "</h2>\n", table(header, rows))).otherwise("") for title, header, rows in _sections(r, issues, paths)]
    head = said("<!doctype html>\n<html lang='en'><head><meta charset='utf-8'><title>", name, f"</title><style>{STYLE}</style></head>\n<body><h1>", name, "</h1>\n")
    return F.concat(head, table(["What", "Value"], _facts(r)), *parts, F.lit("</body></html>\n"))


def summary_text(r: Column) -> Column:
    n, lat, http = r["levels"], r["latency"], r["http"]
    some = lambda cond, value: F.when(cond, value)
    found, met = r["insights"], r["knownProblems"]
    lines = F.array_compact(F.array(
        r["fileName"],
        said(grouped(r["lineCount"]), " lines, ", grouped(n["error"] + n["fatal"]), " errors (", percent(r["errorRate"], 2), "), ", grouped(n["warn"]), " warnings, health ", r["healthScore"].cast("string"), "/100"),
        some(lat.isNotNull(), said("Latency p50 ", short_ms(lat["p50"]), ", p95 ", short_ms(lat["p95"]), ", max ", short_ms(lat["max"]), " (", grouped(lat["samples"]), " timings)")),
        some(http.isNotNull(), said("HTTP ", grouped(http["total"]), " requests, ", percent(http["errorRate"], 2), " 5xx")),
        some(F.size(found) > 0, said("Findings:\n", F.array_join(F.transform(F.slice(found, 1, 3), lambda x: said("- ", F.coalesce(x["title"], x["id"]))), "\n"))),
        some(F.size(met) > 0, said("Directory matches: ", F.array_join(F.transform(F.slice(met, 1, 4), lambda x: x["title"]), ", "))),
    ))
    return F.array_join(lines, "\n")


def json_text(r: Column) -> Column:
    return F.to_json(r, {"pretty": "true"})


TEXTS = {"json": json_text, "csv": csv_text, "markdown": markdown_text, "html": html_text, "summary": summary_text}


def export_name(name: Column, kind: str) -> Column:
    """The file's name without its last extension, and the kind's; ``log`` where nothing is left."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat(F.when(stem == "", "log").otherwise(stem), F.lit("." + EXTENSIONS[kind]))


def texts(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """file_id, kind, name, text: one row for each document and kind."""
    r = F.col("report")
    each = F.array(*(F.struct(F.lit(k).alias("kind"), export_name(r["fileName"], k).alias("name"), TEXTS[k](r).alias("text")) for k in kinds))
    return docs.select("file_id", F.explode(each).alias("t")).select("file_id", "t.*")


def write_texts(docs: DataFrame, path: str, kinds: tuple[str, ...] = KINDS) -> None:
    """One file for each document and kind, under ``path/kind=.../source=.../name=...``; ``source`` tells equal names apart."""
    out = texts(docs, kinds).select("kind", F.sha2("file_id", 256).substr(1, 16).alias("source"), "name", "text")
    out.write.partitionBy("kind", "source", "name").option("lineSep", "\n").text(path)
