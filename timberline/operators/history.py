"""A bounded store of reports, in versions, with a bound on its bytes.

An entry holds a document trimmed for storage. Where the store's bytes don't do for all, the newest entries are stored whole,
the next ones without samples (``tight``) as long as there is room, and the rest not at all. Two writers at once both get
their entries in; a reader sees one version whole.

Defined results: rows of one name and time are told apart by their id; a null name is a name of its own; an unknown id
changes and finds nothing; an empty store stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.sources.snapshots import Snapshots

MOST = 30
QUOTA = 5_000_000


def upsert(old: DataFrame, new: DataFrame, most: int = MOST) -> DataFrame:
    """The latest row of each name, of these the ``most`` latest."""
    both = old.unionByName(new)
    latest = both.groupBy("name").agg(F.max_by(F.struct(*both.columns), F.struct("saved_at", "id")).alias("r")).select("r.*")
    return latest.orderBy(F.desc("saved_at"), F.desc("id")).limit(most)


def without(old: DataFrame, id_: str) -> DataFrame:
    return old.where(F.col("id") != id_)


def get(old: DataFrame, id_: str) -> DataFrame:
    return old.where(F.col("id") == id_)


def listed(old: DataFrame) -> DataFrame:
    return old.orderBy(F.desc("saved_at"))


def search_lines(samples: DataFrame, needle: str = "", level: str | None = None, most: int = 300) -> DataFrame:
    """The raw viewer's filter: a severity and a text without regard to case, first rows by line."""
    out = samples.where(F.contains(F.lower("raw"), F.lit(needle.lower())))
    return (out.where(F.col("level") == level) if level else out).orderBy("file_id", "line_no").limit(most)


def trimmed(report: Column, tight: bool = False) -> Column:
    """A document cut to what is stored: 150 lines of 300 characters; 40 issues with one sample and 8 frames of 200
    characters. ``tight`` drops the samples and keeps 20 issues with 5 frames."""
    groups, frames, samples = (20, 5, 0) if tight else (40, 8, 1)
    short = lambda arr, most, chars: F.transform(F.slice(arr, 1, most), lambda x: x.withField("raw", F.substring(x["raw"], 1, chars)))
    # Nothing stays of a list cut to 0, which ``slice`` doesn't take.
    kept = lambda arr, most, chars: short(arr, most, chars) if most else F.filter(arr, lambda x: F.lit(False))
    issue = lambda i: i.withField("samples", kept(i["samples"], samples, 300)).withField("frames", short(i["frames"], frames, 200))
    return report.withField("samples", kept(report["samples"], 0 if tight else 150, 300)).withField("issues", F.transform(F.slice(report["issues"], 1, groups), issue))


def stored_bytes(report: Column) -> Column:
    return F.octet_length(F.to_json(report)).cast("long")


def measured(entries: DataFrame) -> DataFrame:
    """Adds w and t: the bytes of an entry as it is and without samples."""
    return entries.withColumn("w", stored_bytes(F.col("report"))).withColumn("t", stored_bytes(trimmed(F.col("report"), tight=True)))


def fitted(entries: DataFrame, quota: int) -> DataFrame:
    """The entries (at most some dozens) that ``quota`` bytes have room for, with their ``form``: whole or tight."""
    newest = W.orderBy(F.desc("saved_at"), F.desc("id")).rowsBetween(W.unboundedPreceding, 0)
    rows = measured(entries).withColumn("upto", F.sum("w").over(newest)).withColumn("fits", F.col("upto") <= quota)
    taken = F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0))
    rows = rows.withColumn("more", taken + F.sum(F.when(~F.col("fits"), F.col("t")).otherwise(0)).over(newest)).where((F.col("fits")) | (F.col("more") <= quota))
    out = rows.withColumn("form", F.when(F.col("fits"), F.col("form")).otherwise("tight"))
    return out.withColumn("report", F.when(F.col("fits"), F.col("report")).otherwise(trimmed(F.col("report"), tight=True))).drop("w", "t", "upto", "fits", "more")


class History:
    """Entries of the latest reports, one a name, in a folder."""

    def __init__(self, spark: SparkSession, path: str, quota: int = QUOTA, most: int = MOST):
        from timberline.plans.documents import REPORT

        self.quota, self.most = quota, most
        facts = "id string, name string, size_bytes long, line_count long, format string, error_count long, warning_count long, health_score long, saved_at long, form string"
        self.table = Snapshots(spark, path, f"{facts}, report {REPORT}")

    def entries(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def get(self, id_: str) -> DataFrame:
        return get(self.entries(), id_)

    def save(self, docs: DataFrame, at_ms: int) -> int:
        """Stores documents(file_id, report), each in place of the entry of its name; the new version."""
        r = F.col("report")
        new = docs.select(
            F.concat_ws("-", F.lower(F.conv(F.lit(at_ms).cast("string"), 10, 36)), F.substring(F.sha2("file_id", 256), 1, 6)).alias("id"), r["fileName"].alias("name"), r["sizeBytes"].alias("size_bytes"),
            r["lineCount"].alias("line_count"), r["format"].alias("format"), (r["levels"]["error"] + r["levels"]["fatal"]).alias("error_count"), r["levels"]["warn"].alias("warning_count"),
            r["healthScore"].alias("health_score"), F.lit(at_ms).cast("long").alias("saved_at"), F.lit("whole").alias("form"), trimmed(r).alias("report"),
        )
        return self.table.update(lambda old: fitted(upsert(old, new, self.most), self.quota))

    def delete(self, id_: str) -> int:
        return self.table.update(lambda old: without(old, id_))

    def clear(self) -> int:
        return self.table.update(lambda old: old.limit(0))

    def size_bytes(self) -> int:
        """How much the entries hold, in UTF-8."""
        return self.entries().agg(F.coalesce(F.sum(stored_bytes(F.col("report"))), F.lit(0))).first()[0]
