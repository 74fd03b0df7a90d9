"""Exact deduplication against a minimal perfect hash over the digests of what is already there.

The distinct digests of the old rows are dealt into pages of about ``PAGE_KEYS``; each page gets a minimal perfect hash of its
own: levels of bits, in which a digest that falls on a bit alone takes it, while the others go on to the next level. The
number of bits set before a digest's bit is its slot, so that n digests have the slots 0 to n - 1 and none is empty. A slot
holds the whole digest, how many old rows have it and where the row to keep lies (its id and its row number).

New rows are counted by digest first. A digest that isn't in the index falls on some slot, too, or on none: its bytes are
compared with those of the slot. Equal bytes make the new rows repeats of the slot's group; other digests are groups of
their own. Pages of the index and of the new digests meet by page number: neither is sent whole to any task.

The digest is SHA-256 of the text with A-Z lowered, compared in full. Of equal texts the row with the largest id stays; of
rows with that id and text one stays. The members of a large group meet their group's row in chunks, so that no task
gets them all.

Defined results: null counts as the empty text. Null ids come before all others; a group of null ids only keeps one row and
has a null ``keep_id``. Other columns are ignored. Where nothing is old, all digests are new groups, and conversely; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pin, unpin

#: Digests of a page, about.
PAGE_KEYS = 4096
#: Bits of a level for each digest that reaches it.
SPACE = 1.5
#: A group with more than this share of the rows meets them in chunks; there are at most so many such groups.
HEAVY = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAGE = "page int, keys int, sizes array<int>, bits binary, digests binary, ids array<long>, places array<long>, counts array<long>"
MET = "digest binary, doc_id long, place long, count long, known boolean"


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest falls in a level; every level takes another of the digest's words first and mixes in the next."""
    step = np.uint64(level * 0xBF58476D1CE4E5B9 % 2**64)
    x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(0x9E3779B97F4A7C15) + step)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests: ``sizes`` of the levels and their ``bits``."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits) - 1

    @staticmethod
    def words(digests: bytes) -> np.ndarray:
        return np.frombuffer(digests, "<u8").reshape(-1, 4)

    @classmethod
    def built(cls, digests: bytes) -> PerfectHash:
        words, sizes, levels = cls.words(digests), [], []
        while len(words):
            size = max(16, int(len(words) * SPACE))
            at = _positions(words, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            words = words[~alone[at]]
            if len(sizes) > 500:
                raise ValueError("digests are not distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, digests: bytes) -> np.ndarray:
        """The slot of each digest that was built in; any slot or -1 for another one."""
        words = self.words(digests)
        out, open_, base = np.full(len(words), -1), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = base + _positions(words[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
        return out


def _rows_by_page(batches: Iterator) -> Iterator:
    """(page, columns as lists) of each page of rows sorted by page."""
    page, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        pages = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(pages)) + 1).tolist(), len(pages)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held is not None and pages[a] != page:
                yield page, held
                held = None
            if held is None:
                page, held = int(pages[a]), [[] for _ in columns]
            for whole, part in zip(held, columns):
                whole.extend(part[a:b])
    if held is not None:
        yield page, held


def _built(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for page, (digests, ids, places, counts) in _rows_by_page(batches):
        table = PerfectHash.built(b"".join(digests))
        order = np.empty(len(digests), np.int64)
        order[table.slots(b"".join(digests))] = np.arange(len(digests))
        put = lambda values: [values[k] for k in order]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([page], pa.int32()), pa.array([len(digests)], pa.int32()), pa.array([table.sizes], pa.list_(pa.int32())),
                pa.array([np.packbits(table.bits).tobytes()], pa.binary()), pa.array([b"".join(put(digests))], pa.binary()),
                *(pa.array([put(x)], pa.list_(pa.int64())) for x in (ids, places, counts)),
            ],
            names=["page", "keys", "sizes", "bits", "digests", "ids", "places", "counts"],
        )


def page_of(digest: Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(pages)).cast("int")


def index(groups: DataFrame, pages: int) -> DataFrame:
    """groups(digest, doc_id, place, count) with distinct digests -> one row for each page that has any (``PAGE``)."""
    rows = groups.select(page_of(F.col("digest"), pages).alias("page"), "digest", "doc_id", "place", "count")
    return rows.repartition("page").sortWithinPartitions("page").mapInArrow(_built, PAGE)


def _met(old, new):
    """The groups of a page: those of the index with the new rows that repeat them, and new ones."""
    import pandas as pd

    columns = ["digest", "doc_id", "place", "count", "known"]
    whole = lambda values: [None if v is None or v != v else int(v) for v in values]
    new_rows = list(zip(new["digest"], whole(new["doc_id"]), whole(new["place"]), whole(new["count"])))
    if not len(old):
        return pd.DataFrame([(*r, False) for r in new_rows], columns=columns)
    one = old.iloc[0]
    bits = np.unpackbits(np.frombuffer(one["bits"], np.uint8)).astype(bool)
    sizes = [int(s) for s in one["sizes"]]
    table = PerfectHash(sizes, bits[: sum(sizes)])
    held = [one["digests"][k : k + 32] for k in range(0, 32 * int(one["keys"]), 32)]
    out = [[d, *r, True] for d, r in zip(held, zip(*(whole(one[c]) for c in ("ids", "places", "counts"))))]
    for slot, row in zip(table.slots(b"".join(r[0] for r in new_rows)), new_rows):
        if slot >= 0 and held[slot] == row[0]:  # the whole digest, byte by byte
            group = out[slot]
            group[3] += row[3]
            if rank_of(row[1], row[2]) > rank_of(group[1], group[2]):
                group[1], group[2] = row[1], row[2]
        else:
            out.append([*row, False])
    return pd.DataFrame(out, columns=columns)


def rank_of(doc_id: int | None, place: int) -> tuple:
    """How rows of equal texts are ranked; the highest stays."""
    return (doc_id is not None, doc_id or 0, place)


def meet(pages: DataFrame, new: DataFrame, count: int) -> DataFrame:
    """All groups (``MET``) of an index of ``count`` pages and of new(digest, doc_id, place, count) with distinct digests."""
    new = new.withColumn("page", page_of(F.col("digest"), count))
    return pages.groupBy("page").cogroup(new.groupBy("page")).applyInPandas(_met, MET)


def digest_of(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 with A-Z lowered, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), 256))


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: the row that stays and the number of rows."""
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "place")).alias("last")
    return rows.groupBy("digest").agg(last, F.count("*").alias("count")).select("digest", "last.doc_id", "last.place", "count")


def exact_duplicates(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, known.

    ``old`` tells the rows of the history, whose digests are indexed, from the new ones, which are looked up there; ``known``
    says that the text occurs in the history.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"), F.coalesce(old, F.lit(False)).alias("old"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = pin(rows)  # places are fixed here
    history, fresh = (pin(grouped(rows.where(c))) for c in ("old", "not old"))
    count = max(1, -(-max(history.count(), fresh.count()) // PAGE_KEYS))
    pages = pin(index(history, count), replaces=history)
    groups = pin(meet(pages, fresh, count), replaces=fresh)
    unpin(pages)
    # At most HEAVY groups can each hold more than a HEAVY-th of the rows.
    chunk = max(1000, rows.count() // HEAVY)
    heavy = groups.where(F.col("count") > chunk).select("digest", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    salt = F.coalesce(F.pmod(F.col("place"), F.col("chunks")).cast("int"), F.lit(0))
    rows = rows.join(F.broadcast(heavy), "digest", "left").withColumn("salt", salt).drop("chunks", "old").withColumnRenamed("place", "own")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("count") > chunk, F.ceil(F.col("count") / chunk) - 1).otherwise(0).cast("int"))))
    out = rows.join(groups.withColumnRenamed("doc_id", "keep_id"), ["digest", "salt"])
    return out.select(
        "doc_id", "keep_id", F.col("count").alias("group_size"), (F.col("own") == F.col("place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known",
    )


def in_history(id_col: str = "doc_id") -> Column:
    """Half of the ids, by their hash: what counts as already there where a table doesn't say."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(2)) == 0


def one_of_each(docs: DataFrame, old: Column | None = None) -> DataFrame:
    """The documents that stay, with all their columns. Rows of one id and text become one."""
    kept = exact_duplicates(docs, in_history() if old is None else old).where("kept").select(F.col("doc_id").alias("k_id"), F.unhex("text_sha256").alias("k_digest"))
    rows = docs.withColumn("k_digest", digest_of(F.col("text"))).withColumn("k_id", F.col("doc_id").cast("long")).alias("x")
    same = F.col("x.k_digest").eqNullSafe(F.col("y.k_digest")) & F.col("x.k_id").eqNullSafe(F.col("y.k_id"))
    return rows.join(kept.alias("y"), same, "left_semi").dropDuplicates(["k_id", "k_digest"]).select(docs.columns)


SQL = f"""with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as said from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(said) as text_sha256
from t window g as (partition by said)"""
