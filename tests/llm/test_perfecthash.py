"""Exact deduplication by a minimal perfect hash, against plain grouping."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline.llm import perfecthash


def digest(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return hashlib.sha256(low.encode()).digest()


def many(count, lead="k"):
    return [hashlib.sha256(f"{lead}{k}".encode()).digest() for k in range(count)]


@pytest.mark.parametrize("count", [0, 1, 2, 3, 100, 5000])
def test_hash_is_minimal_and_perfect(count):
    keys = many(count)
    table = perfecthash.PerfectHash.built(b"".join(keys))
    assert sorted(table.slots(b"".join(keys)).tolist()) == list(range(count))
    others = table.slots(b"".join(many(500, "other")))
    assert ((others >= -1) & (others < max(count, 1))).all()
    if count:
        assert (others >= 0).any()  # a stranger falls on a slot, so its bytes have to be looked at


def test_digests_that_differ_in_one_word_only():
    keys = [bytes(24) + k.to_bytes(8, "little") for k in range(300)] + [k.to_bytes(8, "little") + bytes(24) for k in range(1, 300)]
    assert len(set(perfecthash.PerfectHash.built(b"".join(keys)).slots(b"".join(keys)).tolist())) == len(keys)
    with pytest.raises(ValueError):
        perfecthash.PerfectHash.built(keys[1] * 2)


def plain(rows):
    """(doc_id, keep_id, size, sha256) of each row and, for each text, how many rows of the kept id stay."""
    groups = {}
    for k, t in rows:
        groups.setdefault(digest(t), []).append(k)
    keep = {d: max((k for k in ks if k is not None), default=None) for d, ks in groups.items()}
    return Counter((k, keep[digest(t)], len(groups[digest(t)]), digest(t).hex()) for k, t in rows)


@pytest.fixture(scope="module")
def rows():
    out = [(k, f"Text {k % 700}" if k % 3 else "The COMMON text") for k in range(3000)]
    out += [(None, "the common TEXT"), (None, None), (None, ""), (4000, ""), (4001, "É"), (4002, "é"), (4003, "x" * 300_000), (4004, "X" * 300_000), (5, "Text 5"), (5, "text 5"), (5, "other")]
    return out + [(None, "without ids")] * 40


@pytest.mark.parametrize("old", ["true", "false", "doc_id % 2 = 0", "doc_id < 900", "null"])
def test_groups(spark, rows, old, monkeypatch):
    monkeypatch.setattr(perfecthash, "PAGE_KEYS", 64)  # many pages
    monkeypatch.setattr(perfecthash, "HEAVY", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("place", F.lit(1)).withColumn("count", F.lit(2))
    got = perfecthash.exact_duplicates(df, F.expr(old).cast("boolean")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    if old == "doc_id < 900":
        known = {digest(t).hex() for k, t in rows if k is not None and k < 900}
        assert all(r.known == (r.text_sha256 in known) for r in got)


def test_salted_members_all_meet_their_group(spark, rows):
    df = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"t{k}") for k in range(9000)], "doc_id long, text string")
    got = perfecthash.exact_duplicates(df, perfecthash.in_history())  # 3,000 rows of one text, in chunks of 1,000
    assert got.where("text_sha256 = '%s'" % digest("hot").hex()).agg(F.count("*"), F.min("group_size"), F.min("keep_id"), F.count_if("kept")).first()[:] == (3000, 3000, 8997, 1)
    assert got.count() == 9000


def test_one_of_each(spark, rows):
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, count int")
    out = perfecthash.one_of_each(df)
    assert out.columns == ["doc_id", "text", "count"]
    want = {(keep, d) for _, keep, _, d in plain(rows)}
    got = [(r.doc_id, digest(r.text).hex()) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert perfecthash.one_of_each(df.limit(0)).count() == 0
    assert perfecthash.exact_duplicates(df.limit(0), F.lit(True)).count() == 0
