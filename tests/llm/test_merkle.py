"""The Merkle manifest against a plain recursive build."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline.llm import merkle

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """(root, proof of each leaf as a list of (before, behind))"""
    proofs, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % 16 : i - i % 16 + 16]
            proofs[k].append((run[: i % 16], run[i % 16 + 1 :]))
        level, at = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], [i // 16 for i in at]
    return level[0], proofs


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = climb([leaf(*r) for r in groups[s]])
    root, over = climb([trees[s][0] for s in names])
    out = []
    for s, more in zip(names, over):
        for r, own in zip(groups[s], trees[s][1]):
            steps, now = own + more, leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for before, behind in steps:
                now = h(*before, now, *behind)
            out.append((r[0], leaf(*r), trees[s][0], root, h(*(x for a, b in steps for x in a + b)), now, now == root))
    return Counter(out)


@pytest.mark.parametrize("count, sources", [(1, 1), (2, 1), (17, 2), (40, 40), (700, 3), (900, 20)])
def test_manifest(spark, count, sources):
    rows = [(7 * k % 1000 if count < 1000 else k, f"Text {k}" if k % 7 else None, "en" if k % 3 else None, f"s{k % sources}" if k % sources else None, k) for k in range(count)]
    df = spark.createDataFrame(rows, KINDS).withColumn("tree", F.lit("x")).withColumn("idx", F.lit(1)).withColumn("digest", F.lit("y"))
    assert Counter(tuple(r) for r in merkle.report(df.repartition(5)).collect()) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, "A", "en", "a", 1)] * 20 + [(3, "Same", None, "", None)] * 18 + [(3, "Other", None, "", None), (4, "", "é", "-", 0), (6, "X" * 300_000, "en", "=", 1), (-1, None, None, None, None), (0, "ÄA", "en", "ä", 5)]
    got = merkle.report(spark.createDataFrame(rows, KINDS)).collect()
    assert Counter(tuple(r) for r in got) == plain(rows)
    assert any(not r.verified for r in got) and all(r.verified for r in got if r.doc_id is None)
    assert merkle.report(spark.createDataFrame([], KINDS)).count() == 0


def test_partial_parents_wait_for_their_children():
    """Whatever the order in which children arrive, and however they are dealt over tasks, the same nodes come out."""
    import pyarrow as pa

    digests = [h(str(k)) for k in range(300)]
    want, _ = climb(digests)
    schema = ["tree", "n", "level", "idx", "places", "digests", "digest"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string()))], names=schema)

    events = [("t", 300, 1, k // 16, [k % 16], [d], None) for k, d in enumerate(digests)]
    whole = [r for b in merkle._combined([batch(events[::-1])]) for r in b.to_pylist()]
    assert len(whole) == 19 + 2 + 1 and [r["digest"] for r in whole if r["level"] == 3] == [want]
    halves = [r for part in (events[:77], events[77:]) for b in merkle._combined([batch(part)]) for r in b.to_pylist()]
    left = [tuple(r.values()) for r in halves if r["digest"] is None]
    # The parent that the cut runs through and its parent, from both sides, and the root, which waits for one of these.
    assert sorted((r[2], r[3]) for r in left) == [(1, 4), (1, 4), (2, 0), (2, 0), (3, 0)]
    again = [r for b in merkle._combined([batch(left)]) for r in b.to_pylist()]
    assert [r["digest"] for r in again if r["level"] == 3] == [want] and all(r["digest"] for r in again)


def test_other_fields(spark):
    df = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "t", "c")], "doc_id long, source string, body string")
    got = merkle.manifest(df, F.col("doc_id") == 2, {"body": F.lit("changed")}, fields=("doc_id", "body")).orderBy("doc_id").collect()
    assert [r.verified for r in got] == [True, False, True] and got[0].leaf == h("1:11:a") and len({r.root for r in got}) == 1
