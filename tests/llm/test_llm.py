"""The corpus operators against brute force, the tokenizers library, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from timberline.llm import embedding, htmltext, minhash, packing, pii, quality, resharding, toxicity, urls, wordbpe
from timberline.llm.common import pin

SF = "/root/testdata/sf0.001"
ODD = ["", None, "  ", "a", "é ä ﬁ ½ 12345 it's I'LL don't", "x\n\n b  c\t d", " lead", "trail ", "İstanbul ΣΟΦΟΣ", "x\x1cy", "<|endoftext|> z", "!!!! ####", "w " * 3000, "日本 🙂"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(ODD)] + [(3, "a", "en", "s", 1), (None, "no id here", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("words", F.lit("x"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(df):
    return df.limit(0)


def test_resharding(spark, docs, odd):
    rows = resharding.assign(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r.size for r in part) for part in by.values()]
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 8
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert resharding.assign(odd).count() == odd.count()
    assert resharding.assign(empty(docs)).count() == 0


def test_flow_moves_the_fewest_bytes():
    cuts = resharding.transfers({0: 50, 1: 10, 2: 30}, [25, 25, 20, 20])
    moved = sum(b - a for s, a, b, j in cuts if s != j)
    assert moved == (50 - 25) + (30 - 20)  # what can't stay
    for j, c in enumerate([25, 25, 20, 20]):
        assert sum(b - a for _, a, b, k in cuts if k == j) == c


def test_rewrite_reads_and_writes_affected_shards_only(spark, docs, tmp_path, odd):
    import shutil

    rows = [(None, "no id", "a"), (None, "no id", "a"), (None, None, "b"), (7, "seven", "c"), (7, "seven", "c"), (7, "other", None)] + [(k % 40, f"text {k} " * (k % 9), "d") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    resharding.store(df, str(tmp_path / "old"), 4)
    moved = resharding.reassign(spark, str(tmp_path / "old"), 6)
    touched = resharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), moved)
    back = spark.read.parquet(str(tmp_path / "new")).collect()
    assert touched == list(range(6)) and Counter((r.doc_id, r.text, r.shard) for r in back) == Counter(rows)
    for j in range(6):
        assert sorted(r._slot for r in back if r._shard == j) == list(range(sum(r._shard == j for r in back)))
    # From there, only shards 1 and 3 have to change: the others' files may even be gone.
    some = spark.createDataFrame([(r._row, r._shard, 3 if r._shard == 1 and r._slot == 0 else r._shard, r._slot) for r in back], "row long, old int, shard int, slot long")
    for j in (0, 2, 4, 5):
        shutil.rmtree(tmp_path / "new" / f"_shard={j}")
    assert resharding.rewrite(spark, str(tmp_path / "new"), str(tmp_path / "newer"), some) == [1, 3]
    assert spark.read.parquet(str(tmp_path / "newer")).count() == sum(r._shard in (1, 3) for r in back)
    assert resharding.rewrite(spark, str(tmp_path / "newer"), str(tmp_path / "none"), some.where("old = shard")) == []


def spread(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return [sizes[j] for j in range(8)]


def test_shards_are_near_equal_whatever_the_ids_and_sizes(spark):
    # 4,000 rows without an id and of one text, and 4,000 others.
    rows = [(None, "the very same text here")] * 4000 + [(k, f"text {k}") for k in range(4000)]
    got = resharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((k, zlib.crc32(t.encode())) for k, t in rows)
    sizes = spread(got)
    assert max(sizes) - min(sizes) <= 30 and all(sorted(r.slot for r in got if r.shard == j) == list(range(sum(r.shard == j for r in got))) for j in range(8))
    # Three copies of a long text: each alone is more than a shard's share; the other five shards share the rest evenly.
    rows = [(k, "x" * 200_000) for k in range(3)] + [(k, f"t{k}") for k in range(3, 20_003)]
    sizes = sorted(spread(resharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert sizes[5:] == [200_001] * 3 and sizes[4] - sizes[0] <= 30
    assert resharding.levelled(10, [0, 7, 3]) == [6, 0, 4] or sum(resharding.levelled(10, [0, 7, 3])) == 10
    for total, taken in ((100, [0, 0, 90]), (5, [10, 10]), (0, [3, 1]), (7, [0, 0, 0]), (11, [5, 1, 1])):
        more = resharding.levelled(total, taken)
        assert sum(more) == total and min(more) >= 0
        filled = [a + b for a, b in zip(taken, more) if b]
        assert not filled or max(filled) - min(filled) <= 1


def test_assignment_moves_the_fewest_bytes(spark, docs):
    """What leaves its shard is what doesn't fit where it is, and what straddles a cut."""
    got = resharding.assign(docs).collect()
    old, total = Counter(), sum(r.size for r in got)
    for r in got:
        old[r.old_shard] += r.size
    must = sum(max(0, b - total / 8) for b in old.values())
    assert must <= sum(r.size for r in got if r.shard != r.old_shard) + total * 0.02
    assert sum(r.size for r in got if r.shard != r.old_shard) <= must + total * 0.05


def test_packing(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        tokenizer = packing._tokenizer(path)
        rows = packing.pack(df, path).collect()
        texts = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in df.collect()}
        seen, bins = Counter(), {}
        for r in rows:
            ids = texts[r.doc_id][r.start : r.start + r.length]
            assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
            seen[r.doc_id] += r.length
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert seen == {k: len(v) for k, v in texts.items()}
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(bins) <= 1.05 * sum(map(len, texts.values())) / 1024 + 2
    assert packing.pack(empty(docs), path).count() == 0


def test_toxicity(spark, docs, odd):
    big = "/root/testdata/sf0.1"
    model = toxicity.learn(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"))
    scored = toxicity.score(spark.read.parquet(f"{big}/documents.parquet"), model)
    rows = scored.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    found = {(p, t): sum(r.predicted == p and r.toxic == t for r in rows) for p in (0, 1) for t in (0, 1)}
    assert len(rows) > 500 and found[1, 1] + found[0, 1] > 50
    # On texts never learned from. The 329 confirmed texts here are few; false alarms are texts with one heavy word start.
    assert found[1, 1] >= 0.85 * (found[1, 1] + found[0, 1])
    assert found[1, 0] <= 0.01 * (found[1, 0] + found[0, 0])
    assert toxicity.score(odd, model).count() == odd.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.learn(docs, empty(labels)).weights == {}
    assert toxicity.score(empty(docs), model).count() == 0


def test_toxicity_is_learned_the_same_twice(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    one = toxicity.learn(docs, labels)
    other = toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert one == other


def test_nnpu_gradient_and_risk():
    """The step against a finite difference of the corrected risk, written out plainly."""
    rng = np.random.default_rng(3)
    xp, xu = rng.integers(0, 2, (40, 5)).astype(float), rng.integers(0, 2, (90, 5)).astype(float)
    w, b = toxicity.fit_nnpu(xp, xu, 0.3, steps=2000, rate=0.01, ridge=0.01)

    def risk(v):
        loss = lambda x, y: np.log1p(np.exp(-y * (x @ v[:-1] + v[-1]))).mean()
        return 0.3 * loss(xp, 1) + max(0.0, loss(xu, -1) - 0.3 * loss(xp, -1)) + 0.005 * (v[:-1] ** 2).sum()

    best, here = np.append(w, b), risk(np.append(w, b))
    assert all(risk(best + s * d) >= here - 1e-4 for d in np.eye(6) for s in (-0.05, 0.05))


def test_quality(spark, docs, odd):
    import duckdb

    con = duckdb.connect()
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        con.register("documents", df.select("doc_id", "text").toPandas())
        want = sorted(map(tuple, con.sql(quality.SQL).fetchall()))
        got = sorted(map(tuple, quality.judge(df).collect()))
        assert got == want
    kept = quality.kept(odd)
    assert kept.columns == odd.columns
    assert quality.judge(empty(docs)).count() == 0 and quality.kept(empty(docs)).count() == 0
    assert {r.doc_id for r in quality.kept(docs).collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}


def test_bpe(spark, docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing._tokenizer(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in wordbpe.encode_decode(df, path).collect():
            ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
            assert r.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))
    assert wordbpe.encode_decode(empty(docs), path).count() == 0


def brute_components(texts):
    sets = {k: set(minhash.shingle_set(t).tolist()) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in ids}, {k: len(v) for k, v in sets.items()}


def test_minhash(spark, docs, odd):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for k in range(60):  # copies of one text with more or fewer changes, and texts that share a passage only
        words = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
        rows.append((100 + k, passage + " " + " ".join(f"y{k}_{j}" for j in range(40))))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (made, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        want, sizes = brute_components({r.doc_id: r.text for r in df.collect()})
        got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
        assert {k: v.component_id for k, v in got.items()} == want
        assert {k: v.n_shingles for k, v in got.items()} == sizes
    assert minhash.near_duplicates(odd).count() == odd.count()
    assert minhash.near_duplicates(empty(docs)).count() == 0
    assert minhash.one_of_each(odd).columns == odd.columns


@pytest.mark.parametrize("crowded", (3, 40))
def test_minhash_compares_all_of_a_crowded_bucket(spark, monkeypatch, crowded):
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(60)]
    texts = {}
    for k in range(60):  # all share a passage, two and two share more
        words = [f"y{k}_{j}" for j in range(35)]
        for side in range(2):
            texts[2 * k + side] = " ".join(passage + words + [f"z{k}_{side}_{j}" for j in range(rng.integers(5, 30))])
    sets = {k: minhash.shingle_set(t) for k, t in texts.items()}
    bands = {k: minhash.minima(s).reshape(minhash.BANDS, minhash.ROWS) for k, s in sets.items()}
    parent, percent = {k: k for k in texts}, 70
    for a in texts:
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if (bands[a] == bands[b]).all(axis=1).any() and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((parent[a], parent[b]))
                parent = {k: x if v == y else v for k, v in parent.items()}
    monkeypatch.setattr(minhash, "LEAD_BANDS", 0)  # the second pass alone has to find them
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent).collect()
    assert 60 < len(set(parent.values())) < 110
    assert {r.doc_id: r.component_id for r in got} == parent


def test_minhash_compares_pairs_of_one_shared_band(spark, monkeypatch):
    percent = 30
    texts = {}
    for k in range(150):
        common = [f"c{k}_{j}" for j in range(50)]
        for side in range(2):
            texts[2 * k + side] = " ".join(common + [f"z{k}_{side}_{j}" for j in range(44)])
    bands = {k: minhash.minima(minhash.shingle_set(t)).reshape(minhash.BANDS, minhash.ROWS) for k, t in texts.items()}
    meet = {k: (bands[k] == bands[k + 1]).all(axis=1).sum() for k in texts if k % 2 == 0}
    monkeypatch.setattr(minhash, "CROWDED", 0)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent).collect()}
    assert 5 < sum(n == 1 for n in meet.values())
    assert got == {k: k - k % 2 if meet[k - k % 2] else k for k in texts}


def test_estimate():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = (np.frombuffer(minhash.pack(minhash.minima(np.unique(x))), np.uint8)[None] for x in (s[:3000], s[1000:]))
    assert abs(minhash.estimate(a, b)[0] - 0.5) < 0.15


def test_parity():
    rng = np.random.default_rng(2)
    for n, common in ((5, 0), (300, 290), (3000, 100), (1, 1)):
        s = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        x, y = s[: len(s) // 2 + common // 2], s[len(s) // 2 - common // 2 :]
        a, b = (np.frombuffer(minhash.parity(v), np.uint8) for v in (x, y))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
        assert not (a ^ a).any()


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(s[::-1])) % 10 == 0

    def ok(kind, v):
        digits = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        return kind == "email" or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15)

    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if ok(k, m[0])]


def test_pii(spark, docs, odd):
    tricky = ["a@b.c_d@e.f a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (454) 555-9913 +12 +1-2-3", "9" * 5000, "é 😀 10.0.0.1"]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), more, odd.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in pii.report(df).collect():
            want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id]))
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:80]
    assert pii.report(empty(docs)).count() == 0
    masked = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert all(not plain_spans(r.text or "") or "[" in r.text for r in masked.values())
    assert pii.masked(odd).columns == odd.columns


def test_pii_discovers_from_contexts(spark):
    rows = [(k, f"please call number +1 (454) 555-{1000 + k} today or not") for k in range(20)]
    rows += [(90, "please call number 555-0199 today or not"), (91, "chapter 555-0199 is long and dull")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[90] == "phone:19:27" and got[91] == ""


def test_pii_contexts_are_judged_by_kind(spark):
    rows = [(k, f"write to us k{k}@mail.example.com please or not") for k in range(40)]
    rows += [(50, "write to us +1 (454) 555-1234 please or not"), (51, "write to us someone(at)mail1.example.com please or not")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[51] == "email:12:40" and got[50] == "phone:12:29"


def test_pii_finds_addresses_with_a_written_at(spark):
    rows = [(k, f"write to us k{k}@mail.example.com please or not") for k in range(40)]
    rows += [(50, "write to us joe(at)mail.com please or not"), (51, "look (at)that please or not")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "email:12:27" and got[51] == ""


def test_pii_masks_repeated_rows_once(spark, monkeypatch):
    rows = [(1, "a b@c.de f")] * 3 + [(1, "x"), (None, "g h@i.kl"), (None, "g h@i.kl"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(7)).withColumn("start", F.lit(0))
    for small in (100_000, 0):  # either way of joining
        monkeypatch.setattr(pii, "SMALL", small)
        got = Counter((r.doc_id, r.text, r.n_chars) for r in pii.masked(df).collect())
        assert got == Counter({(1, "a [email] f", 11): 3, (1, "x", 1): 1, (None, "g [email]", 9): 2, (2, None, 0): 1})


def test_pii_finds_several_words_by_their_form(spark):
    rows = [(k, f"ab{k} +1 (454) 555-{1000 + k} cd{k}" if k % 2 else f"x y +1 (454) 555-{1000 + k} z{k}") for k in range(60)]
    rows += [(90, "some des +1 (826) 555-4081 190.137.223.204 du"), (91, "in 1999 the 300.1.1.1 was 12 of 1234567890123456")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[90] == "ip:27:42,phone:9:26" and got[91] == ""


def test_urls(spark):
    html = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.example.NET/x?q=1#f", None), (2, "https://b.example.net/en/1", ""), (3, "http://example.com/de/7", ""),
        (4, "https://www.site.info/page", html("http://bad.net/p")), (5, "http://site.info/page/?utm_source=feed", ""), (6, None, None),
        (7, "no scheme", ""), (8, "http://q.org/fr/1", html("http://bad.net/z")), (9, "https://q.org/fr/1?x=2", html("http://q.org/fr/1")),
        (10, "http://notnet/", ""), (11, "http://x.net", ""), (12, "http://clean.info/", ""),
    ]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    verdicts = {k: (r.rule, r.verdict) for k, r in out.items()}
    assert verdicts[1] == ("net/", "block") and verdicts[2] == ("example.net/en/", "allow") and verdicts[3] == ("example.com/de/", "block")
    assert verdicts[4] == (None, "block") and verdicts[5] == (None, "block")  # through the canonical link, and its alias
    assert verdicts[6] == (None, "allow") and verdicts[7] == (None, "allow")
    assert verdicts[8] == ("org/fr/", "allow") and verdicts[9] == ("org/fr/", "allow")
    assert verdicts[10] == (None, "allow") and verdicts[11] == (None, "allow") and verdicts[12] == (None, "allow")
    assert (out[1].host, out[1].path) == ("a.example.net", "/x") and (out[11].host, out[11].path) == ("x.net", "")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert urls.judge(empty(pages)).count() == 0


@pytest.mark.parametrize(
    "target, want",
    [
        ("http://x.org/a", "http://x.org/a"), ("//x.org/a", "https://x.org/a"), ("/b?c=1", "https://site.info/b?c=1"), ("?c=2", "https://site.info/dir/page?c=2"),
        ("other", "https://site.info/dir/other"), ("./other", "https://site.info/dir/other"), ("../up/x", "https://site.info/up/x"), ("../../../x", "https://site.info/x"),
        ("a/../b/./c", "https://site.info/dir/b/c"), ("#top", None), ("mailto:a@b.c", None), ("x?y=/../z", "https://site.info/dir/x?y=/../z"),
    ],
)
def test_url_targets_are_resolved(spark, target, want):
    assert spark.range(1).select(urls.resolved(F.lit(target), F.lit("https://site.info/dir/page?q=1#f"))).first()[0] == want


def test_url_links(spark):
    html = """<LINK href='/a?x=1&amp;y=2' REL=canonical><link rel="stylesheet" href="canonical.css"><meta http-equiv="Refresh" content="0; URL='next.html'">
    <meta name="refresh" content="5;url=/no"><link rel="alternate canonical" href=//m.site.info/b>"""
    assert spark.range(1).select(urls.link_targets(F.lit(html))).first()[0] == ["/a?x=1&y=2", "next.html", "//m.site.info/b"]


def plain_key(url):
    """One name for an address, by string methods alone."""
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1].split("#", 1)[0]
    place, _, query = rest.partition("?")
    host, slash, path = place.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    host = host[4:] if host.startswith("www.") else host
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    path = (slash + path).rstrip("/")
    path = path.removesuffix(".html") if path.endswith(".html") else path.removesuffix(".htm")
    path = path.removesuffix("/index").rstrip("/") if path.endswith("/index") else path
    kept = sorted(x for x in query.split("&") if x and not re.match(r"(utm_[a-z]+|gclid|fbclid)(=|$)", x))
    return host + path + "?" + "&".join(kept)


def brute_verdicts(rows, links):
    """page_id -> verdict, by union-find over the addresses; ``links`` has page_id -> absolute targets."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def own(url):
        host, _, path = url.split("://", 1)[1].split("#")[0].split("?")[0].partition("/")
        host, path = host.lower(), "/" + path if _ else ""
        fits = [(len(h) + len(p), what) for what, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    said = {}
    for page, url in rows:
        for u in [url, *links.get(page, [])]:
            if plain_key(u) is not None and plain_key(url) is not None:
                said.setdefault(plain_key(u), set()).add(own(u))
                a, b = root(plain_key(url)), root(plain_key(u))
                parent[max(a, b)] = min(a, b)
    of = {}
    for key, what in said.items():
        of.setdefault(root(key), set()).update(what)
    out = {}
    for page, url in rows:
        key = plain_key(url)
        found = of[root(key)] if key is not None else set()
        out[page] = (own(url) if key is not None else None) or ("block" if "block" in found and "allow" not in found else "allow")
    return out


def test_urls_by_brute_force(spark):
    import random

    rng = random.Random(6)
    hosts = ["a.info", "www.a.info", "A.INFO:80", "b.net", "example.com", "q.org", "c.info", "example.net"]
    make = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/de/', '/fr/', '/en/', '/x'])}{rng.choice(['', '1', '2.html', 'index.html', '3/'])}{rng.choice(['', '?utm_source=z', '?b=1&a=2', '?a=2&b=1', '#t'])}"
    rows = [(k, make() if k % 29 else rng.choice([None, "nowhere"])) for k in range(400)]
    links = {k: [make() for _ in range(rng.choice([0, 0, 0, 1, 2]))] for k, _ in rows}
    pages = [(k, u, "".join(f'<link rel="canonical" href="{t}">' for t in links[k]), "x") for k, u in rows]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string, host string").repartition(3)).collect()
    assert {r.page_id: r.verdict for r in got} == brute_verdicts(rows, links)
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = [(r.page_id, r.url) for r in table.select("page_id", "url").collect()]
    assert {r.page_id: r.verdict for r in urls.judge(table).collect()} == brute_verdicts(plain, {})


def test_components(spark):
    from timberline.llm.components import components

    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (5, 5), (7, None)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>Big &amp; small</h1><p><b>One,
    two.<br>Three.<p>Fo&#117;r, five.</p></article><div id="comments"><p>Nice, very nice.</p></div><footer>&copy; x</footer></body></html>"""
    assert htmltext.main_text(page) == "Big & small\n\nOne, two. Three.\n\nFour, five."
    assert htmltext.main_text(None) == "" and htmltext.main_text("") == "" and htmltext.main_text("<nav>x</nav>") == ""
    assert htmltext.main_text("<div>" * 3000 + "deep text, here." + "</div>" * 3000) == "deep text, here."
    rows = [(1, None, page), (None, "u", None), (1, None, page)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(r.text) for r in got) and len(got) == 3


LONG = "Long text, with marks, goes here; it has more, and more, of them. It goes on, and on."


def test_html_ratio_decides_inside_the_container():
    links = "<ul>" + "".join(f"<li><a href=x>Go there {k}</a></li>" for k in range(4)) + "</ul>"
    for home in ("article", "div", "body"):
        page = f"<body><{home}><h2>Head</h2><p>{LONG}</p>{links}<h3>Next</h3><ol><li>short</li></ol><p>{LONG}</p>{links}<div><div>By us</div></div></{home}></body>"
        assert htmltext.main_text(page) == "\n\n".join(["Head", LONG, "Next", "short", LONG]), home


def test_html_cards_beside_the_story_are_left_out():
    card = "<article><h3>Card {0}</h3><p>Short teaser {0}.</p></article>"
    for home in ("main", "div"):
        page = f"<body><div>Home About</div><{home}><article><h1>Head</h1><p>{LONG}</p><p>{LONG} {LONG}</p></article>{card.format(1)}{card.format(2)}</{home}><div>Buy now</div></body>"
        assert htmltext.main_text(page) == f"Head\n\n{LONG}\n\n{LONG} {LONG}", home
    assert htmltext.main_text(f"<body><div>Home About</div><div><p>{LONG}</p><p>{LONG}</p></div><div>Buy now</div></body>") == f"{LONG}\n\n{LONG}"


def test_html_without_the_ratio_more_is_kept():
    """Ablation: with a threshold of nothing every path is content."""
    links = "<ul>" + "".join(f"<li><a href=x>Go there {k}</a></li>" for k in range(6)) + "</ul>"
    page = f"<body><div>{links}<p>{LONG}</p><p>{LONG}</p></div><div>Buy now</div></body>"
    assert htmltext.main_text(page) == f"{LONG}\n\n{LONG}"
    assert "Go there" in htmltext.main_text(page, threshold=0.0) and "Buy now" in htmltext.main_text(page, threshold=0.0)


def test_html_odd_tables(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", "<p>" + "word, " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in htmltext.extract(pages).collect())
    assert got == [(0, 0), (1, len(LONG)), (1, len(LONG)), (2, 0), (3, 299_999)]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_html_unclosed_elements_end_with_their_parent():
    for tag in ("svg", "iframe", "object", "select", "noscript", "template"):
        assert htmltext.main_text(f"<p>one <{tag} class=i/> two</p><p>three</p>") == "one two\n\nthree", tag
        assert htmltext.main_text(f"<div><p>one <{tag} class=i> gone</p><p>three</p></div>") == "one\n\nthree", tag
        assert htmltext.main_text(f"<p>one <{tag}><title>gone</title><p>gone</{tag}> two<p>three") == "one two\n\nthree", tag


def test_html_names_count_as_a_whole():
    for name in ("layout has-sidebar", "related-work", "side-effects", "legal-aspects", "search-methods"):
        assert htmltext.main_text(f'<body><div class="{name}"><p>{LONG}</p></div></body>') == LONG, name
    assert htmltext.main_text(f'<article><p>{LONG}</p><section class="related"><p>{LONG}</p></section></article>') == f"{LONG}\n\n{LONG}"
    for name in ("site-footer", "ad", "cookie_notice"):
        assert htmltext.main_text(f'<p>{LONG}</p><div class="{name}">{LONG}</div>') == LONG, name
        assert htmltext.main_text(f'<article><p>{LONG}</p><div class="{name}">Buy it</div><p>{LONG}</p></article>') == f"{LONG}\n\n{LONG}", name


def test_html_ends_of_the_article_stay():
    two = f"<p>{LONG}<p>{LONG}"
    ends = {
        "<h2>Steps</h2><ul><li>Mix flour<li>Add water</ul>": ["Steps", "Mix flour", "Add water"], "<table><tr><th>A</th><td>1</td></tr></table>": ["A", "1"], "<pre>x = 1</pre>": ["x = 1"],
        "<figure><img src=a><figcaption>A view</figcaption></figure>": ["A view"], "<blockquote>So be it</blockquote>": ["So be it"], "<dl><dt>K</dt><dd>V</dd></dl>": ["K", "V"],
    }
    for html, said in ends.items():
        for home in ("article", "main", "div"):
            assert htmltext.main_text(f"<body><{home}><h1>T</h1>{two}{html}</{home}></body>") == "\n\n".join(["T", LONG, LONG, *said]), (html, home)
            assert htmltext.main_text(f"<body><{home}>{html}{two}</{home}></body>") == "\n\n".join([*said, LONG, LONG]), (html, home)
    assert htmltext.main_text(f"<article><h1>T</h1><div class=dek>Short lead</div>{two}</article>") == "\n\n".join(["T", "Short lead", LONG, LONG])


def test_html_comments_notices_and_adverts_inside_the_article_go():
    two = f"<p>{LONG}<p>{LONG}"
    reader = f"<p>{LONG} reader.</p>"
    for said in (
        f'<section class="comments">{reader}</section>', f'<div id="comments">{reader * 5}</div>', f'<div class="notice">{LONG}</div>', f'<div class="ad"><p>{LONG}</p></div>',
        f"<section><article>{reader}</article><article>{reader}</article></section>", f'<ol class="comment-list"><li>{LONG} one</li><li>{LONG} two</li></ol>',
    ):
        assert htmltext.main_text(f"<article><h1>T</h1>{two}{said}</article>") == "\n\n".join(["T", LONG, LONG]), said
    for said in (f'<div class="notice">{LONG}</div>', f'<div class="ad"><p>{LONG}</p></div>'):  # in the middle
        assert htmltext.main_text(f"<article><p>{LONG}</p>{said}<p>{LONG}</p></article>") == f"{LONG}\n\n{LONG}", said
    # A name alone doesn't take the story away.
    assert htmltext.main_text(f'<article><div class="notice"><p>{LONG}</p><p>{LONG}</p></div></article>') == f"{LONG}\n\n{LONG}"
    assert htmltext.main_text(f'<article><p>Short.</p><div class="notice"><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p></article>').count(LONG) == 3


def brute_links(rows):
    """vec_id -> (n_links, component_id, kept) by comparing all pairs."""
    usable = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v, y) in enumerate(usable):
        for j, w, z in usable[a + 1 :]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y_ = sorted((root(i), root(j)))
                parent[y_] = x
    return {k: (n, root(k) if k is not None else None, k is None or root(k) == k) for k, n in links.items()}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64))
    rows = []
    for k in range(400):
        v = centres[k % 30] + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14, 0.5])
        rows.append((k, v.astype(np.float32).tolist(), int(k % 30 % 3)))
    rows += [(500, rows[0][1], rows[0][2]), (501, None, 1), (502, [0.0] * 64, 1), (503, [float("nan")] + [1.0] * 63, 1), (504, rows[0][1], None), (505, [None] + [1.0] * 63, 1), (506, [1.0, 2.0], 1)]
    rows += [(507, [2 * c for c in rows[0][1]], rows[0][2]), (508, [1e-30] * 64, 2), (509, [1e-30] * 63 + [1.1e-30], 2), (510, [1.0], 1), (511, [2.0], 1), (512, [], 1), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("key", F.lit(1))
    want = brute_links(rows)
    assert want[508][0] == want[510][0] == 1 and max(n for n, _, _ in want.values()) > 5
    for block, few in ((1024, 24), (7, 2)):  # small blocks: a bucket's members meet as many tiles
        monkeypatch.setattr(embedding, "BLOCK", block)
        monkeypatch.setattr(embedding, "FEW", few)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(df).collect()}
        assert got == want
    wide = df.where("vec_id < 40").withColumn("embedding", F.expr("cast(embedding as array<double>)"))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(wide).collect()} == brute_links(rows[:40])
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 1.0], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(twice).collect())
    assert got == Counter({(1, 0, 1, True): 1, (1, 3, 1, True): 1, (2, 3, 1, False): 1, (3, 3, 1, False): 2})
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall():
    """Pairs at the threshold itself, for every number of hashes that a key may join."""
    rng = np.random.default_rng(4)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 1500, 64)))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    zero = np.zeros(len(a), np.int64)
    for axes in (1, 2, 3, 4, 5):
        x, y = (embedding.bucket_keys(v, zero, axes) for v in (a, b))
        met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() >= 0.999, axes
    assert [embedding.axes_for(n, 64) for n in (1, 50, 5000, 10**6, 10**9)] == [1, 2, 3, 4, 6]


def plain_mask(text, spans):
    """The text with every span (kind, start, end) replaced by its kind; a span across the one before lengthens it."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_pipeline_equals_plain_stages(spark):
    import duckdb

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, tables = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = pin(docs)
        tables[name] = {r.doc_id: r.text for r in docs.collect()}
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    score = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    want = {k: t for k, t in raw.items() if score(t) < 0.3}
    assert tables["toxicity"] == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(want), "text": list(want.values())}))
    fine = {r[0] for r in con.sql(f"select doc_id from ({quality.SQL}) where kept").fetchall()}
    want = {k: t for k, t in want.items() if k in fine}
    assert tables["quality_rules"] == want
    owner, _ = brute_components(want)
    want = {k: t for k, t in want.items() if owner[k] == k}
    assert tables["minhash_near_dedup"] == want
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(want.items()), "doc_id long, text string")).collect()}
    read_spans = lambda x: [(int(b), int(c), a) for a, b, c in (y.split(":") for y in x.split(",") if y)]
    want = {k: plain_mask(t, read_spans(spans[k])) for k, t in want.items()}
    assert tables["pii"] == want
    tokenizer, length = packing._tokenizer(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in stages["best_fit_packing"](spark, docs, SF).collect():
        ids = (tokenizer.encode(want[r.doc_id] or "", add_special_tokens=False).ids + [2])[r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        length[r.doc_id] += r.length
    assert length == {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in want.items()}


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, plain.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
    last = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    assert last(spark, plain.limit(0), SF).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Two texts of one id are two documents: neither is lost, nor are the links of either."""
    words = [[f"w{g}x{k}" for k in range(60)] for g in range(3)]
    near = lambda g, k: " ".join([*words[g][:k], "other", *words[g][k + 1 :]])
    a, b, c = (" ".join(w) for w in words)
    rows = [(1, a), (1, b), (2, near(0, 59)), (3, near(1, 59)), (4, c), (5, c.upper()), (5, "alone"), (6, ""), (6, "  "), (1, a), (1, a.replace(" ", "  "))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    want = {(1, 56, 1, True): 4, (2, 56, 1, False): 1, (3, 56, 1, False): 1, (4, 56, 4, True): 1, (5, 56, 4, False): 1, (5, 1, 5, True): 1, (6, 0, 6, True): 2}
    assert got == Counter(want)
    kept = sorted((r.doc_id, " ".join(r.text.split())) for r in minhash.one_of_each(df).collect())
    assert kept == [(1, a), (1, b), (4, c), (5, "alone"), (6, ""), (6, "")]


def test_near_duplicates_equal_an_exact_join_on_many_texts(spark):
    """All documents of sf0.01 against a comparison of all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    owner, sizes = brute_components({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {k: (sizes[k], owner[k]) for k in owner}


def test_any_number_of_steps_up(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.net/x", '<link rel="canonical" href="http://b.org/' + "p/" * 40 + "../" * 40 + 'end">'),
            (2, "http://b.org/end", ""),
            (3, "http://c.org/m/n/page", '<link rel="canonical" href="../../../../far/./x/..?q=/../y">'),
        ],
        "page_id long, url string, html string",
    )
    target = urls.resolved(F.regexp_extract("html", 'href="([^"]*)"', 1), F.col("url"))
    got = {r.page_id: r.t for r in pages.select("page_id", target.alias("t")).collect()}
    assert got[1] == "http://b.org/end" and got[3] == "http://c.org/far/?q=/../y"
    assert {r.page_id: r.verdict for r in urls.judge(pages).collect()} == {1: "block", 2: "block", 3: "allow"}
