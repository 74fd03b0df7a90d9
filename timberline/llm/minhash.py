"""b-bit MinHash near-duplicate detection.

Signatures keep only the low ``BITS`` bits of each minimum, packed; pairs come from bands of full minima and are thinned
by the collision-corrected bit-count estimate before an exact check on whole shingle sets.

Large groups of copies never become all pairs. Equal shingle sets are one class from the start. Then

1. over a few bands, every text is compared with one other, the most central text that it meets (central: meets the most
   texts; the original of a group of copies does), and components of the confirmed links are formed;
2. over all bands, only buckets that still hold several components are looked at: every pair that could join two
   components is estimated, as (members outside the bucket's largest component) x (members). Members of a large bucket
   are dealt into blocks, and every block meets every other in a group of its own, so no pair is left out and no task
   holds a whole bucket; the tests made still grow with the square of a bucket, the rows that leave the join don't. Two
   texts that were compared with the same central text o can share at most min(|x & o|, |y & o|) + min(|x - o|, |y - o|)
   shingles. Besides, each text carries a parity bitmap of its whole set (a bit is flipped by every shingle that hashes to
   it): the bits in which two bitmaps differ are never more than the shingles that only one of the two texts has. Pairs
   that either bound rules out, and pairs that the signatures rule out, never leave the join.

A pair inside one component can't change the components, so the result is that of comparing all pairs that share a
bucket and that the signature cut leaves (the other bounds are exact). A pair of similarity 0.75 shares no bucket with a
probability of about 5.2e-6; the signature cut (``MARGIN``) loses it with one of about 2e-7 more.

Defined results: null or empty text, or text without words: ``n_shingles`` 0, a component of its own. A null ``doc_id``
can't name a component: such a row gets a null ``component_id`` and ``kept`` true. Repeated rows are exact copies. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import pin, unpin
from timberline.llm.components import components

HASHES, BANDS, BITS, WORDS_IN_SHINGLE = 128, 32, 2, 5
ROWS = HASHES // BANDS
#: Estimates this far below the threshold are over 5 standard deviations off; such pairs aren't checked exactly.
MARGIN = 0.25
#: A bucket with more members than this is compared in blocks of about so many.
CROWDED = 512
#: Bands of the first pass; the second pass looks at all.
LEAD_BANDS = 8
#: Bits of the parity bitmap. It tells texts of up to about 800 shingles apart; longer ones rest on the other bounds.
PARITY_BITS = 1024

_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Word -> 64-bit hash, emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles (of the whole sequence, if shorter)."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, n)
    k = min(n, WORDS_IN_SHINGLE)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = s * _POWER + h[i : n - k + 1 + i]
    return np.unique(_mix(s))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(out, (_MULTIPLIERS[:, None] * s[None, at : at + 1024]).min(axis=1), out=out)
    return out


def pack(low: np.ndarray) -> bytes:
    """The low ``BITS`` (2) bits of each minimum, four to a byte."""
    low = (_mix(low) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return (low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6).tobytes()


def parity(s: np.ndarray) -> bytes:
    """A bitmap in which each shingle flips one bit; two bitmaps differ in at most as many bits as the sets do in members."""
    return np.packbits(np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from two arrays of packed signatures (rows of bytes), corrected for chance agreement of low bits."""
    x = a ^ b
    differing = np.bitwise_count((x | x >> 1) & 0x55).sum(axis=1)
    chance = 1 / 2**BITS
    return ((1 - differing / HASHES) - chance) / (1 - chance)


def _lists(flat: np.ndarray, rows: int) -> pa.ListArray:
    each = len(flat) // rows if rows else 0
    return pa.ListArray.from_arrays(pa.array([k * each for k in range(rows + 1)], pa.int32()), pa.array(flat, pa.int64()))


def _sign(batches):
    for batch in batches:
        ids, n, h1, h2, packed, odd, bands = batch.column("doc_id"), [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            if not len(s):
                h1.append(0), h2.append(0), packed.append(bytes(HASHES * BITS // 8)), odd.append(bytes(PARITY_BITS // 8))
                bands.append(np.zeros(BANDS, np.uint64))
                continue
            one, two = _set_name(s)
            h1.append(one), h2.append(two)
            m = minima(s)
            packed.append(pack(m)), odd.append(parity(s))
            key = np.zeros(BANDS, np.uint64)
            for row in m.reshape(BANDS, ROWS).T:
                key = _mix(key * _POWER + row)
            bands.append(key)
        flat = np.concatenate(bands).view(np.int64) if bands else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                ids.cast(pa.int64()),
                batch.column("said"),
                pa.array(n, pa.int64()),
                pa.array(h1, pa.int64()),
                pa.array(h2, pa.int64()),
                _lists(np.frombuffer(b"".join(packed), np.int64), len(n)),
                _lists(np.frombuffer(b"".join(odd), np.int64), len(n)),
                _lists(flat, len(n)),
            ],
            ["doc_id", "said", "n_shingles", "h1", "h2", "sig", "odd", "bands"],
        )


_SIGNED = "doc_id long, said long, n_shingles long, h1 long, h2 long, sig array<long>, odd array<long>, bands array<long>"


def _set_name(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole shingle set."""
    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(int(np.uint64(half).astype(np.int64)) for half in (whole & (2**64 - 1), whole >> 64))


def _sets(batches):
    """The shingle sets of the classes that a row's id is wanted for; an id may occur with several texts."""
    last, seen = None, set()
    for batch in batches:
        ids, sets = [], []
        for doc_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
            if doc_id != last:
                last, seen = doc_id, set()
            s = shingle_set(text)
            h1, h2 = _set_name(s)
            for w in wanted:
                if (w["h1"], w["h2"]) == (h1, h2) and w["id"] not in seen:
                    seen.add(w["id"])
                    ids.append(w["id"])
                    sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])


@F.pandas_udf(T.LongType())
def _shared(a, b):
    import pandas as pd

    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out.append(int((y[at] == x).sum()) if len(y) else 0)
    return pd.Series(out, dtype="int64")


def _plausible(threshold: float) -> Column:
    """Whether sizes n_a, n_b, signatures sig_a, sig_b and parity bitmaps odd_a, odd_b leave the threshold within reach."""
    differing = sum(
        (F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in (F.get("sig_a", k).bitwiseXOR(F.get("sig_b", k)) for k in range(HASHES * BITS // 64))),
        F.lit(0),
    )
    chance = 1 / 2**BITS
    most = HASHES * (1 - chance) * (1 - (threshold - MARGIN))
    apart = sum((F.bit_count(F.get("odd_a", k).bitwiseXOR(F.get("odd_b", k))) for k in range(PARITY_BITS // 64)), F.lit(0))
    # A similarity of t leaves (1 - t) / (1 + t) of both sizes outside the intersection; 1e-6 is for rounding.
    few = apart <= (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold) & (differing <= math.floor(most)) & few


def _within_reach(percent: int) -> Column:
    """Whether what two texts share with the same third text leaves the similarity within reach."""
    common = F.least("with_a", "with_b") + F.least(F.col("n_a") - F.col("with_a"), F.col("n_b") - F.col("with_b"))
    enough = common * 100 >= percent * (F.col("n_a") + F.col("n_b") - common)
    return enough | (F.col("lead_a") != F.col("lead_b")) | F.col("lead_a").isNull() | F.col("lead_b").isNull()


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b, shared, link: how many shingles the whole sets share, and whether the similarity is reached, by integers."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "low", "h1", "h2"), "id")
    # More than one class for an id only where the id occurs with several texts.
    wanted = wanted.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list(F.struct("h1", "h2", "id")).alias("wanted"))
    # The ids grow with the corpus, so they are never broadcast.
    texts = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "wanted")
    sets = pin(texts.mapInArrow(_sets, "id long, shingles binary"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    n = (F.octet_length("set_a") + F.octet_length("set_b")) / F.lit(8)
    shared = both.withColumn("n", n.cast("long")).withColumn("shared", _shared("set_a", "set_b"))
    links = pin(shared.select("a", "b", "shared", (F.col("shared") * 100 >= percent * (F.col("n") - F.col("shared"))).alias("link")).dropDuplicates(["a", "b"]))
    unpin(sets)
    return links


def _blocked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(key, band, id, comp) of buckets with several components -> the minor members, and all members with ``minor``.

    Both have ``x`` and ``y``, the blocks of the bucket's minor members and of all its members; each member is repeated for
    all blocks of the other side, so that every minor member meets every member once. Two minor members meet both ways.
    """
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    # Which component is the bucket's largest; the rest are the minor ones.
    tops = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"))
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(max(CROWDED, 1))), F.lit(1)).cast("int")
    tops = tops.select("key", F.col("top.comp").alias("major"), blocks(F.col("m") - F.col("top.c")).alias("of_minor"), blocks(F.col("m")).alias("of_all"))
    rows = rows.join(tops, "key").withColumn("minor", F.col("comp") != F.col("major")).withColumn("h", F.xxhash64("id", F.lit("block")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.where("minor").withColumn("x", F.pmod("h", "of_minor").cast("int")).withColumn("y", every("of_all"))
    full = rows.withColumn("y", F.pmod("h", "of_all").cast("int")).withColumn("x", every("of_minor"))
    return few.select("key", "x", "y", "band", "id", "comp"), full.select("key", "x", "y", "id", "comp", "minor")


def _named(rows: DataFrame) -> DataFrame:
    """h1, h2, low, copies, id: one row for each shingle set, with its smallest doc_id and a number of its own.

    That number is the smallest doc_id; where several sets have the same (an id that occurs with several texts), a hash.
    """
    classes = pin(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    shared = pin(classes.groupBy("low").agg(F.count("*").alias("sets")).where("sets > 1").select("low"))
    if shared.isEmpty():
        return classes.withColumn("id", F.col("low"))
    marked = classes.join(shared.withColumn("shared", F.lit(True)), "low", "left")
    for seed in range(100):
        out = pin(marked.withColumn("id", F.when(F.col("shared"), F.xxhash64("h1", "h2", F.lit(seed))).otherwise(F.col("low"))).drop("shared"))
        if out.groupBy("id").count().where("count > 1").isEmpty():
            return out
    raise RuntimeError("no distinct numbers for shingle sets")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _grouped(docs, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``near_duplicates``, with hashes of the text (``said``) and of its shingle set (h1, h2)."""
    threshold = percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = pin(docs.select("doc_id", "text", F.xxhash64("text").alias("said")).mapInArrow(_sign, _SIGNED))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = _named(named)
    # One row per class: one of its smallest id.
    reps = pin(
        named.join(classes.select(F.col("low").alias("doc_id"), "h1", "h2", "id"), ["doc_id", "h1", "h2"])
        .dropDuplicates(["doc_id", "h1", "h2"])
        .select("id", F.col("n_shingles").alias("n"), "sig", "odd", "bands")
    )
    facts = reps.select("id", "n", "sig", "odd")

    def bucketed(rows: DataFrame, bands: int = BANDS) -> DataFrame:
        rows = rows.withColumn("bands", F.slice("bands", 1, bands))
        rows = rows.select(*(c for c in rows.columns if c not in ("n", "sig", "odd", "bands")), F.posexplode("bands").alias("band", "value"))
        return rows.withColumn("key", F.xxhash64("band", "value")).drop("value")

    few = bucketed(reps, LEAD_BANDS).select("key", "id")
    crowds = few.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    few = pin(few.join(crowds, "key"))
    central = few.groupBy("id").agg(F.sum("c").alias("meets"))
    few = pin(few.drop("c").join(central, "id"), replaces=few)
    # Ordered by how many texts they meet, then by id.
    score = F.struct(F.col("meets").alias("meets"), (-F.col("id")).alias("id"))
    leads = few.groupBy("key").agg(F.max(score).alias("lead"))
    star = few.join(leads, "key").groupBy("id").agg(F.max("lead").alias("lead")).select((-F.col("lead.id")).alias("a"), F.col("id").alias("b")).where("a <> b")
    sides = [facts.select(*(F.col(c).alias(x if c == "id" else f"{c}_{x}") for c in facts.columns)) for x in "ab"]
    star = pin(star.join(sides[0], "a").join(sides[1], "b").where(_plausible(threshold)).select("a", "b"))
    compared = _confirmed(docs, classes, star, percent)
    unpin(star)
    links = compared.where("link").select("a", "b")
    first = pin(components(links))

    # Second pass, over buckets that still hold several components.
    owner = reps.select("id", "bands").join(first.withColumnRenamed("node", "id"), "id", "left")
    owned = bucketed(owner.select("id", F.coalesce("component", "id").alias("comp"), "bands"))
    mixed = owned.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("z")).where("c < z").select("key")
    rows = pin(owned.join(mixed, "key").select("key", "band", "id", "comp"))
    # What a text shares with the central text that it was compared with; a central text shares all with itself.
    shares = compared.select(F.col("b").alias("id"), F.col("a").alias("lead"), F.col("shared").alias("with"))
    own = compared.select(F.col("a").alias("id")).distinct().join(shares.select("id"), "id", "left_anti")
    own = own.join(facts, "id").select("id", F.col("id").alias("lead"), F.col("n").alias("with"))
    facts = pin(reps.select("id", "n", "sig", "odd", "bands").join(shares.union(own), "id", "left"))
    kept = ("id", "comp", "sig", "odd", "n", "lead", "with", "bands")
    few, full = (x.join(facts, "id") for x in _blocked(rows))
    few = few.select("key", "x", "y", "band", *(F.col(c).alias(f"{c}_a") for c in kept))
    full = full.select("key", "x", "y", "minor", *(F.col(c).alias(f"{c}_b") for c in kept))
    wanted = (F.col("comp_a") != F.col("comp_b")) & (~F.col("minor") | (F.col("id_a") < F.col("id_b")))
    # Texts that meet in several bands are a pair in the first of them only.
    same = F.zip_with(F.slice("bands_a", 1, F.col("band")), F.slice("bands_b", 1, F.col("band")), lambda x, y: x == y)
    wanted = wanted & _plausible(threshold) & _within_reach(percent) & ~F.exists(same, lambda e: e)
    pairs = few.join(full, ["key", "x", "y"]).where(wanted)
    found = pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    found = pin(found.distinct())
    if not found.isEmpty():
        links = links.union(_confirmed(docs, classes, found, percent).where("link").select("a", "b"))
        first = pin(components(links))
    owner = pin(classes.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    # A component is called by the smallest doc_id in it.
    lows = owner.groupBy("component").agg(F.min("low").alias("component_id"))
    owner = owner.join(lows, "component")
    # Classes that are their own component need no row here.
    owner = owner.select("h1", "h2", "component_id", "low", "copies").where("component_id <> low or copies > 1").drop("low", "copies")
    out = signed.select("doc_id", "n_shingles", "said", "h1", "h2").join(owner, ["h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns; rows without an id stay.

    An id may occur with several texts: each of them is judged by itself, and only rows of one id whose shingles are equal
    become one.
    """
    kept = _grouped(docs, percent).where("kept and doc_id is not null")
    # Texts without words are equal to nothing but themselves.
    kept = kept.groupBy("doc_id", "h1", "h2", F.when(F.col("n_shingles") == 0, F.col("said")).alias("bare")).agg(F.min("said").alias("k_said"))
    kept = kept.select(F.col("doc_id").alias("k_id"), "k_said").distinct()
    rows = docs.where("doc_id is not null").withColumn("k_id", F.col("doc_id").cast("long")).withColumn("k_said", F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(kept.hint("merge"), ["k_id", "k_said"], "left_semi").dropDuplicates(["k_id", "k_said"])
    return rows.select(docs.columns).union(docs.where("doc_id is null"))
