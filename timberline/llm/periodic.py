"""Periodic runs of words, by Crochemore's partition refinement.

Two places of a document are in one class of length l if the l words that begin there are equal. The classes of length 1 are
those of equal words; those of length l + 1 follow by splitting: a class is divided by the classes that its places' right
neighbours are in. Of the parts into which a class falls, all but the largest split others in the next step (the smaller
half), so that a place takes part in O(log n) splits. The places of a class are kept in order; two neighbours at a distance
equal to the length begin a square, and one whose root isn't a power itself (else a member would lie between them). Squares
of one period that begin side by side are merged into a run.

A document is a row, so its places stay in one task. The places of many documents are refined together as arrays, each
document with classes of its own and a mark at its end that equals nothing; memory is about 150 bytes a word of ``PLACES``
words or of one document, whichever is more. Nothing is shuffled.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text. Words are divided by ASCII
white space alone. Repeated rows, null and repeated ids each give a row of their own. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are refined together, about.
PLACES = 500_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_EMPTY = np.zeros(0, np.int64)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Whether each element differs from the one before."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + count - 1`` of each pair."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Partition:
    """Classes of equal factors over the places of several documents.

    ``by_class`` holds the places of each class side by side (from ``first`` on, ``size`` of them) and ``slot`` says where a
    place stands in it; ``after`` and ``before`` link the places of a class in order (-1 at the ends), and ``since`` is the
    length from which a place's link holds.
    """

    def __init__(self, word: np.ndarray, doc: np.ndarray, limit: np.ndarray):
        n = len(word)
        self.doc, self.limit, self.length = doc, limit, 1
        order = np.lexsort((word, doc))
        new = _firsts(word[order]) | _firsts(doc[order])
        at = np.flatnonzero(new)
        self.count = len(at)
        self.first, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.first[: self.count] = at
        self.size[: self.count] = np.diff(np.append(at, n))
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.by_class, self.slot = order, np.empty(n, np.int64)
        self.slot[order] = np.arange(n)
        self.after, self.before, self.since = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        linked = np.flatnonzero(~new)
        self.after[order[linked - 1]] = order[linked]
        self.before[order[linked]] = order[linked - 1]
        self.moving = np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        # All places of a document are one class of length 0; its largest part doesn't split others.
        owner = doc[order[at]]
        by_size = np.lexsort((-self.size[: self.count], owner))
        largest = by_size[_firsts(owner[by_size])]
        self.splitters = np.flatnonzero(~np.isin(self.of, largest))

    def _ended(self, places: np.ndarray) -> None:
        """Links of these places end with this length: those that held when it equalled their distance are squares."""
        gap = self.after[places] - places
        hit = (self.since[places] <= gap) & (gap <= self.length) & (gap <= self.limit[places])
        if hit.any():
            self.squares.append((places[hit], gap[hit]))

    def refine(self) -> None:
        """From classes of ``length`` to those of ``length + 1``."""
        right, n = self.splitters, len(self.of)
        self.splitters = _EMPTY
        right = right[right > 0]
        place = right - 1
        fit = (self.doc[place] == self.doc[right]) & (self.size[self.of[place]] > 1) & (self.limit[place] > self.length)
        place, right = place[fit], right[fit]
        if len(place):
            key = self.of[place] * n + self.of[right]
            order = np.argsort(key, kind="stable")  # places of equal keys stay in ascending order
            self._split(place[order], key[order] // n, key[order])
        self.length += 1

    def _split(self, place: np.ndarray, old: np.ndarray, key: np.ndarray) -> None:
        """Takes the groups of equal ``key`` out of their ``old`` classes."""
        at = np.flatnonzero(_firsts(key))
        count, owner = np.diff(np.append(at, len(place))), old[at]
        # Where nothing of a class would stay, its largest group stays.
        by = np.flatnonzero(_firsts(owner))
        rest = self.size[owner[by]] - np.add.reduceat(count, by)
        whole = np.repeat(rest == 0, np.diff(np.append(by, len(owner))))
        by_size = np.lexsort((-count, owner))
        largest = np.zeros(len(count), bool)
        largest[by_size[_firsts(owner[by_size])]] = True
        goes = ~(whole & largest)
        chosen = np.repeat(goes, count)
        place, old, count, owner, largest = place[chosen], old[chosen], count[goes], owner[goes], largest[goes]
        if not len(place):
            return
        self._relink(place, old, count)
        # The groups take the last slots of their classes; what stood there goes where they were.
        by = np.flatnonzero(_firsts(owner))
        classes, moved = owner[by], np.add.reduceat(count, by)
        low = self.first[classes] + self.size[classes] - moved
        target = _ranges(low, moved)
        self.moving[place] = True
        there = self.by_class[target]
        there = there[~self.moving[there]]
        freed = self.slot[place]
        freed = freed[freed < np.repeat(low, moved)]
        self.by_class[freed], self.slot[there] = there, freed
        self.by_class[target], self.slot[place] = place, target
        self.moving[place] = False
        self.size[classes] -= moved
        names = self.count + np.arange(len(count))
        self.count += len(count)
        self.of[place] = np.repeat(names, count)
        self.first[names] = target[np.cumsum(count) - count]
        self.size[names] = count
        # The smaller half: where a group is larger than what stays, what stays splits others in its place.
        stays = np.repeat(self.size[classes], np.diff(np.append(by, len(owner))))
        spared = largest & (count > stays)
        left = owner[spared]
        self.splitters = np.sort(np.concatenate((place[np.repeat(~spared, count)], self.by_class[_ranges(self.first[left], self.size[left])])))

    def _relink(self, place: np.ndarray, old: np.ndarray, count: np.ndarray) -> None:
        now = self.length + 1
        # What stays in the old classes closes over the chains taken out.
        out = place[np.argsort(old * len(self.of) + place)]
        head = np.ones(len(out), bool)
        head[1:] = self.after[out[:-1]] != out[1:]
        a, b = self.before[out[head]], self.after[out[np.append(head[1:], True)]]
        known = a >= 0
        self._ended(a[known])
        self.after[a[known]], self.since[a[known]] = b[known], now
        known = b >= 0
        self.before[b[known]] = a[known]
        # Links inside the new groups; one that stays as it was goes on.
        start = np.zeros(len(place), bool)
        start[np.cumsum(count) - count] = True
        after, before = np.full(len(place), -1), np.full(len(place), -1)
        inner = np.flatnonzero(~start)
        after[inner - 1], before[inner] = place[inner], place[inner - 1]
        changed = self.after[place] != after
        self._ended(place[changed & (self.after[place] >= 0)])
        self.after[place], self.before[place] = after, before
        self.since[place[changed]] = now

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of every square up to the documents' limits whose root isn't a power."""
        most = int(self.limit.max(initial=0))
        while len(self.splitters) and self.length < most:
            self.refine()
        self.length = max(self.length, most)  # the classes don't change any more
        self._ended(np.flatnonzero(self.after >= 0))
        return tuple(np.concatenate(x) for x in zip(*self.squares)) if self.squares else (_EMPTY, _EMPTY)


def runs_of(numbers: list[np.ndarray], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, by start and period.

    ``numbers`` are the documents' words as numbers. A run has at least ``least`` words and ``exponent`` periods.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in numbers]
    long = [k for k, w in enumerate(numbers) if len(w) >= least]
    if not long:
        return out
    sizes = np.array([len(numbers[k]) + 1 for k in long])
    base = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(long)), sizes)
    word = np.full(int(sizes.sum()), -1, np.int64)
    for b, k in zip(base, long):
        word[b : b + len(numbers[k])] = numbers[k]
    place, period = Partition(word, doc, np.repeat((sizes - 1) // exponent, sizes)).finish()
    order = np.lexsort((place, period, doc[place]))
    place, period = place[order], period[order]
    new = _firsts(period) | _firsts(doc[place]) | (np.diff(place, prepend=-2) != 1)
    at = np.flatnonzero(new)
    if not len(at):
        return out
    start, last, q = place[at], place[np.append(at[1:], len(place)) - 1], period[at]
    length = last - start + 2 * q
    keep = length >= np.maximum(least, exponent * q)
    start, length, q = start[keep], length[keep], q[keep]
    for k in np.lexsort((q, start)):
        d = doc[start[k]]
        out[long[d]].append((int(start[k] - base[d]), int(length[k]), int(q[k])))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            change[start + q] += 1
            change[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def _searched(batches: Iterator, least: int, exponent: int) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts, at = batch.column(1).cast(pa.binary()), 0
        while at < len(batch):
            begin, table, words, numbers, held = at, defaultdict(), [], [], 0
            table.default_factory = table.__len__
            while at < len(batch) and held < PLACES:
                w = (texts[at].as_py() or b"").split()  # bytes are divided by ASCII white space alone
                words.append(w)
                numbers.append(np.fromiter(map(table.__getitem__, w), np.int64, len(w)))
                held += len(w)
                at += 1
            runs = runs_of(numbers, least, exponent)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(begin, at - begin), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": a, "length": b, "period": c} for a, b, c in r] for r in runs], kind),
                    pa.array([_collapsed(w, r) for w, r in zip(words, runs)], pa.binary()).view(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and the text without its repetitions."""
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(lambda b: _searched(b, least, exponent), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; one text in ten, chosen by its id, repeats its words with a period from some place on."""
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", "crc32(cast(cast(doc_id as long) as string)) as h")
    docs = docs.withColumn("w", F.expr(f"case when h % 10 = 0 then {words} end")).withColumn("n", F.expr("size(w)"))
    docs = docs.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("case when n > 0 then g % n end"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = "array_join(transform(sequence(0, n - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')"
    return docs.select("doc_id", F.expr(f"case when n > 0 then {again} else text end").alias("text"))


def _strongest(runs: Column) -> Column:
    """The run with the greatest length for each period; of equal ones the first, then the shortest period."""
    worth = lambda x, y: x["length"] * y["period"]

    def order(x: Column, y: Column) -> Column:
        first = (worth(x, y) > worth(y, x)) | ((worth(x, y) == worth(y, x)) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
        same = (x["start"] == y["start"]) & (x["period"] == y["period"])
        return F.when(same, 0).when(first, -1).otherwise(1)

    return F.get(F.array_sort(runs, order), F.lit(0))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period and exponent_milli of its strongest run, digests of all its
    runs and of the collapsed text."""
    found = periodic_runs(planted(docs)).withColumn("best", _strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 of a short text of ASCII characters, in DuckDB's SQL, bit by bit.
CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({x}, ''), lambda c: ascii(c)::ubigint)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"
)


def _sql(levels: int = 15) -> str:
    """DuckDB's SQL, by another way: factors of doubling length, neighbours among which give the periods to look at.

    A run of period q has neighbours q apart among the factors of any length from q to 2 q. Every place is then compared with
    the one q further on. ``levels`` reach documents of 2 ** (levels + 1) words.
    """
    spaced = r"'[^\x20\x09-\x0D]+'"
    parts = [
        f"d as (select doc_id, regexp_extract_all(coalesce(text, ''), {spaced}) as ws, {CRC_SQL.format(x='doc_id::varchar')}::bigint as h from documents)",
        "s as (select *, len(ws) as n, case when len(ws) > 0 then (h // 10) % len(ws) end as a from d)",
        "q as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from s)",
        "w as (select doc_id, n, i, case when h % 10 = 0 and i >= a then ws[1 + a + (i - a) % p] else ws[1 + i] end as word from q, unnest(range(n)) t(i))",
        "f0 as (select doc_id, n, i, min(i) over (partition by doc_id, word) as f from w)",
    ]
    for k in range(levels):
        size = 2**k
        parts.append(f"g{k} as (select doc_id, n, lead(i) over (partition by doc_id, f order by i) - i as gap from f{k})")
        parts.append(
            f"t{k} as (select doc_id, n, i, f, lead(f, {size}) over (partition by doc_id order by i) as f2 from f{k} where n >= {4 * size}), "
            f"f{k + 1} as (select doc_id, n, i, min(i) over (partition by doc_id, f, f2) as f from t{k} where f2 is not null)"
        )
    near = " union ".join(f"select doc_id, gap from g{k} where gap <= {2**k} and 2 * gap > {2**k} and 4 * gap <= n" for k in range(levels))
    parts += [
        f"c as (select distinct doc_id, gap from ({near}))",
        "m as (select x.doc_id, gap, x.i, x.i - row_number() over (partition by x.doc_id, gap order by x.i) as island from w x join c using (doc_id) "
        "join w y on y.doc_id = x.doc_id and y.i = x.i + gap where x.word = y.word)",
        'l as (select doc_id, gap as period, min(i) as start, count(*) + gap as "length" from m group by doc_id, gap, island having count(*) + gap >= greatest(6, 4 * gap))',
        'r as (select * from l where not exists (select 1 from l z where z.doc_id = l.doc_id and z.period < l.period and l.period % z.period = 0 '
        'and z.start <= l.start and z.start + z."length" >= l.start + l."length"))',
        'b as (select *, row_number() over (partition by doc_id order by "length"::double / period desc, start, period) as place from r)',
        "e as (select doc_id, count(*) as n_runs, string_agg(start || ',' || \"length\" || ',' || period || chr(10), '' order by start, period) as said from r group by 1)",
        'gone as (select distinct doc_id, unnest(range(start + period, start + "length")) as i from r)',
        "o as (select doc_id, string_agg(word, ' ' order by i) as said from w anti join gone using (doc_id, i) group by 1)",
    ]
    return (
        f"with {', '.join(parts)} select d.doc_id, coalesce(e.n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.\"length\"::bigint as \"length\", b.period::bigint as period, "
        "(1000 * b.\"length\" // b.period)::bigint as exponent_milli, sha256(coalesce(e.said, '')) as runs_sha256, sha256(coalesce(o.said, '')) as collapsed_sha256 "
        "from d left join e using (doc_id) left join b on b.doc_id = d.doc_id and b.place = 1 left join o on o.doc_id = d.doc_id"
    )


SQL = _sql()
