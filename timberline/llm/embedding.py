"""Embedding near-duplicates by cross-polytope hashing.

Unit vectors are rotated by three rounds of random signs and fast Hadamard transforms; the hash is the signed axis nearest
to the rotated vector. A table's key joins several such hashes with the label; each vector is filed under its own key in
every table and also probes the key whose swapped axis is nearly as close. Vectors that meet in a bucket are verified in
double precision.

How many hashes a key joins follows from the rows of the label, so that a bucket holds few rows that only meet by chance
whatever the size of the table; more hashes take more tables (``tables_for``), so that the share of missed pairs stays
the same. With 64 dimensions a pair at cosine 0.98 shares no bucket with a probability of about 3e-6 (measured per table:
0.98, 0.86, 0.72 and 0.59 for one to four hashes); closer pairs are missed less.

Equal vectors of a label are one class from the start, so copies cost nothing. Only members of buckets with company take
their vectors along. A large bucket's members are dealt into blocks, and blocks meet as matrices. A pair that meets in
several buckets counts in that of the smallest key alone, which both rows' keys tell, so no pair is ever written: a tile
gives one row for each member with links, its number of new links and its local component.

Defined results: null, zero or non-finite vectors, and rows with a null label, have no links and a component of their own.
A row with a null ``vec_id`` has no links, a null component and is kept. Vectors of different lengths never link. Repeated
rows are copies; different vectors of one id have links of their own and share a component. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pin, unpin
from timberline.llm.components import components

#: Rows of a bucket compared as one matrix.
BLOCK = 1024
#: Buckets with at most this many members are compared pair by pair, many buckets at once.
FEW = 24
#: Rows of a label over the buckets of a table: how many strangers a row meets there, at most.
STRANGERS = 0.05
#: More hashes than this make no smaller buckets worth their tables; larger buckets are still compared whole.
MOST_AXES = 6
_MAX = np.iinfo(np.int64).max


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis (a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], d))
    return x


def axis_codes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest signed axis of each rotated row, the second nearest, and how much closer the first is."""
    y = rotated(x, seed)
    size = np.abs(y)
    rows = np.arange(len(y))
    best = size.argmax(axis=1)
    top = size[rows, best]
    size[rows, best] = -1
    second = size.argmax(axis=1)
    sign = lambda k: (y[rows, k] < 0).astype(np.int64)
    return best * 2 + sign(best), second * 2 + sign(second), top - size[rows, second]


def axes_for(rows: int, dim: int) -> int:
    """Hashes in a key, so that a row of a label of so many rows meets few strangers in a bucket."""
    codes = 2 << max(0, (dim - 1).bit_length())
    return min(MOST_AXES, max(1, math.ceil(math.log(max(2 * rows / STRANGERS, 1)) / math.log(codes))))


def tables_for(axes: int) -> int:
    return 3 * axes + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_keys(x: np.ndarray, labels: np.ndarray, axes: int) -> np.ndarray:
    """(rows, tables, 2): each unit row's own key in every table, and that with its least certain axis swapped."""
    rows, out = np.arange(len(x)), []
    power = np.uint64(0x9E3779B97F4A7C15)
    for t in range(tables_for(axes)):
        first, second, gap = (np.stack(v, axis=1) for v in zip(*(axis_codes(x, 1000 * t + k + 1) for k in range(axes))))
        swapped, k = first.copy(), gap.argmin(axis=1)
        swapped[rows, k] = second[rows, k]
        for codes in (first, swapped):
            key = _mix(labels.astype(np.uint64) * power + np.uint64(x.shape[1] * 1000 + t + 1))
            for code in codes.astype(np.uint64).T:
                key = _mix(key * power + code)
            out.append(key.view(np.int64))
    return np.stack(out, axis=1).reshape(len(x), -1, 2)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; rows of zeros, or with a component that isn't finite, become NaN."""
    x = x.astype(np.float64)
    x = x / np.where(np.isfinite(x).all(axis=1), np.abs(x).max(axis=1, initial=0.0), np.nan)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of a list column for each length of its lists; null components are NaN."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(size) - size
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


def _classified(batches):
    """vec_id and label with the vector's bytes and a 128-bit name of them, null where the row can't link."""
    for batch in batches:
        n = batch.num_rows
        column, named = batch.column("embedding"), batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        h1, h2, raw = [None] * n, [None] * n, [None] * n
        with np.errstate(all="ignore"):
            for at, x in _matrices(column):
                fine = np.isfinite(unit_rows(x)).all(axis=1) & named[at]
                for k, row in zip(at[fine], x[fine]):
                    raw[k] = row.tobytes()
                    whole = xxhash.xxh3_128_intdigest(raw[k])
                    h1[k], h2[k] = (whole & (2**64 - 1)) - 2**63, (whole >> 64) - 2**63
        columns = [batch.column("vec_id"), batch.column("label"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "h1", "h2", "raw"])


def _units(column: pa.Array, dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit rows) of a column of vectors' bytes for each length."""
    raw = column.to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, unit_rows(np.frombuffer(b"".join([raw[k] for k in at]), dtype).reshape(len(at), -1))


def _filed(dtype: np.dtype):
    def run(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy()
            rows = batch.column("rows").to_numpy()
            keys: list[list[int]] = [[]] * batch.num_rows
            for at, x in _units(batch.column("raw"), dtype):
                axes = np.array([axes_for(int(n), x.shape[1]) for n in rows[at]])
                for a in np.unique(axes):
                    mine = np.flatnonzero(axes == a)
                    found = bucket_keys(x[mine], labels[at[mine]], int(a)).reshape(len(mine), -1)
                    for k, row in zip(at[mine], found):
                        keys[k] = row
            own = ["id", "h1", "label", "copies", "raw"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [pa.array(keys, pa.list_(pa.int64()))], [*own, "keys"])

    return run


def merged(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links i-j are added to a forest of roots."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


class _Tiles:
    """Links between the rows of whole tiles that lie one after another."""

    def __init__(self, rows: pa.Table, dtype: np.dtype, least: float):
        self.least = least
        self.key, self.one, self.other, self.block, self.id, self.h1, self.label, self.copies = (
            rows.column(c).to_numpy() for c in ("key", "one", "other", "block", "id", "h1", "label", "copies")
        )
        self.units = list(_units(rows.column("raw").combine_chunks(), dtype))
        # Tables x 2 columns of keys; what a row doesn't have is larger than any bucket's key.
        keys = rows.column("keys").to_pylist()
        width = max(len(k) for k in keys)
        self.keys = np.array([k + [_MAX] * (width - len(k)) for k in keys], np.int64).T.copy()
        self.links = np.zeros(len(self.id), np.int64)
        self.parent = np.arange(len(self.id))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Counts the pairs i-j that are close, of one label, and meet in no bucket of a smaller key."""
        ok = self.label[i] == self.label[j]
        for t in range(0, len(self.keys), 2):
            i, j = i[ok], j[ok]
            if not len(i):
                return
            ok = np.ones(len(i), bool)
            for p in (t, t + 1):
                x = self.keys[p][i]
                earlier = x < self.key[i]
                for q in (t, t + 1):
                    ok &= ~(earlier & (x == self.keys[q][j]))
        i, j = i[ok], j[ok]
        n = len(self.id)
        self.links += np.bincount(i, self.copies[j], n).astype(np.int64) + np.bincount(j, self.copies[i], n).astype(np.int64)
        self.parent = merged(self.parent, i, j)

    def run(self) -> pa.RecordBatch:
        for at, x in self.units:
            change = np.flatnonzero((np.diff(self.key[at]) != 0) | (np.diff(self.one[at]) != 0) | (np.diff(self.other[at]) != 0)) + 1
            bounds = np.concatenate([[0], change, [len(at)]])
            size = np.diff(bounds)
            tile = np.repeat(np.arange(len(size)), size)
            small = np.repeat((size <= FEW) & (self.one[at[bounds[:-1]]] == self.other[at[bounds[:-1]]]), size)
            for step in range(1, FEW):
                k = np.flatnonzero((tile[step:] == tile[:-step]) & small[step:])
                if not len(k):
                    break
                close = (x[k] * x[k + step]).sum(axis=1) >= self.least
                self.add(at[k[close]], at[k[close] + step])
            for b, e in zip(bounds[:-1], bounds[1:]):
                if not small[b]:
                    self.matrix(at[b:e], x[b:e])
        hit = np.flatnonzero(self.links)
        columns = [self.id[hit], self.h1[hit], self.links[hit], self.id[self.parent[hit]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "h1", "links", "root"])

    def matrix(self, at: np.ndarray, x: np.ndarray) -> None:
        inside = self.one[at[0]] == self.other[at[0]]
        left = np.arange(len(at)) if inside else np.flatnonzero(self.block[at] == self.one[at[0]])
        right = left if inside else np.flatnonzero(self.block[at] == self.other[at[0]])
        for s in range(0, len(left), 256):
            rows = left[s : s + 256]
            cosine = x[rows] @ x[right].T
            # Pairs this near the threshold are summed again in one order.
            i, j = np.nonzero(np.abs(cosine - self.least) < 1e-9)
            cosine[i, j] = (x[rows[i]] * x[right[j]]).sum(axis=1)
            i, j = np.nonzero(cosine >= self.least)
            i, j = rows[i], right[j]
            if inside:  # every pair comes twice
                i, j = i[i < j], j[i < j]
            self.add(at[i], at[j])


def _compared(least: float, dtype: np.dtype):
    """(id, h1, links, root) of the members of sorted tiles; a tile may go on in the next batch."""

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            key, one, other = (rows.column(c).to_numpy() for c in ("key", "one", "other"))
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(other) != 0)) + 1
            if len(change):
                yield _Tiles(rows.slice(0, change[-1]), dtype, least).run()
                rows = rows.slice(change[-1])
            held = rows
        if held is not None and held.num_rows:
            yield _Tiles(held, dtype, least).run()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    single = dict(vectors.dtypes).get("embedding") == "array<float>"
    dtype, kind = (np.dtype(np.float32), "array<float>") if single else (np.dtype(np.float64), "array<double>")
    vectors = vectors.selectExpr("cast(vec_id as long) as vec_id", f"cast(embedding as {kind}) as embedding", "cast(label as long) as label")
    named = pin(vectors.mapInArrow(_classified, "vec_id long, label long, h1 long, h2 long, raw binary"))
    linkable = named.where("vec_id is not null and h1 is not null")
    classes = linkable.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = pin(classes)
    sizes = classes.groupBy("label").agg(F.count("*").alias("rows"))
    own = ("id", "h1", "label", "copies", "raw")
    filed = classes.select(*own).join(sizes, "label").select(*own, "rows")
    filed = pin(filed.mapInArrow(_filed(dtype), "id long, h1 long, label long, copies long, raw binary, keys array<long>"))
    flat = filed.select("id", "h1", F.explode(F.array_distinct("keys")).alias("key"))
    # Only buckets with two or more members matter; members are dealt into blocks of a bounded size.
    buckets = flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = flat.join(buckets, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id", "h1"), F.col("blocks")).cast("int"))
    # Each block meets itself and every other block once.
    members = members.select("key", "id", "h1", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    members = members.select("key", "id", "h1", "block", F.least("block", "met").alias("one"), F.greatest("block", "met").alias("other"))
    tiles = members.join(filed, ["id", "h1"]).select("key", "one", "other", "block", *own, "keys")
    tiles = tiles.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    found = pin(tiles.mapInArrow(_compared(cosine, dtype), "id long, h1 long, links long, root long"))
    counted = found.groupBy("id", "h1").agg(F.sum("links").alias("others"))
    owners = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    unpin(filed)
    facts = classes.select("label", "h1", "h2", "id", "copies").join(counted, ["id", "h1"], "left").join(owners, "id", "left")
    facts = facts.select(
        "label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    ).where("n_links > 0")
    out = named.select("vec_id", "label", "h1", "h2").join(facts, ["label", "h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")))
    # A row without an id counts in nobody's links and has none.
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
