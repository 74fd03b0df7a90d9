"""A Merkle manifest of a dataset: one tree for each source over its rows in order, one tree over the sources' roots.

Parents are built as their children's digests arrive. A partial parent accumulates digests by their place among its children;
how many it waits for follows from the number of nodes on that level, which the tree's size gives. Once it has them all, it
turns into its own digest, which at once arrives at the next parent. Within a task that is done for all rows at hand
(combining before the shuffle); parents that a task leaves open, at most two on each level where a tree runs through it, are
sent to one another by key and combined again, until none is open. Every parent keeps its children's digests; the links back
from a node to its parent and its place there give the proofs, from the roots down, one join a level.

Rows are dealt by ranges of (source, id), so that a source of any size is many tasks; places follow from counts of the ranges.

Hashes are lowercase hex SHA-256. A row's leaf hashes its fields, each ``-`` if null, else its byte count, ``:`` and the
value. Up to ``ARITY`` nodes in a row make a parent; a lone node is its tree's root.

Defined results: a null source is a tree of its own, the first. Rows of one source are ordered by id (null first), then by
leaf; equal ones can't be told apart, and each is a leaf. Columns that aren't named are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.common import pin, unpin

ARITY, BITS = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A parent with the digests of its children so far; ``digest`` is null until it has them all.
NODE = "tree string, n long, level int, idx long, places array<int>, digests array<string>, digest string"
STEPS = "array<struct<before:string,behind:string>>"


def leaf_of(*fields: Column) -> Column:
    told = []
    for f in fields:
        value = f.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def tree_of(source: Column) -> Column:
    """A name for each source's tree; in the order of UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


class Partial:
    """What a parent has of its children: digests by place. Created by the first one, merged by place, ready at its arity."""

    __slots__ = ("parts", "arity")

    def __init__(self, arity: int):
        self.parts: dict[int, str] = {}
        self.arity = arity

    def ready(self) -> bool:
        return len(self.parts) == self.arity

    def children(self) -> list[str]:
        return [self.parts[k] for k in range(self.arity)]


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree of n leaves."""
    return -(-n // ARITY**level)


def _combined(batches: Iterator) -> Iterator:
    """Merges partial parents; those that are complete become digests and go on to their own parents."""
    import pyarrow as pa

    schema = pa.schema(
        [("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("places", pa.list_(pa.int32())), ("digests", pa.list_(pa.string())), ("digest", pa.string())]
    )
    open_: dict[tuple[str, int, int, int], Partial] = {}

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        done = []
        for tree, n, level, idx, places, digests, _ in zip(*(c.to_pylist() for c in batch.columns)):
            while True:
                key = (tree, n, level, idx)
                partial = open_.get(key)
                if partial is None:
                    partial = open_[key] = Partial(min(ARITY, width(n, level - 1) - ARITY * idx))
                partial.parts.update(zip(places, digests))
                if not partial.ready():
                    break
                del open_[key]
                children = partial.children()
                digest = hashlib.sha256("".join(children).encode()).hexdigest()
                done.append((tree, n, level, idx, list(range(len(children))), children, digest))
                if width(n, level) == 1:
                    break
                level, idx, places, digests = level + 1, idx // ARITY, [idx % ARITY], [digest]
        if done:
            yield out(done)
    rows = [(*key, list(p.parts), list(p.parts.values()), None) for key, p in open_.items()]
    for k in range(0, len(rows), 10_000):
        yield out(rows[k : k + 10_000])


def parents(leaves: DataFrame) -> DataFrame:
    """leaves(tree, n, idx, digest) -> all nodes above them (``NODE``)."""
    events = leaves.where("n > 1").select(
        "tree", "n", F.lit(1).alias("level"), F.shiftright("idx", BITS).alias("idx"), F.array((F.col("idx") % ARITY).cast("int")).alias("places"),
        F.array("digest").alias("digests"), F.lit(None).cast("string").alias("digest"),
    )
    nodes = pin(events.mapInArrow(_combined, NODE))
    whole = nodes.where("digest is not null")
    frontier = nodes.where("digest is null")
    while not frontier.isEmpty():
        # Partial parents of one key meet in one task; a parent has at most ARITY children.
        nodes = pin(frontier.repartition("tree", "level", "idx").mapInArrow(_combined, NODE))
        whole = whole.union(nodes.where("digest is not null"))
        frontier = nodes.where("digest is null")
    return whole


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, a row's place in its tree (from 0), and ``n``, the tree's rows. Ties of ``order`` are as they come."""
    dealt = pin(rows.repartitionByRange("tree", *order).withColumn("block", F.spark_partition_id()))
    sizes = dealt.groupBy("tree", "block").agg(F.count("*").alias("c"))
    sizes = sizes.selectExpr("tree", "block", "sum(c) over (partition by tree order by block) - c as base", "sum(c) over (partition by tree) as n")
    inner = F.row_number().over(W.partitionBy("tree", "block").orderBy(*order)) - 1
    return dealt.withColumn("inner", inner).join(sizes, ["tree", "block"]).withColumn("idx", F.col("base") + F.col("inner")).drop("block", "inner", "base")


def _is_top() -> Column:
    """Whether a node is the only one on its level."""
    return F.expr(f"shiftright(n + shiftleft(1L, {BITS} * level) - 1, {BITS} * level) = 1")


def tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, top: the root of each tree."""
    lone = leaves.where("n = 1").select("tree", F.col("digest").alias("top"))
    return lone.union(nodes.where(_is_top()).select("tree", F.col("digest").alias("top")))


def _step(digests: str, idx: str) -> Column:
    """The digests before and behind a child, as one text each; its place follows from its index."""
    place = F.pmod(F.col(idx), F.lit(ARITY)).cast("int")
    before = F.array_join(F.slice(F.col(digests), F.lit(1), place), "")
    return F.struct(before.alias("before"), F.array_join(F.expr(f"slice({digests}, cast(pmod({idx}, {ARITY}) as int) + 2, {ARITY})"), "").alias("behind"))


def proved(leaves: DataFrame, nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Adds to each leaf ``steps``, from its own level up: what stands before and behind it and each of its ancestors.

    ``above(tree, steps, ...)`` says what follows the root of each tree; its other columns are passed on.
    """
    passed = [c for c in above.columns if c not in ("tree", "steps")]
    depth = nodes.agg(F.max("level")).first()[0] or 0
    up = None
    for level in range(depth, 0, -1):
        here = nodes.where(F.col("level") == level)
        now = here.where(_is_top()).join(above, "tree").select("tree", "idx", "digests", "steps", *passed)
        if up is not None:
            lower = here.where(~_is_top()).select("tree", F.col("idx").alias("own"), F.shiftright("idx", BITS).alias("idx"), "digests")
            lower = lower.join(up.withColumnRenamed("digests", "around"), ["tree", "idx"])
            lower = lower.select("tree", F.col("own").alias("idx"), "digests", F.concat(F.array(_step("around", "own")), "steps").alias("steps"), *passed)
            now = now.union(lower)
        up = now
    if up is None:
        up = above.where("false").select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast("array<string>").alias("digests"), "steps", *passed)
    lone = leaves.where("n = 1").join(above, "tree")
    own = [c for c in leaves.columns if c not in ("tree", "idx")]
    rest = leaves.where("n > 1").withColumn("own", F.col("idx")).withColumn("idx", F.shiftright("idx", BITS)).join(up, ["tree", "idx"])
    rest = rest.select("tree", F.col("own").alias("idx"), *own, F.concat(F.array(_step("digests", "own")), "steps").alias("steps"), *passed)
    return rest.unionByName(lone.select("tree", "idx", *own, "steps", *passed))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["behind"]), 256))


def proof_digest(steps: Column) -> Column:
    """H of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["behind"])), ""), 256)


def proofs(rows: DataFrame) -> DataFrame:
    """rows(tree, doc_id, digest, ...) -> the same with idx, n, subroot, root and steps."""
    leaves = pin(placed(rows, ["doc_id", "digest"]))
    nodes = parents(leaves)
    subs = placed(tops(leaves, nodes).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")), ["name"])
    subs = pin(subs)
    over = parents(subs)
    none = F.array().cast(STEPS)
    start = tops(subs, over).select("tree", none.alias("steps"), F.col("top").alias("root"))
    above = pin(proved(subs, over, start).select(F.col("name").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"))
    return proved(leaves, nodes, above)


def manifest(docs: DataFrame, tampered: Column, changed: dict[str, Column], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` follows from the row as it is found later and the proof taken before: where ``tampered`` holds, the row
    has the values of ``changed`` in place of its own.
    """
    leaf = leaf_of(*(F.col(f) for f in fields))
    later = leaf_of(*(changed.get(f, F.col(f)) for f in fields))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree_of(F.col("source")).alias("tree"), leaf.alias("digest"), F.when(tampered, later).otherwise(leaf).alias("later"))
    out = proofs(pin(rows)).withColumn("folded_root", folded(F.col("later"), F.col("steps")))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def report(docs: DataFrame) -> DataFrame:
    """The manifest, with the text's A-Z lowered in every fifth document by its id's crc32."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(False))
    return manifest(docs, tampered, {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)})


def _sql(levels: int = 6, above: int = 4) -> str:
    """DuckDB's SQL: ``levels`` levels of the sources' trees and ``above`` of the tree over them (16 ** levels rows a source)."""
    from timberline.llm.periodic import CRC_SQL

    told = lambda x: f"coalesce(octet_length(encode({x}::varchar)) || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(text if f == "text" else f) for f in FIELDS) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        f"d as (select doc_id, coalesce('=' || source, '-') as tree, {leaf('text')} as leaf, case when {CRC_SQL.format(x='doc_id::varchar')}::bigint % 5 = 0 then {leaf(low)} else {leaf('text')} end as later from documents)",
        "a0 as (select doc_id, tree, leaf, later, row_number() over (partition by tree order by doc_id) - 1 as idx from d)",
        "x0 as (select tree, idx, leaf as digest from a0)",
    ]

    def climb(x: str, count: int) -> None:
        """Nodes of each level with what stands before and behind them; a level of one node is passed on as it is."""
        for k in range(count):
            group = "partition by tree, idx // 16"
            ahead = f"coalesce(string_agg(digest, '') over ({group} order by idx rows between unbounded preceding and 1 preceding), '')"
            behind = f"coalesce(string_agg(digest, '') over ({group} order by idx rows between 1 following and unbounded following), '')"
            parts.append(f"{x}s{k} as (select *, count(*) over (partition by tree) > 1 as real, {ahead} as l, {behind} as r from {x}{k})")
            parts.append(f"{x}{k + 1} as (select tree, idx // 16 as idx, case when bool_or(real) then sha256(string_agg(digest, '' order by idx)) else any_value(digest) end as digest from {x}s{k} group by 1, 2)")

    climb("x", levels)
    parts.append(f"y0 as (select '' as tree, row_number() over (order by tree) - 1 as idx, digest from x{levels})")
    parts.append(f"n0 as (select tree, row_number() over (order by tree) - 1 as place, digest as subroot from x{levels})")
    climb("y", above)
    steps = [("x", k, f"a.tree = x{k}_.tree and a.idx // {16**k} = x{k}_.idx") for k in range(levels)] + [("y", k, f"n.place // {16**k} = y{k}_.idx") for k in range(above)]
    joins = " ".join(f"join {x}s{k} {x}{k}_ on {on}" for x, k, on in steps)
    fold = "later"
    sides = []
    for x, k, _ in steps:
        name = f"{x}{k}_"
        fold = f"case when {name}.real then sha256({name}.l || {fold} || {name}.r) else {fold} end"
        sides.append(f"case when {name}.real then {name}.l || {name}.r else '' end")
    parts.append(
        f"z as (select doc_id, leaf, subroot, y.digest as root, sha256({' || '.join(sides)}) as proof_sha256, {fold} as folded_root from a0 a join n0 n using (tree) {joins}, y{above} y)"
    )
    return f"with {', '.join(parts)} select *, folded_root = root as verified from z"


SQL = _sql()
