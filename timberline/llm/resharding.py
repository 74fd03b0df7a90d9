"""Minimum-cost-flow resharding.

From the sizes of the old shards and the capacities of the new ones, a minimum-cost flow decides how many bytes go from
each old shard to each new one; bytes that stay in place cost nothing, so the flow moves the fewest. Each old shard is an
ordered line of blocks (groups of equal texts next to each other), the flow cuts it into stretches, and a stretch's rows
go to its new shard. Only the table of shard sizes and rows too large for a stretch (each over a ``1 / HEAVY`` share of all
bytes, so fewer than ``HEAVY``) reach the driver; such rows are placed one by one, the largest first, and the flow fills what
they leave, to one level.

The law that holds is ``bytes``: new shards differ by at most about one group of equal texts, or by what a single row is
larger than a shard. Equal texts stay together, unless they exceed a ``1 / HEAVY`` share of all rows or bytes: such a group
is dealt out row by row.

Sizes are the UTF-8 bytes of the text plus 1 (null: 1). Null and empty texts are equal to each other. Repeated rows, and
rows with a null id, each have a place of their own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.common import pin

#: A group with more than this share of the rows or bytes is divided; there are at most twice so many such groups.
HEAVY = 4000
#: Rows of a block, about.
BLOCK_ROWS = 20_000


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow from sources to sinks that meets all demand at the least cost, by successive shortest paths.

    ``cost(i, j)`` is that of a unit from source i to sink j. Total supply equals total demand.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # [to, capacity, cost, index of the reverse edge]

    def add(u: int, v: int, capacity: int, price: int) -> None:
        graph[u].append([v, capacity, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
        for j in range(m):
            add(i, n + j, s, cost(i, j))
    for j, d in enumerate(demand):
        add(n + j, sink, d, 0)
    potential = [0] * (n + m + 2)
    while True:
        best, via, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > best[u]:
                continue
            for k, (v, capacity, price, _) in enumerate(graph[u]):
                new = d + price + potential[u] - potential[v]
                if capacity and new < best.get(v, 1 << 62):
                    best[v], via[v] = new, (u, k)
                    heapq.heappush(queue, (new, v))
        if sink not in best:
            break
        for v, d in best.items():
            potential[v] += d
        push, v = 1 << 62, sink
        while v != source:
            u, k = via[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = via[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    return {(i, v - n): graph[v][back][1] for i in range(n) for v, _, _, back in graph[i] if n <= v < n + m and graph[v][back][1]}


def transfers(old: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, from, to, new shard): stretches of each old shard's bytes; those that stay come first."""
    shards = sorted(old)
    flow = min_cost_flow([old[s] for s in shards], capacities, lambda i, j: 0 if shards[i] == j else 1)
    out = []
    for i, s in enumerate(shards):
        at = 0
        for j in sorted((j for k, j in flow if k == i), key=lambda j: (j != s, j)):
            out.append((s, at, at + flow[i, j], j))
            at += flow[i, j]
    return out


def near_equal(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def levelled(total: int, taken: list[int]) -> list[int]:
    """How much more each part takes so that ``total`` is used up and the fullness of the parts is as equal as can be."""
    order = sorted(range(len(taken)), key=lambda j: (taken[j], j))
    left, more = total, [0] * len(taken)
    # The emptiest parts are filled to one level; parts above it take nothing.
    count = next(k for k in range(1, len(order) + 1) if k == len(order) or sum(taken[order[k]] - taken[j] for j in order[:k]) >= left)
    level = sum(taken[j] for j in order[:count]) + left
    for j, height in zip(order[:count], near_equal(level, count)):
        more[j] = height - taken[j]
    over = -sum(min(m, 0) for m in more)  # rounding may put a part one below what it holds
    more = [max(m, 0) for m in more]
    for j in order:
        cut = min(over, more[j])
        more[j], over = more[j] - cut, over - cut
    return more


def placed(large: list, parts: int, total: int) -> dict[int, int]:
    """{row: new shard} of the largest rows: each stays where it is while that has room, else it goes to the emptiest shard."""
    load, out = [0] * parts, {}
    for r in sorted(large, key=lambda r: (-r.size, r.row)):
        j = r.old if r.old < parts and load[r.old] + r.size <= total // parts else min(range(parts), key=lambda j: (load[j], j))
        load[j] += r.size
        out[r.row] = j
    return out


def settled(rows: DataFrame, capacities: list[int], candidates: int = 200) -> DataFrame:
    """Evens out what rows that straddle a cut have left, by moving single rows from the fullest to the emptiest shard.

    Chooses among at most ``candidates`` rows of each shard, whose texts occur once.
    """
    over = {r.shard: r.bytes - capacities[r.shard] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    over = {j: over.get(j, -c) for j, c in enumerate(capacities)}
    few = rows.where("alone").withColumn("h", F.xxhash64("row", F.lit("few")))
    # A bounded number of each shard: aggregated, so that no window sees a whole shard.
    few = few.withColumn("bin", F.pmod("h", F.lit(candidates))).groupBy("shard", "bin").agg(F.min_by(F.struct("row", "size"), "h").alias("x"))
    at_hand: dict[int, list] = {j: [] for j in over}
    for r in sorted(few.collect(), key=lambda r: (r.shard, r.bin)):
        at_hand[r.shard].append(r.x)
    moves = []
    for _ in range(candidates):
        full, empty = max(over, key=lambda j: (over[j], j)), min(over, key=lambda j: (over[j], j))
        gap = over[full] - over[empty]
        fit = [x for x in at_hand[full] if 0 < x.size < gap]
        if not fit:
            break
        x = min(fit, key=lambda x: abs(2 * x.size - gap))
        at_hand[full].remove(x)
        over[full] -= x.size
        over[empty] += x.size
        moves.append((x.row, empty))
    if not moves:
        return rows.drop("alone")
    moved = rows.sparkSession.createDataFrame(moves, "row long, anew int")
    # At most ``candidates`` rows.
    rows = rows.join(F.broadcast(moved), "row", "left").withColumn("shard", F.coalesce("anew", "shard"))
    return rows.drop("alone", "anew")


def reshard(rows: DataFrame, shards: int) -> DataFrame:
    """rows(row, doc_id, size, text_crc32, group, old), ``row`` distinct -> the same with ``shard`` and ``slot``, and nothing
    moved without need."""
    rows = pin(rows)
    total_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total // HEAVY
    large = rows.where(F.col("size") > share).where(F.lit(total > 100 * HEAVY)).select("row", "size", "old").collect()  # fewer than HEAVY
    fixed = placed(large, shards, total)
    held = [0] * shards
    for r in large:
        held[fixed[r.row]] += r.size
    sizes = {r.old: r.bytes for r in rows.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}  # one row for each old shard
    for r in large:
        sizes[r.old] -= r.size
    room = levelled(sum(sizes.values()), held)
    cuts = transfers(sizes, room)
    counts = rows.groupBy("group").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"))
    counts = counts.where((F.col("copies") * HEAVY > total_rows) | (F.col("bytes") > max(share, 1)) & (F.col("copies") > 1)).select("group", F.lit(True).alias("heavy"))
    # At most HEAVY groups can each hold more than a HEAVY-th of the rows, and HEAVY of the bytes.
    rows = rows.join(F.broadcast(counts), "group", "left")
    # Rows placed one by one, fewer than HEAVY, take no part of a stretch.
    named = rows.sparkSession.createDataFrame(list(fixed.items()), "row long, own int")
    rows = rows.join(F.broadcast(named), "row", "left")
    blocks = max(1, total_rows // BLOCK_ROWS)
    # The rows of a heavy group are dealt out by their numbers; every other group lies in one block.
    place = F.when(F.col("heavy"), F.xxhash64("group", "row")).otherwise(F.col("group"))
    rows = rows.withColumn("place", place).withColumn("block", F.pmod("place", F.lit(blocks))).withColumn("counted", F.when(F.col("own").isNull(), F.col("size")).otherwise(0))
    # Where a row's group starts within its block, and where the block starts within its old shard.
    inner = "(partition by old, block order by place {})"
    rows = rows.selectExpr(
        "row", "doc_id", "size", "text_crc32", "old", "block", "place", "own", "counted",
        f"sum(counted) over {inner.format('range between unbounded preceding and current row')} - sum(counted) over (partition by old, block, place) as inside",
        "own is null and count(*) over (partition by old, block, place) = 1 as alone",
    )
    starts = rows.groupBy("old", "block").agg(F.sum("counted").alias("bytes"))
    starts = starts.selectExpr("old", "block", "sum(bytes) over (partition by old order by block) - bytes as base")
    rows = rows.join(starts, ["old", "block"]).withColumn("at", F.col("base") + F.col("inside"))
    # Stretches: at most old shards x new shards.
    shard = F.lit(None).cast("int")
    for s, low, high, new in cuts:
        shard = F.when((F.col("old") == s) & (F.col("at") >= low) & (F.col("at") < high), new).otherwise(shard)
    rows = pin(rows.select("row", "doc_id", "size", "text_crc32", "old", "block", "place", "alone", F.coalesce("own", shard).alias("shard")))
    rows = settled(rows, [h + r for h, r in zip(held, room)])
    before = rows.groupBy("shard", "old", "block").count()
    before = before.selectExpr("shard", "old", "block", "sum(count) over (partition by shard order by old, block) - count as before")
    return rows.join(before, ["shard", "old", "block"]).selectExpr(
        "row", "doc_id", "size", "text_crc32", "old", "shard",
        "before + row_number() over (partition by shard, old, block order by place, row) - 1 as slot",
    )


def lean(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, size, text_crc32, group and old of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"), old.cast("int").alias("old"),
    )


def by_content(shards: int, text_col: str = "text") -> Column:
    """The old shard of a row where a corpus is stored by its texts' hashes."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("shard")), F.lit(shards))


def assign(docs: DataFrame, old_shards: int = 6, new_shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard."""
    out = reshard(lean(docs, by_content(old_shards)), new_shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"),
    )


#: Columns that stored shards have besides those of the documents.
OWN = ("_shard", "_row", "_size", "_crc", "_group")


def store(docs: DataFrame, path: str, shards: int) -> None:
    """Writes the documents as shards under ``path``, each row with a number of its own and what resharding needs to know."""
    rows = docs.withColumns({"_row": F.monotonically_increasing_id(), "_shard": by_content(shards).cast("int"), **{own: _expression(name) for own, name in (("_size", "size"), ("_crc", "crc"), ("_group", "group"))}})
    rows.repartition("_shard").write.partitionBy("_shard").parquet(path)


def _expression(name: str) -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"size": (F.octet_length(text) + 1).cast("long"), "crc": F.crc32(text), "group": F.xxhash64(text)}[name]


def reassign(spark, path: str, shards: int) -> DataFrame:
    """row, old, shard, slot, ... of the rows of stored shards, from their facts alone: texts aren't read."""
    stored = spark.read.parquet(path)
    rows = stored.select(F.col("_row").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_group").alias("group"), F.col("_shard").alias("old"))
    return pin(reshard(rows, shards))


def rewrite(spark, old_path: str, new_path: str, moved: DataFrame) -> list[int]:
    """Writes the shards that rows leave or enter under ``new_path``, in slot order, and returns their numbers.

    The other shards keep their files under ``old_path``, which are neither read nor written: the folders of the shards
    concerned are read by name.
    """
    touched = sorted({r[0] for r in moved.where("shard <> old").select(F.explode(F.array("shard", "old"))).distinct().collect()})
    if not touched:
        return []
    stored = spark.read.parquet(old_path).where(F.col("_shard").isin(touched))  # whole folders
    places = moved.where(F.col("old").isin(touched)).select(F.col("row").alias("_row"), F.col("shard").alias("_new"), F.col("slot").alias("_slot"))
    rows = stored.drop("_shard", "_slot").join(places, "_row").withColumnRenamed("_new", "_shard")
    rows.repartition("_shard", F.floor(F.col("_slot") / 100_000)).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(new_path)
    return touched
