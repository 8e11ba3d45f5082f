"""Resharding by minimum-cost flow, then rewriting of the affected files.

Old shards supply their bytes, new shards take their capacities, a byte that stays in its shard
costs nothing and a byte that moves costs one: the cheapest flow, found by successive shortest
paths over shards (never rows), says how many bytes go from which shard to which. Within an old
shard the documents stand in the order of a seeded hash, cut into blocks of about ``BLOCK_BYTES``; the
flow cuts that line into stretches, and a document belongs to the stretch that its middle lies in.
Blocks that lie within one stretch move whole; only blocks with a cut are looked at row by row.

Only shards that lose or gain documents are written again; the others stay where they are.

Edge cases: a null text has size 1 and an empty CRC; null ids and equal rows are rows like others
(ordered by hash, id and text hash; rows equal in all three are interchangeable); a document is
never split, so a very long one can put a shard off balance by its own size; an empty table gives
an empty result; extra columns pass through ``rewrite``, whatever their names. Equal texts are not kept in
one shard: the law is about bytes, and a group of copies may be larger than a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table

#: Fixed values of the query: documents are dealt by id over OLD shards and go to NEW ones.
OLD, NEW = 12, 16
BLOCK_BYTES = 1 << 20
BROADCAST_BLOCKS = 50_000  # about 100 bytes each; longer plans are joined by shuffle


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one: all supply is placed, no capacity is exceeded, fewest bytes move.

    Successive shortest augmenting paths with potentials over the bipartite graph of shards.
    """
    n, m = len(supply), len(capacity)
    source, sink, nodes = n + m, n + m + 1, n + m + 2
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, left, cost = [], [], []

    def arc(u: int, v: int, most: int, price: int) -> None:
        for a, b, c, p in ((u, v, most, price), (v, u, 0, -price)):
            graph[a].append(len(to))
            to.append(b)
            left.append(c)
            cost.append(p)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, 0 if i == j else 1)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    potential = [0] * nodes
    while True:
        far = [float("inf")] * nodes
        far[source], via, heap = 0, [-1] * nodes, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                if left[e] and (x := d + cost[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if far[sink] == float("inf"):
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount
    if sum(left[e] for e in graph[source] if not e & 1):
        raise ValueError("the capacities do not hold all bytes")
    return {(i, j): left[e ^ 1] for i in range(n) for e in graph[i] if not e & 1 and (j := to[e] - n) >= 0 and left[e ^ 1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


#: Names of the columns that are added to the caller's.
OF, SIZE, HASH, BLOCK, SHARD, PLACE = "reshard_old", "reshard_size", "reshard_hash", "reshard_block", "reshard_new", "reshard_place"


def sized(docs: DataFrame, old_shard: Column) -> DataFrame:
    """Add the old shard, the size (UTF-8 bytes of ``text`` plus 1) and the hash that orders documents within a shard."""
    return docs.withColumns({OF: old_shard.cast("int"), SIZE: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, HASH: F.xxhash64("doc_id", "text")})


def plan_moves(rows: DataFrame, shards: int, capacities: list[int] | None = None, old_shards: int | None = None) -> tuple[DataFrame, dict[tuple[int, int], int], int]:
    """(old shard, block, where it begins, cuts) of every block, the flow, and the blocks of a shard.

    Cuts are the stretches of the shard's line that the block meets: (from, shard).
    """
    spark = rows.sparkSession
    totals = {r[0]: int(r[1]) for r in rows.groupBy(OF).agg(F.sum(SIZE)).collect()}  # one row for each shard
    old = max(old_shards or 0, 1 + max(totals, default=0))
    supply = [totals.get(i, 0) for i in range(old)]
    flow = min_cost_flow(supply, capacities or equal_capacities(sum(supply), shards))
    blocks = max(16, -(-max(supply, default=0) // BLOCK_BYTES))
    cuts = []
    for i in range(old):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):  # what stays comes first
            cuts.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    line = spark.createDataFrame(cuts, "_of int, from long, upto long, shard int")
    sums = rows.groupBy(OF, block_of(blocks).alias(BLOCK)).agg(F.sum(SIZE).alias("_bytes"))
    start = F.coalesce(F.sum("_bytes").over(Window.partitionBy(OF).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("_start", start)
    met = placed.join(F.broadcast(line), (F.col(OF) == F.col("_of")) & (F.col("from") < F.col("_start") + F.col("_bytes")) & (F.col("upto") > F.col("_start")))
    plan = met.groupBy(OF, BLOCK, "_start").agg(F.array_sort(F.collect_list(F.struct("from", "shard"))).alias("_cuts"))
    return plan, flow, blocks


def block_of(blocks: int) -> Column:
    """Blocks follow the order of the hash, so that a block is a stretch of its shard's line."""
    return F.least(F.floor((F.col(HASH).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * blocks), F.lit(blocks - 1)).cast("int")


def _short(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_BLOCKS else plan


def assign(rows: DataFrame, shards: int, capacities: list[int] | None = None, old_shards: int | None = None) -> tuple[DataFrame, set[int], set[int]]:
    """``rows`` of ``sized`` with the new shard and the place within (new shard, old shard, block), the shards that lose or gain something, and those that keep all they have."""
    slim = materialize(rows.select(OF, SIZE, HASH), "reshard-sizes")
    plan, flow, blocks = plan_moves(slim, shards, capacities, old_shards)
    changed = {x for i, j in flow if i != j for x in (i, j)}
    known = rows.withColumn(BLOCK, block_of(blocks)).join(_short(materialize(plan, "reshard-plan")), [OF, BLOCK])
    order = Window.partitionBy(OF, BLOCK).orderBy(HASH, "doc_id", SIZE)
    middle = F.col("_start") + F.coalesce(F.sum(SIZE).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.expr(f"{SIZE} div 2")
    home = F.element_at(F.filter("_cuts", lambda c: c["from"] <= F.col("_middle")), -1)["shard"]
    placed = known.withColumn("_middle", middle).withColumn(SHARD, F.coalesce(home, F.col("_cuts")[0]["shard"]))
    place = F.row_number().over(Window.partitionBy(OF, BLOCK, SHARD).orderBy(HASH, "doc_id", SIZE)) - 1
    return placed.withColumn(PLACE, place).drop("_middle", "_cuts", "_start"), changed, {i for i, _ in flow} - changed


def with_slots(placed: DataFrame) -> DataFrame:
    """Turn the place within (shard, old shard, block) into ``slot``, the place within the shard, by sums over blocks."""
    counts = placed.groupBy(SHARD, OF, BLOCK).agg((F.max(PLACE) + 1).cast("long").alias("_rows"))
    base = F.coalesce(F.sum("_rows").over(Window.partitionBy(SHARD).orderBy(OF, BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(counts.withColumn("_base", base).select(SHARD, OF, BLOCK, "_base"), "reshard-bases")
    return placed.join(_short(bases), [SHARD, OF, BLOCK]).withColumn("slot", (F.col("_base") + F.col(PLACE)).cast("long")).drop("_base")


def rewrite(docs: DataFrame, old_shard: Column, path: str, shards: int, capacities: list[int] | None = None, old_shards: int | None = None) -> DataFrame:
    """Write the documents of every shard that loses or gains some under ``path/reshard_new=N``.

    Returns all documents with their new shard: what was written, read back, and what stays in its old files.
    """
    placed, changed, kept = assign(sized(docs, old_shard), shards, capacities, old_shards)
    placed = placed.drop(HASH)
    moved = placed.filter(F.col(SHARD).isin(*changed)) if kept else placed
    moved.write.option("compression", "zstd").partitionBy(SHARD).parquet(path)
    written = docs.sparkSession.read.schema(placed.schema).parquet(path).select(*placed.columns)
    return written.unionByName(placed.filter(F.col(SHARD).isin(*kept))) if kept else written


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "shards")
    files = rewrite(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(OLD)), path, NEW, old_shards=OLD)
    out = with_slots(files.select("doc_id", F.col(SIZE).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), SHARD, OF, BLOCK, PLACE))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col(SHARD).cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
