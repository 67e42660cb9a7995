"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into cells of equal width. Each shard owns the cells before its virtual nodes, clockwise. Rows are
counted by cell; only these counts, at most CELLS of them, reach the driver. There one walk around the ring lets every
shard keep its own rows up to its load, and hands the rest to the next virtual node whose shard has room. The walk
yields runs of ranks within a cell, and each row finds its run by a join.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from hashlib import md5

from pyspark.sql import DataFrame, functions as F, Window

from lumigrid.session import table

SHARDS = 24
VIRTUAL_NODES = 128
CELLS = 1 << 14


def ring(shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise; nodes of a shard do not depend on how many shards there are."""
    place = lambda s, v: int.from_bytes(md5(f"{s}/{v}".encode()).digest()[:8], "big") % cells
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def assign_runs(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end, shard, first slot) for rows counted by cell.

    Loads: all rows over all shards, rounded up for the first shards and down for the others, so counts are at most one
    apart. A shard keeps its own rows in ring order; what does not fit goes clockwise, first come first served.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slots = [0] * shards
    runs: list[tuple[int, int, int, int, int]] = []

    def keep(cell: int, first: int, most: int, shard: int) -> int:
        n = min(most, room[shard])
        if n:
            runs.append((cell, first, first + n, shard, slots[shard]))
            room[shard] -= n
            slots[shard] += n
        return n

    places = [cell for cell, _ in nodes]
    over: dict[int, list[tuple[int, int, int]]] = {}
    for cell in sorted(counts):
        at = bisect_left(places, cell) % len(nodes)
        n = keep(cell, 0, counts[cell], nodes[at][1])
        if n < counts[cell]:
            over.setdefault(at, []).append((cell, n, counts[cell]))
    carried: deque[tuple[int, int, int]] = deque()
    for lap in (0, 1):
        for at, (_, shard) in enumerate(nodes):
            while carried and room[shard]:
                cell, first, end = carried.popleft()
                n = keep(cell, first, end - first, shard)
                if first + n < end:
                    carried.appendleft((cell, first + n, end))
            if lap == 0:
                carried.extend(over.get(at, ()))
    return runs


def shard_rows(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> DataFrame:
    """Every row of docs (doc_id, text) in a shard, by law `rows`: counts are at most one apart, slots have no gaps.

    The key is doc_id; for a null doc_id the text. A null text has no bytes. Repeated rows are each placed. No rows
    give no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    position = F.xxhash64(F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(F.col("doc_id").cast("string")))
    cell = F.shiftrightunsigned(position, 64 - (cells.bit_length() - 1)).cast("int").alias("cell")
    counts = {r["cell"]: r["count"] for r in docs.select(cell).groupBy("cell").count().collect()}
    runs = spark.createDataFrame(assign_runs(counts, ring(shards, virtual_nodes, cells), shards), "cell int, first long, end long, shard int, base long")
    rows = docs.select(
        F.col("doc_id"),
        cell,
        position.alias("position"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
    )
    order = Window.partitionBy("cell").orderBy("position", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    # at most cells + shards * virtual_nodes + shards runs
    placed = ranked.join(F.broadcast(runs), "cell").where("rank >= first and rank < end")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23."""
    return shard_rows(table(spark, sf_dir, "documents"))
