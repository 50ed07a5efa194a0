"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 cells. Every shard has many virtual nodes at hashed cells; a row's key hashes to a cell, whose home is the next
node clockwise. A shard takes no more rows than its quota: rows beyond it go on clockwise to the next node whose shard has room, so
balance is guaranteed, and one shard more or less moves few rows besides its own. With no slack the quotas add up to the rows and
counts are at most one apart.

The driver sees one count per cell, however many rows there are, and plans there: a cell is dealt out in few runs of its rows in
hash order (each shard that fills up splits one). The rows are ranked within their cell and look their run up; texts never move. A hot
cell, as of one id that very many rows share, is ranked in parts: its rows are dealt over them, and the driver sees one count per part.

Defined results: a null text has no bytes, size 1 and checksum 0; very long texts are only measured. Rows without an id have one key.
Rows with one key share a cell and are told apart by size and checksum only; equal rows are interchangeable. An empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactica.llm.common import stored

CELL_BITS = 16
NODES = 256
#: A cell is hot with so many rows, if that is also many times the mean; its rows are ranked in so many parts.
HOT_ROWS, HOT_TIMES, HOT_PARTS = 100_000, 8, 64


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """(cell, shard) of all virtual nodes, clockwise."""
    placed = sorted((xxhash.xxh64_intdigest(f"{s}/{v}"), s) for s in range(shards) for v in range(nodes))
    return np.array([h >> (64 - CELL_BITS) for h, _ in placed]), np.array([s for _, s in placed])


def quotas(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [int(np.ceil(rows * (1 + slack) / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, slack: float = 0.0, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) of all runs."""
    cells, owners = ring(shards, nodes)
    room, used = quotas(sum(counts.values()), shards, slack), [0] * shards
    ordered = sorted(counts)
    waiting = [(c, 0, counts[c], int(k) % len(owners)) for c, k in zip(ordered, np.searchsorted(cells, ordered), strict=True)]
    runs = []
    while waiting:
        onward = []
        for cell, lo, hi, node in waiting:
            shard = int(owners[node])
            n = min(hi - lo, room[shard] - used[shard])
            if n:
                runs.append((cell, lo, lo + n, shard, used[shard]))
                used[shard] += n
            if lo + n < hi:
                onward.append((cell, lo + n, hi, (node + 1) % len(owners)))
        waiting = onward
    return runs


def shard_rows(docs: DataFrame, shards: int = 16, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot)."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int"))
    rows = stored(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS)).cast("int")), "keys")
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    least = max(hot_rows, HOT_TIMES * sum(counts.values()) >> CELL_BITS)
    hot = sorted(c for c, n in counts.items() if n >= least)
    before: list[tuple[int, int, int]] = []
    own = F.lit(0)
    if hot:
        own = F.when(F.col("cell").isin(hot), F.col("part")).otherwise(0)
        at: dict[int, int] = {}
        for cell, part, n in sorted(rows.filter(F.col("cell").isin(hot)).groupBy("cell", "part").count().collect()):
            before.append((cell, part, at.get(cell, 0)))
            at[cell] = at.get(cell, 0) + n
    ranked = rows.withColumn("part", own).withColumn("rank", F.row_number().over(Window.partitionBy("cell", "part").orderBy("h", "doc_id", "text_crc32", "size")) - 1)
    if hot:
        starts = spark.createDataFrame(before, "cell int, part int, before long")
        ranked = ranked.join(F.broadcast(starts), ["cell", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    runs = spark.createDataFrame(plan(counts, shards, slack, nodes), "at_cell int, lo long, hi long, shard int, base long")
    found = ranked.join(F.broadcast(runs), (F.col("cell") == F.col("at_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
