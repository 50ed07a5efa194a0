"""Shared helpers: Arrow mapping, filters of fixed size, connected components; scratch tables are those of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactica.sources.scratch import file_system, stored
from redactica.sources.scratch import folder as scratch

#: Rows in one Arrow batch; texts can be very long, so batches are kept short.
BATCH_ROWS = 1000
#: Longer words are hashed one by one.
LONG_WORD = 512
#: Bits of one row of a filter that comes to the driver, and of a whole filter of ids.
BLOCK_BITS = 1 << 20
ID_BITS = 1 << 26
_ODD = 0x9E3779B97F4A7C15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def short_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch for functions over whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(each, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of words, eight bytes at a time; data has eight bytes more than the last word."""
    blocks = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    a = mixed(sizes.astype(np.uint64) + np.uint64(0x8CB92BA72F3D8DD7))
    b = mixed(sizes.astype(np.uint64) + np.uint64(0x589965CC75374CC3))
    at, left, own = starts, sizes, slice(None)
    while len(at):
        x = blocks[at] & _MASK[np.minimum(left, 8)]
        a[own] = mixed((a[own] ^ x) * np.uint64(0xA0761D6478BD642F))
        b[own] = mixed((b[own] + x) * np.uint64(0xE7037ED1A0B428DB))
        going = np.flatnonzero((left > 8) & (left <= LONG_WORD) | (left > 8) & (at > starts[own]))
        own = going if isinstance(own, slice) else own[going]
        at, left = at[going] + 8, left[going] - 8
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        d = xxhash.xxh3_128_intdigest(data[starts[i] : starts[i] + sizes[i]])
        a[i], b[i] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
    return a, b


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive items, by doubling."""
    out, width, power, taken, left = None, 1, _ODD, 0, h
    while True:
        if k & width:
            if out is None:
                out, taken = left, width
            else:
                n = len(h) - (taken + width) + 1
                out, taken = out[:n] * np.uint64(power) + left[taken : taken + n], taken + width
        if 2 * width > k:
            return mixed(out)
        left = left[:-width] * np.uint64(power) + left[width:]
        width, power = 2 * width, power * power & 0xFFFFFFFFFFFFFFFF


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Bit (m mod bits) of all rows (m: a hash), built in tasks and put together on the driver: an eighth of `bits` bytes at any size.

    It lets too much pass when it is too small, but never too little, so an exact join can follow a cheap selection."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy() & (bits - 1)
            for block in np.unique(slot // BLOCK_BITS).tolist():
                own = slot[slot // BLOCK_BITS == block] % BLOCK_BITS
                if block not in held:
                    held[block] = np.zeros(BLOCK_BITS // 64, np.uint64)
                np.bitwise_or.at(held[block], own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["block", "bits"])

    out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 64), np.uint64)
    by_block = keys.select("m").repartition(F.shiftrightunsigned(F.col("m").bitwiseAND(F.lit(bits - 1)), BLOCK_BITS.bit_length() - 1))
    for block, data in by_block.mapInArrow(blocks, "block long, bits binary").toLocalIterator():
        out[block] |= np.frombuffer(bytes(data), np.uint64)
    return out.reshape(-1)


def in_filter(bits: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which hashes are in a filter."""
    slot = m & np.uint64(64 * len(bits) - 1)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def parted(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = ID_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that may have their like in keys, rows that surely have none): a filter of keys tells them apart without a shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(key_filter(keys.select(F.xxhash64(*on).alias("m")), bits))

    def kept(want: bool) -> DataFrame:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = in_filter(shared.value, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)) == want
            return pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep))

        return map_arrow(rows.withColumn("_m", F.xxhash64(*on)), one, rows.schema)

    return kept(True), kept(False)


def selected(rows: DataFrame, keys: DataFrame, bits: int = ID_BITS) -> DataFrame:
    """Inner join on id of rows with long texts and keys (id, ...): a filter of ids picks the rows before they are shuffled."""
    return parted(rows, keys, ["id"], bits)[0].join(keys.hint("merge"), "id")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a: long, b: long): rows (node, component), component being the smallest node reachable.

    Rounds of small stars and pointer jumps. Each round keeps, for every node, its smallest neighbour as parent, links the other
    neighbours to that parent and replaces the parent by the parent's parent. The rounds are of the order of the logarithm of the
    longest chain; minima combine before the shuffle, and joins on a frequent parent are split at run time. Self-links and nulls drop.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    graph = stored(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        parents = stored(graph.groupBy("u").agg(F.min("v").alias("p"), F.count(F.lit(1)).alias("n")), "parents")
        rest = graph.join(parents.filter("n > 1").select("u", "p"), "u").filter("v <> p").select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"))
        upper = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = parents.select("u", "p").join(upper, "p", "left")
        graph = stored(jumped.select("u", F.coalesce("pp", "p").alias("v"), F.col("pp").isNotNull().alias("moved")).unionByName(rest.select("u", "v", F.lit(True).alias("moved"))).groupBy("u", "v").agg(F.max("moved").alias("moved")), "graph")
        if graph.filter("moved").isEmpty():
            break
        graph = graph.select("u", "v")
    flat = graph.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.unionByName(flat.select(F.col("component").alias("node"), "component").distinct())
