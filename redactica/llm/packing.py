"""Best-fit packing by hierarchical residual merging.

Every document becomes token ids and an end id; longer ones than a sequence are cut so that all pieces but the first are full. The
pieces, without their ids, are dealt out evenly; each part is packed best-fit, longest first. Nearly full bins are final. A part
hands up its bins of at most half the capacity (best fit leaves one at most) and as many of the emptiest others as a merge has
parts: no merge can ever fill more, so the items of a merge stay bounded while none of its savings is lost. Groups of parts merge
these bins as items, again best-fit, and hand up what is left, until one group remains. Only bins move, never pieces.

Defined results: a null text is empty, its one piece holds the end id alone; a very long one is cut into as many pieces as it needs.
Repeated rows, and rows without an id, are packed each. Of equally long pieces the one that comes first is placed first. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactica.llm.common import map_arrow, short_batches, stored
from redactica.llm.tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces in a part, and parts in a merge.
PART_ROWS = 50_000
FAN_IN = 16


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids])."""
    short_batches(docs.sparkSession)
    file = tokenizer or default_path()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, end = encoder(file), struct.pack("<I", end_id)
        out: list[tuple] = []
        for i, ids in zip(batch.column(0).to_pylist(), enc.many(batch.column(1).to_pylist()), strict=True):
            ids += end
            for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * s : 4 * (s + n)]
                out.append((i, k, s, n, zlib.crc32(own), own))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names[: len(kinds)])

    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), one, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each item, longest first into the fullest bin that takes it, and the bins' fill."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin has room r
    placed, fill = [(0, 0)] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        above = some >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        placed[i] = (b, fill[b])
        fill[b] += n
        room[r - n].append(b)
        some |= 1 << (r - n)
    return placed, fill


def handed_up(fill: list[int], capacity: int, fan_in: int) -> list[int]:
    """Bins that a merge above may still fill, or fill others with."""
    small = [b for b, f in enumerate(fill) if 2 * f <= capacity]
    others = sorted((b for b, f in enumerate(fill) if capacity > f > capacity // 2), key=lambda b: fill[b])
    return small + others[:fan_in]


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Adds (sequence_id, offset) to rows with a `length` of 1 to capacity."""
    spark = items.sparkSession
    parts = max(1, -(-items.count() // part_rows))
    schema = items.schema.simpleString()[7:-1]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part, table = TaskContext.get().partitionId(), pa.Table.from_batches(held).combine_chunks()
        placed, fill = best_fit(table.column("length").to_pylist(), capacity)
        up = set(handed_up(fill, capacity, fan_in))
        batch = table.to_batches()[0]
        extra = [pa.array([(part << 32) + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64()), pa.array([fill[b] if b in up and not o else None for b, o in placed], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "bin", "at", "open"])

    packed = stored(items.repartition(parts).mapInArrow(local, f"{schema},bin:bigint,at:bigint,open:bigint"), "packed")
    bins = packed.filter("open is not null").select("bin", F.col("open").alias("fill"), F.shiftright("bin", 32).alias("grp"))
    moved: DataFrame | None = None
    level = 0
    while parts > 1:
        parts, level = -(-parts // fan_in), level + 1
        merged = stored(bins.withColumn("grp", F.expr(f"grp div {fan_in}")).groupBy("grp").applyInPandas(_merge(capacity, fan_in, level), "bin long, into long, shift long, fill long, grp long"), "merged")
        step = merged.select(F.col("bin"), F.col("into"), F.col("shift"))
        bins = merged.filter("fill is not null").select(F.col("into").alias("bin"), "fill", "grp")
        if moved is None:
            moved = step
        else:
            then = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(then, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    kept = [packed[c] for c in items.columns]
    if moved is None:
        return packed.select(*kept, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    out = packed.join(moved, "bin", "left")
    return out.select(*kept, F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _merge(capacity: int, fan_in: int, level: int):
    def merge(rows):
        rows = rows.sort_values("bin")
        placed, fill = best_fit(rows["fill"].tolist(), capacity)
        names = rows["bin"].tolist()
        first = {b: names[i] for i, (b, o) in enumerate(placed) if o == 0}
        up = set(handed_up(fill, capacity, fan_in))
        return rows.assign(into=[first[b] for b, _ in placed], shift=[o for _, o in placed], fill=[fill[b] if b in up and not o else None for b, o in placed])[["bin", "into", "shift", "fill", "grp"]].astype({"fill": "Int64"})

    return merge


def best_fit_sequences(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return pack(stored(pieces(docs, id_col, text_col, capacity, tokenizer, end_id, with_ids), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
