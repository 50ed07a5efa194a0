"""Token ids as length-delimited binary records, with a separate offset index.

A file is a run of frames in ascending id order, and files follow each other in name order:

    u64 payload bytes | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | newline

    payload: i64 id | u8 1 if the id is null | u8 bytes per token (2 or 4) | u16 zero | token ids, little-endian

The mask is ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2^32, so that a checksum of data that hold checksums stays sound. Frames are
written by Spark's own writer through its commit protocol, into any file system that Spark reaches; the closing newline is the
writer's row separator. The index (file, seq, doc_id, at, size, n_tokens) is a table of its own, made from the frame headers. Files
follow each other by the numbers in their names. How many there are goes by the size of the table, so that a file, which is read whole,
stays far below the 2 GB that Spark can hold in one value, however large the table is.

Defined results: a null text is an empty one, its record holds the end id alone. A very long text is one record. Null ids come first.
Rows of one id are ordered by a hash of their text; equal rows, which may be many, are dealt over several files. An empty table gives
no records. Other columns are ignored, whatever their names. A damaged frame raises when read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactica.llm.common import map_arrow, scratch, short_batches
from redactica.llm.tokens import default_path, encoder

END_ID = 2
#: Bytes of the table, as it is stored, that one file of records is made of.
FILE_BYTES = 64 << 20
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qBBH")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not ids.size or ids.max() < 65536 else 4
    payload = _META.pack(doc_id or 0, doc_id is None, width, 0) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place of the payload, its bytes, all checked) of each frame in a file."""
    at = 0
    while at < len(data):
        size, check = _HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"damaged length at byte {at}")
        payload = data[at + 12 : at + 12 + size]
        if len(payload) != size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        yield at + 12, size, payload
        at += 17 + size


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, none, width, _ = _META.unpack_from(payload)
    return None if none else doc_id, np.frombuffer(payload, f"<u{width}", offset=_META.size)


def _parts(rows: DataFrame) -> int:
    """Files to write: by the size that the optimizer knows, and no fewer than there are shuffle partitions."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // FILE_BYTES)) if size < 1 << 60 else least  # beyond it the size is unknown


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes path/records and path/index."""
    spark, file = docs.sparkSession, tokenizer or default_path()
    short_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(_parts(docs), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, end = encoder(file), struct.pack("<I", end_id)
        made = [frame(i, np.frombuffer(ids + end, "<u4")) for i, ids in zip(batch.column(0).to_pylist(), enc.many(batch.column(1).to_pylist()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["frame"])

    map_arrow(rows.select("doc_id", "text"), one, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(f"{path}/records")

    def entries(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for seq, (at, size, payload) in enumerate(frames(data.as_py())):
                doc_id, ids = parsed(payload)
                out.append((name, seq, doc_id, at, size, len(ids)))
        return _batch(out, ["file", "seq", "doc_id", "at", "size", "n_tokens"], [pa.string(), *[pa.int64()] * 5])

    map_arrow(files(spark, path), entries, "file string, seq long, doc_id long, at long, size long, n_tokens long").write.parquet(f"{path}/index")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select(name.alias("file"), "content")


def place(file: str) -> list[Column]:
    """What files are ordered by: the numbers of the writer's task and of its file."""
    return [F.regexp_extract(file, pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, seq long, doc_id long, at long, size long, n_tokens long").parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) in the file order, every frame checked; start counts the ids of all records before."""
    before = Window.orderBy(*place("file")).rowsBetween(Window.unboundedPreceding, -1)
    base = index(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            at = 0
            for _, _, payload in frames(data.as_py()):
                doc_id, ids = parsed(payload)
                out.append((name, doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
        return _batch(out, ["file", "doc_id", "at", "n_tokens", "ids_crc32"], [pa.string(), *[pa.int64()] * 4])

    rows = map_arrow(files(spark, path), one, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """Rows (place, doc_id, ids) in an order drawn from the seed: the index says where each record lies and where it goes."""
    order = index(spark, path).select("file", F.struct(F.xxhash64("file", "seq", F.lit(seed)).alias("place"), "at", "size").alias("x")).groupBy("file").agg(F.collect_list("x").alias("want"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, want in zip(batch.column("content"), batch.column("want").to_pylist(), strict=True):
            data = data.as_py()
            for x in want:
                doc_id, ids = parsed(data[x["at"] : x["at"] + x["size"]])
                out.append((x["place"], doc_id, ids.tolist()))
        return _batch(out, ["place", "doc_id", "ids"], [pa.int64(), pa.int64(), pa.list_(pa.int32())])

    return map_arrow(files(spark, path).join(order, "file"), one, "place long, doc_id long, ids array<int>").orderBy("place")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "records")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path)
