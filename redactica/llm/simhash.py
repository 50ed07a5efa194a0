"""Near-duplicates by 64-bit SimHash, linked through pivot distance tables.

A fingerprint is the majority vote of the XXH64 hashes of all word shingles. Only distinct fingerprints are compared, so exact
copies never meet. A table is written with each distinct fingerprint's Hamming distances to many reference fingerprints. Two
fingerprints that differ in at most three bits agree in at least two of five bands, so rows of the table meet where the bits of two
bands are equal. There they are sorted by the distance to the first reference and compared in a sliding window of three; a pair is
discarded as soon as one coordinate differs by more than three (the triangle inequality makes that safe), and the survivors are
verified by their exact distance. A key with many fingerprints is taken apart: at most three of its other bits differ, so of four parts
of them one is equal, and rows meet under each of the four longer keys instead, up to twice. A key that is still large, as when
thousands of texts differ in a few bits only, is cut into blocks, and each pair of blocks is a task of its own, so no group meets in
one task. A task emits a spanning star of each group it has linked, never its pairs.

Defined results: a text without words, or null, has fingerprint zero. A very long text is read whole. Rows with equal fingerprints
share a component, named by its smallest id; rows without an id are never its name, and without any other it has none. Rows of one id
with different texts are documents of their own. Repeated rows give a row each; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.llm.common import components, map_arrow, short_batches, stored

SHINGLE = 3
SEED = 42
DIFFERING = 3
#: Reference fingerprints; eight distances fill one column of the table.
PIVOTS = 24
#: Fingerprints under one key; a key with more is taken apart.
BLOCK = 2048
#: How often a large key is taken apart before it is cut into blocks.
LEVELS = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(last)
    for k in range(0, n, 65536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + 65536], last[k : k + 65536], strict=False)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, text_hash, fp): the fingerprint as a signed long."""
    short_batches(docs.sparkSession)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_hash(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(rows, one, "doc_id long, text_hash long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints from a fixed generator."""
    return [xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(n)]


def band_masks(differing: int = DIFFERING, spare: int = 2) -> list[int]:
    """Masks of which at least one has no differing bit, as `differing` bits touch so many of the bands at most."""
    n = differing + spare
    edges = [round(64 * i / n) for i in range(n + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(bands, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def contract(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes can reach by links a-b."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def pivot_table(fps: DataFrame, n: int = PIVOTS) -> DataFrame:
    """Adds the distances to n references, a byte each, to rows with a fingerprint `fp`."""
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("long") for r in pivots(n)]
    return fps.withColumns({f"p{i}": sum((F.shiftleft(d, 8 * k) for k, d in enumerate(far[8 * i : 8 * i + 8])), F.lit(0).cast("long")) for i in range(n // 8)})


def finer(mask: int, differing: int = DIFFERING) -> list[int]:
    """The mask with each part of its other bits: as `differing` of these differ at most, one part is equal."""
    others = [1 << b for b in range(64) if not mask >> b & 1]
    n = differing + 1
    return [mask | sum(others[i * len(others) // n : (i + 1) * len(others) // n]) for i in range(n)]


def linked(group: np.ndarray, fp: np.ndarray, differing: int, table: np.ndarray) -> np.ndarray:
    """The smallest index of each row's linked set; rows are sorted by group and by the first column of the pivot table."""
    n = len(fp)
    lag, at = 1, np.arange(n)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    while True:
        at = at[at + lag < n]
        at = at[(group[at] == group[at + lag]) & (table[at + lag, 0] - table[at, 0] <= differing)]
        if not at.size:
            break
        near = at
        for p in range(1, table.shape[1]):
            near = near[np.abs(table[near, p] - table[near + lag, p]) <= differing]
            if not near.size:
                break
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= differing]
        if near.size:
            left.append(near)
            right.append(near + lag)
            if sum(map(len, left)) > 500_000:
                label = contract(n, np.concatenate(left), np.concatenate(right))
                own = np.flatnonzero(label != np.arange(n))
                left, right = [own], [label[own]]
        lag += 1
    return contract(n, np.concatenate(left), np.concatenate(right)) if left else np.arange(n)


def keyed(table: DataFrame, differing: int = DIFFERING, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """The rows of a pivot table under all their keys (mask, bits, lo, hi); lo and hi are 0 but for keys that stayed large, whose rows
    are in blocks and meet block by block."""
    zero = {"lo": F.lit(0), "hi": F.lit(0)}
    open_ = table.withColumn("mask", F.explode(F.lit([_signed(m) for m in band_masks(differing)])))
    done: DataFrame | None = None
    for level in range(levels + 1):
        open_ = open_.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        large = stored(open_.groupBy("mask", "bits").count().filter(F.col("count") > block), "large")
        masks = [r.mask for r in large.select("mask").distinct().collect()]  # a few hundred at most
        small = (open_.join(large, ["mask", "bits"], "left_anti") if masks else open_).withColumns(zero)
        done = done.unionByName(small) if done is not None else small
        if not masks:
            return done
        many = open_.join(large, ["mask", "bits"])
        if level < levels:
            longer = F.create_map(*[x for m in masks for x in (F.lit(m), F.lit([_signed(f) for f in finer(m % (1 << 64), differing)]))])
            open_ = stored(many.withColumn("mask", F.explode(F.element_at(longer, F.col("mask")))).drop("bits", "count").distinct(), "longer")
    blocks = F.ceil(F.col("count") / block).cast("int")
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return done.unionByName(many.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("count", "own", "other"))


def links(table: DataFrame, differing: int = DIFFERING, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all nodes whose fingerprints link; table has rows (fp, node, p0, p1, ...), fp distinct."""
    distances = [c for c in table.columns if c[0] == "p" and c[1:].isdigit()]
    keys = ["mask", "bits", "lo", "hi"]
    names = [*keys, "node", "fp", *distances]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            change = np.flatnonzero(_changes(held)) + 1
            if change.size:
                cut = int(change[-1])
                yield from _stars([x[:cut] for x in held], differing)
                held = [x[cut:] for x in held]
        if held:
            yield from _stars(held, differing)

    rows = keyed(table, differing, block).select(*names, F.col("p0").bitwiseAND(F.lit(255)).alias("d"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "d").select(*names).mapInArrow(each, "a long, b long")


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    return np.any([k[1:] != k[:-1] for k in cols[:4]], axis=0)


def _stars(cols: list[np.ndarray], differing: int) -> Iterator[pa.RecordBatch]:
    n = len(cols[0])
    if n < 2:
        return
    table = np.stack(cols[6:], axis=1).view(np.int8)
    label = linked(np.concatenate([[0], np.cumsum(_changes(cols))]), cols[5].view(np.uint64), differing, table)
    own = np.flatnonzero(label != np.arange(n))
    if own.size:
        yield pa.RecordBatch.from_arrays([pa.array(cols[4][own]), pa.array(cols[4][label[own]])], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, differing: int = DIFFERING) -> DataFrame:
    """Rows (doc_id, text_hash, fp, root, component_id). The text's hash tells rows of one id apart; root, a fingerprint, tells components
    apart, which is more than their names do where rows share an id but not their text."""
    signed = stored(signatures(docs, id_col, text_col, shingle), "signatures")
    table = stored(pivot_table(signed.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp"))), "pivots")
    found = components(links(table, differing)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    linked_ = table.select("fp", "least").join(found, "fp")
    names = linked_.groupBy("root").agg(F.min("least").alias("component_id"))
    named = table.select("fp", "least").join(linked_.select("fp", "root").join(names, "root"), "fp", "left")
    named = named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    named = stored(named, "named")  # a table of its own, so that a fingerprint of very many rows can be split in the join
    return signed.join(named, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def duplicates(found: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash) of near_duplicates that one document of each component makes superfluous: the one with the smallest
    id, and among texts with that id the one with the smallest hash, stays; so do its repeated rows, and rows of components without ids."""
    rows = found.filter("component_id is not null").select("doc_id", "text_hash", "root", "component_id")
    named = rows.filter("doc_id = component_id")
    several = named.groupBy("root").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).filter("first <> last").select("root", "first")
    rest = named.join(several, "root").filter("text_hash <> first").select("doc_id", "text_hash")
    return rows.filter("doc_id is null or doc_id <> component_id").select("doc_id", "text_hash").unionByName(rest).distinct()


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
