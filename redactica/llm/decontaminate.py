"""Benchmark decontamination by Wu-Manber multi-pattern search over normalised UTF-8 bytes.

A-Z are lower-cased and every byte outside 0-9, a-z and the multi-byte range becomes a blank, so a text is ` word word word `.
A pattern is a window of consecutive benchmark words with its outer blanks, so an occurrence always covers whole words.
Patterns are classed by length. Each class has a shift table over hashed blocks of up to eight bytes: it says how far the search
may skip. Where the shift is zero, the bucket of that suffix hash selects patterns, and bytes are compared directly. Documents
of a batch are searched in many lanes that advance together.

A pattern is two places in the normalised benchmark, which is held once, so a block of benchmark text takes few times its bytes. The
benchmark is streamed to the driver and compiled in blocks of bounded bytes, long items in overlapping parts; each block is broadcast
and is one narrow pass over the documents. There is no shuffle.

Defined results: a null or wordless text has no words, no hits and is clean; a very long one is searched whole. A null item id counts
as hit but is no item; rows of one item id are one item. Repeated document rows give a row each. An empty table of documents gives no
rows, an empty benchmark leaves every document clean. Ties cannot be. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactica.llm.common import map_arrow, run_hashes, short_batches, stored, word_hashes

WINDOW = 13
#: Normalised benchmark bytes in one broadcast block.
BLOCK_BYTES = 16_000_000
#: Passes that are chained before the result so far is written.
CHAIN = 6
LANE = 2048
TABLE_BITS = 18
LONGEST_PREFIX = 64
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class PatternClass:
    """Wu-Manber tables for windows lo:hi of a text, of similar length."""

    def __init__(self, blocks: np.ndarray, lo: np.ndarray, hi: np.ndarray, number: np.ndarray):
        self.m = m = int(min(LONGEST_PREFIX, (hi - lo).min()))
        self.b = b = min(8, m)
        self.mask = np.uint64((1 << 8 * b) - 1)
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.int16)
        for j in range(b, m + 1):  # a later block leaves less to skip
            self.shift[self.slot(blocks[lo + j - b])] = m - j
        slots = self.slot(blocks[lo + m - b])
        order = np.argsort(slots, kind="stable")
        self.slots, self.lo, self.hi, self.number = slots[order].astype(np.int32), lo[order].astype(np.int32), hi[order].astype(np.int32), number[order].astype(np.int32)
        self.head = blocks[self.lo] & self.mask

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (((blocks & self.mask) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, patterns: bytes, text: bytes, blocks: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(byte offset, bytes, number) of every occurrence."""
        n, back = len(text), self.b - 1
        at = np.arange(self.m - 1, n, LANE, dtype=np.int64)
        ends = np.minimum(at + LANE, n)
        while at.size:
            slots = self.slot(blocks[at - back])
            shift = self.shift[slots]
            if (zero := shift == 0).any():
                first, last = (np.searchsorted(self.slots, slots[zero], side) for side in ("left", "right"))
                size = last - first
                start = np.repeat(at[zero] - self.m + 1, size)
                which = np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                same = np.flatnonzero((blocks[start] & self.mask) == self.head[which])
                for s, i in zip(start[same].tolist(), which[same].tolist(), strict=True):
                    lo, hi = int(self.lo[i]), int(self.hi[i])
                    if text.startswith(patterns[lo:hi], s):
                        yield s, hi - lo, int(self.number[i])
            at = at + np.maximum(shift, 1)
            going = at < ends
            at, ends = at[going], ends[going]


class Patterns:
    """The distinct windows of items (item id or None, words), the items of each, and the tables to search them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.text = b" ".join([b"", *(b" ".join(w) for _, w in items), b""])
        raw = np.frombuffer(self.text + b" ", np.uint8)
        space = raw == 32
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        counts = np.array([len(w) for _, w in items], np.int64)
        item = np.repeat(np.arange(len(items)), counts)
        ids = {i: k for k, i in enumerate(dict.fromkeys(i for i, _ in items if i is not None))}
        self.items = list(ids)
        owner = np.array([-1 if i is None else ids[i] for i, _ in items], np.int64)
        full = np.flatnonzero(item[: max(0, len(item) - window + 1)] == item[window - 1 :]) if len(item) >= window else np.zeros(0, np.int64)
        ha, hb = word_hashes(self.text + b"12345678", starts, ends - starts)
        ka, kb = (run_hashes(h, window)[full] if full.size else np.zeros(0, np.uint64) for h in (ha, hb))
        short = np.flatnonzero((counts < window) & (counts > 0))
        begin = np.cumsum(counts) - counts
        marks = [xxhash.xxh3_128_intdigest(b" ".join(items[i][1])) for i in short.tolist()]
        lo = np.concatenate([starts[full], starts[begin[short]]]) - 1
        hi = np.concatenate([ends[full + window - 1], ends[begin[short] + counts[short] - 1]]) + 1
        whose = owner[np.concatenate([item[full], short])]
        words = np.concatenate([np.full(len(full), window), counts[short]])
        ka = np.concatenate([ka, np.array([m >> 64 for m in marks], np.uint64)])
        kb = np.concatenate([kb, np.array([m & 0xFFFFFFFFFFFFFFFF for m in marks], np.uint64)])
        order = np.lexsort((whose, kb, ka))
        ka, kb, whose = ka[order], kb[order], whose[order]
        new = np.ones(len(order), bool)
        new[1:] = (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])
        other = new.copy()
        other[1:] |= whose[1:] != whose[:-1]
        number = np.cumsum(new) - 1
        own = other & (whose >= 0)
        self.owners, self.owned = whose[own].astype(np.int32), np.searchsorted(number[own], np.arange(int(new.sum()) + 1))
        lo, hi = lo[order][new], hi[order][new]
        self.words = words[order][new].astype(np.int32)
        kind = np.array([int(x).bit_length() for x in range(LONGEST_PREFIX + 1)])[np.minimum(hi - lo, LONGEST_PREFIX)]
        blocks = _unaligned(self.text)
        self.classes = [PatternClass(blocks, lo[x], hi[x], x) for x in (np.flatnonzero(kind == k) for k in np.unique(kind))]

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """(byte offset, bytes, number) of every occurrence, in order."""
        blocks = _unaligned(text)
        return sorted(x for c in self.classes for x in c.search(self.text, text, blocks))

    def of(self, number: int) -> list[str]:
        return [self.items[i] for i in self.owners[self.owned[number] : self.owned[number + 1]].tolist()]


def _unaligned(data: bytes) -> np.ndarray:
    """Eight bytes from every position on, as integers."""
    return np.ndarray((len(data),), "<u8", data + b"\0" * 8, strides=(1,))


def pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Patterns]:
    """Streams the items and compiles a block whenever enough bytes have come; at least one block."""
    held: list[tuple[str | None, list[bytes]]] = []
    size, any_yet = 0, False
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        words, at = words_of(text), 0
        while words and (at == 0 or at + window - 1 < len(words)):
            part = words[at : at + max(1, block_bytes // 8) + window - 1]
            held.append((item, part))
            size += sum(map(len, part)) + len(part)
            at += max(1, block_bytes // 8)
            if size >= block_bytes:
                yield Patterns(held, window)
                held, size, any_yet = [], 0, True
    if held or not any_yet:
        yield Patterns(held, window)


def scan(patterns: Patterns, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: words, merged hit intervals of words, ids of items with occurring windows."""
    split = [words_of(t) for t in texts]
    pieces = [b" ".join(w) for w in split]
    buffer = b" " + b" \0 ".join(pieces) + b" "
    starts, at = [], 0
    for p in pieces:
        starts.append(at)
        at += len(p) + 3
    hits = patterns.search(buffer)
    k = 0
    for d, words in enumerate(split):
        spans, items, seen_at, index = [], set(), starts[d], 0
        limit = starts[d + 1] if d + 1 < len(starts) else len(buffer)
        while k < len(hits) and hits[k][0] < limit:
            s, _, number = hits[k]
            index += buffer.count(b" ", seen_at, s)
            seen_at = s
            end = index + int(patterns.words[number])
            if spans and index <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((index, end))
            items.update(patterns.of(number))
            k += 1
        yield len(words), spans, items


SCHEMA = "id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, spans, item_ids, n_items, contaminated); spans are half-open word intervals.

    A document is contaminated if it has hit words and they are at least one in `share` of its words. With `carry`, the text and the
    columns named stand beside them, so that documents can be filtered without a join.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    carried = [f"_{i}" for i in range(len(kinds))]
    now = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)], F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = "".join(f"{n} {k}, " for n, k in zip(carried, kinds, strict=True)) + "id long, text string, " + SCHEMA.partition(", ")[2]
    for k, block in enumerate(pattern_blocks(benchmark, item_col, item_text_col, window, block_bytes)):
        shared = spark.sparkContext.broadcast(block)

        def one(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            earlier = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            n, spans, items = [], [], []
            for (words, new, found), (old, had) in zip(scan(shared.value, texts), earlier, strict=True):
                n.append(words)
                spans.append(_merged([(x["start"], x["end"]) for x in old or ()] + new) if old else [{"start": a, "end": b} for a, b in new])
                items.append(sorted(found.union(had or ())))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            same = [*carried, "id", "text"]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], [*same, "n_words", "spans", "items"])

        now = map_arrow(now, one, schema)
        if k % CHAIN == CHAIN - 1:
            now = stored(now, "decontaminate")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    kept = [F.col(n).alias(c) for n, c in zip(carried, carry, strict=True)] + [F.col("text").alias(text_col)] * bool(carry)
    out = now.select(*kept, F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "spans", F.col("items").alias("item_ids"))
    return out.select("*", F.size("item_ids").cast("long").alias("n_items"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


#: Windows join as strings; every matched word position counts once.
SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pats AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM pats),
wins AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM norm, sizes WHERE len(w) >= k)
), hits AS (SELECT doc_id, item_id, wins.k, i FROM wins JOIN pats ON wins.k = pats.k AND wins.p = pats.p),
n_hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM hits) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(w) AS contaminated
FROM norm LEFT JOIN n_hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
