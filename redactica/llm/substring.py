"""Substring deduplication on the de Bruijn graph of word k-mers.

A window of 20 words is an edge of the graph, from the node of its first 19 words to that of its last 19; a document is a walk. Equal
edges are repeats, and stretches of them that run side by side in two documents are nonbranching paths, compacted to spans:

1. Grams: the windows of a document that share their leftmost smallest 6-word gram lie side by side, and equal windows share that gram.
   Such grams are counted; one seen once leads no repeated edge. The others go into a bit filter of fixed size, which may let too many
   edges pass but never too few.
2. Edges: each edge that passes has a key, an independent proof (64 bits each) and its source coordinates (document, position). A task
   joins the equal edges it meets, so that of a very common passage it hands on one edge each; one join by key and proof over all tasks
   then gives every later edge the coordinates of its first.
3. Paths: edges of a document whose first edges also follow each other are one path, a span (document, position, length, source
   document, source position). Where the sources part, the graph branches and a new span begins.
4. The spans of a document merge into stretches of words, and these words go. Only texts with spans are shuffled.

Every edge of a span is held against its source coordinates by key and proof, which are made of two independent hashes of each word,
128 bits in all; words are not shipped to be compared again.

Defined results: a null text, or one without words, keeps nothing and loses nothing. A very long text is walked whole. Rows of one id
with different texts are documents of their own, and neither is earlier than the other; repeated rows count as one document and give a
row each. A null id comes after all others. Ties cannot be: of equal windows the smaller (document, position) is first. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactica.llm.common import ID_BITS, in_filter, key_filter, map_arrow, mixed, parted, run_hashes, short_batches, stored, word_hashes

WINDOW = 20
GRAM = 6
#: Bits of the filter of repeated grams, a power of two: the broadcast has an eighth as many bytes at any size of the corpus.
FILTER_BITS = 1 << 27
LAST_ID = (1 << 63) - 1
#: Edges that a task joins with each other before it hands them on.
HELD = 400_000
_PLACE_BITS = 26
_BLOCK = 1 << 25
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Walk(NamedTuple):
    """The windows of some texts, in runs that share their smallest gram."""

    text: np.ndarray  #: of each run: its text,
    at: np.ndarray  #: its first word,
    n: np.ndarray  #: its windows,
    gram: np.ndarray  #: the hash of its gram,
    first: np.ndarray  #: the place of its first window in the next two
    key: np.ndarray
    proof: np.ndarray


def walk(texts: list[str | None], window: int = WINDOW, gram: int = GRAM) -> Walk | None:
    encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"\n".join([b"", *encoded, b"", b"12345678"])
    space = _SPACE[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero(space[:-1] & ~space[1:])[:-1] + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    offsets = np.cumsum([1, *(len(e) + 1 for e in encoded)])
    text = np.searchsorted(offsets, starts, "right") - 1
    sizes = np.bincount(text, minlength=len(texts))
    sizes[sizes < window] = 0
    kept = sizes[text] > 0
    if not kept.any():
        return None
    text, starts, ends = text[kept], starts[kept], ends[kept]
    ha, hb = word_hashes(data, starts, ends - starts)
    n = len(text) - window + 1
    small = run_hashes(ha, gram)
    place, span = np.uint64((1 << _PLACE_BITS) - 1), window - gram + 1
    at = np.empty(n, np.int64)
    for b in range(0, n, _BLOCK):  # the leftmost smallest gram of each window; ties of the upper bits go to the left
        part, width = small[b : b + _BLOCK + span - 1], 1
        low = (part & ~place) | np.arange(len(part), dtype=np.uint64)
        while 2 * width <= span:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        m = min(_BLOCK, n - b)
        at[b : b + m] = b + (np.minimum(low[:m], low[span - width :][:m]) & place).astype(np.int64)
    own = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = own[:n] + window <= sizes[text[:n]]
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (text[1:n] != text[: n - 1])
    first = np.flatnonzero(change)
    length = np.diff(np.append(first, n))
    first, length = first[whole[first]], length[whole[first]]
    return Walk(text[first], own[first], length, small[at[first]], first, run_hashes(hb, window), run_hashes(ha, window))


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded size of text; a single text is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if total + s > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    yield batch.slice(start)


def repeatedrun_hashes(rows: DataFrame, window: int, gram: int, bits: int) -> np.ndarray:
    """The filter over rows (id, t, text): bit (hash mod bits) is set for all grams that lead two runs or more."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [w.gram for part in _slices(batch, 0) if (w := walk(part.column(0).to_pylist(), window, gram))]
        if not found:
            return None
        m, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["m", "n"])

    return key_filter(map_arrow(rows.select("text"), one, "m long, n byte").groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1").select("m"), bits)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any column differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def joined(key: np.ndarray, proof: np.ndarray, ids: np.ndarray, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(edges without an earlier equal one among these, runs (id, t, at, n, id0, at0) of the others with the places of their first)."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twin = np.append(same, False) | np.append(False, same)
    g = order[twin]
    g = g[np.lexsort((at[g], t[g], ids[g], proof[g], key[g]))]
    new = _starts(key[g], proof[g])
    first = g[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
    last = np.roll(g, 1)
    own = ~new & (ids[g] == ids[last]) & (t[g] == t[last])  # the edge before is of the same document
    above = ids[g] > ids[first]
    later = above | own & (at[g] > at[last])
    free = np.ones(len(key), bool)
    free[g[later | own]] = False
    e, source = g[later], np.where(above, first, last)[later]
    e, source = (x[np.lexsort((at[e], t[e], ids[e]))] for x in (e, source))
    head = _starts(ids[e], t[e], ids[source], at[e] - np.arange(len(e)), at[source] - np.arange(len(e)))
    k = np.flatnonzero(head)
    n = np.diff(np.append(k, len(e)))
    return np.flatnonzero(free), (ids[e[k]], t[e[k]], at[e[k]], n, ids[source[k]], at[source[k]])


EDGES = "done boolean, key long, proof long, id long, t long, at int, n int, id0 long, at0 int"
_EDGES = [pa.bool_(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.int32()]


def edges(rows: DataFrame, seen: np.ndarray, window: int, gram: int) -> DataFrame:
    """The edges of rows (id, t, text) that the filter lets pass. Those with an earlier equal one in the task are done, in runs."""
    shared = rows.sparkSession.sparkContext.broadcast(seen)

    def batch_of(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, _EDGES, strict=True)], [c.split()[0] for c in EDGES.split(", ")])

    def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, proof, ids, t, at = (np.concatenate(c) for c in zip(*held, strict=True))
        free, (id_, t_, at_, n, id0, at0) = joined(key, proof, ids, t, at)
        none, one = np.zeros(len(free), np.int64), np.ones(len(free), np.int64)
        yield batch_of(none.astype(bool), key[free].view(np.int64), proof[free].view(np.int64), ids[free], t[free], at[free], one, none, none)
        if len(id_):
            spread = mixed((id_ ^ t_).view(np.uint64)).view(np.int64)
            yield batch_of(np.ones(len(id_), bool), spread, np.zeros(len(id_), np.int64), id_, t_, at_, n, id0, at0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = shared.value, [], 0
        for whole in batches:
            for batch in _slices(whole, 2):
                if (w := walk(batch.column(2).to_pylist(), window, gram)) is None:
                    continue
                keep = np.flatnonzero(in_filter(bits, w.gram))
                if not keep.size:
                    continue
                ids, t = (batch.column(c).to_numpy() for c in (0, 1))
                n = w.n[keep]
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                own, text = place + np.repeat(w.first[keep], n), np.repeat(w.text[keep], n)
                held.append((w.key[own], w.proof[own], ids[text], t[text], place + np.repeat(w.at[keep], n)))
                size += len(own)
                if size >= HELD:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    return rows.mapInArrow(each, EDGES)


def spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS) -> DataFrame:
    """Rows (id, t, at, n, id0, at0) of rows (id, t, text): n windows from position `at` of a document, which start at `at0` of id0 first."""
    equal = Window.partitionBy("done", "key", "proof").orderBy("id", "t", "at")
    found = edges(rows, repeatedrun_hashes(rows, window, gram, bits), window, gram)
    found = found.select("*", *[F.first(c).over(equal.rowsBetween(Window.unboundedPreceding, 0)).alias(f"f_{c}") for c in ("id", "at")], *[F.lag(c).over(equal).alias(f"p_{c}") for c in ("id", "t", "at")])
    above = F.col("id") > F.col("f_id")
    own = F.coalesce((F.col("p_id") == F.col("id")) & (F.col("p_t") == F.col("t")) & (F.col("p_at") < F.col("at")), F.lit(False))
    source = {c: F.when(F.col("done"), F.col(f"{c}0")).when(above, F.col(f"f_{c}")).otherwise(F.col(f"p_{c}")) for c in ("id", "at")}
    later = found.filter(F.col("done") | above | own).select("id", "t", "at", "n", source["id"].alias("id0"), source["at"].alias("at0"))

    document = Window.partitionBy("id", "t").orderBy("at", F.desc("n"))
    end = F.max(F.col("at") + F.col("n")).over(document.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("end", end).filter(F.col("end").isNull() | (F.col("at") + F.col("n") > F.col("end")))  # repeated rows say the same twice
    before = {c: F.lag(c).over(document) for c in ("at", "n", "id0", "at0")}
    follows = (F.col("at") == before["at"] + before["n"]) & (F.col("id0") == before["id0"]) & (F.col("at0") == before["at0"] + before["n"])
    path = later.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("new").over(document.rowsBetween(Window.unboundedPreceding, 0)))
    out = path.groupBy("id", "t", "path").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.min("id0").alias("id0"), F.min("at0").alias("at0"))
    return out.drop("path")


def merged(runs: list[tuple[int, int]], window: int, n_words: int) -> list[tuple[int, int]]:
    """Half-open intervals of the words under runs of windows."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(runs):
        end = min(at + n - 1 + window, n_words)
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        elif at < end:
            out.append((at, end))
    return out


def _shortened(batch: pa.RecordBatch, window: int) -> tuple[list[int], list[int], list[bytes]]:
    """Per text: words, words removed, what is left."""
    n, removed, kept = [], [], []
    for text, runs in zip(batch.column("_text").to_pylist(), batch.column("_runs").to_pylist(), strict=True):
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        gone = merged([(r["at"], r["n"]) for r in runs or ()], window, len(words))
        left, at = [], 0
        for a, b in gone:
            left += words[at:a]
            at = b
        n.append(len(words))
        removed.append(sum(b - a for a, b in gone))
        kept.append(b" ".join(left + words[at:]))
    return n, removed, kept


def _with_runs(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, bits: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (_doc_id, _text[, _carry], _runs): those that may have runs, and those that have none and were never shuffled."""
    short_batches(docs.sparkSession)
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    mark = F.xxhash64(F.coalesce(text, F.lit("")))  # tells rows of one id apart; all of it where there is no id
    place = [F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"), F.when(doc_id.isNull(), mark).otherwise(F.pmod(mark, F.lit(1 << 32))).alias("t")]
    found = stored(spans(docs.select(*place, text.alias("text")), window, gram, bits), "spans")
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry")] * bool(carry)
    picked, rest = parted(docs.select(*place, doc_id.alias("_doc_id"), text.alias("_text"), *carried), found, ["id", "t"], ID_BITS)
    runs = found.groupBy("id", "t").agg(F.collect_list(F.struct("at", "n")).alias("_runs"))
    none = F.expr("cast(array() as array<struct<at:int,n:int>>)").alias("_runs")
    return picked.join(runs, ["id", "t"], "left").drop("id", "t"), rest.drop("id", "t").select("*", none)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): kept is what is left of the words, joined by one space."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, kept = _shortened(batch, window)
        return pa.RecordBatch.from_arrays([batch.column("_doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    picked, rest = (map_arrow(x, one, "doc_id long, n_words long, n_removed long, kept string") for x in _with_runs(docs, id_col, text_col, window, gram, bits, []))
    return picked.unionByName(rest)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS) -> DataFrame:
    """The documents, all columns, without the repeats in their texts; a text that loses nothing stays as it is."""
    others = [c for c in docs.columns if c != text_col]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, removed, kept = _shortened(batch, window)
        texts = [k.decode("utf-8", "surrogatepass") if r else t for t, r, k in zip(batch.column("_text").to_pylist(), removed, kept, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.column("_carry").flatten(), pa.array(texts, pa.string())], [*others, text_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*others, text_col])
    picked, rest = _with_runs(docs, id_col, text_col, window, gram, bits, others)
    same = rest.select(*[F.col("_carry")[c].alias(c) for c in others], F.col("_text").alias(text_col))
    return map_arrow(picked, one, schema).unionByName(same).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The first of equal windows stays; the words under the others go.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS x FROM late),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d) ANTI JOIN gone USING (doc_id, x) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
