"""Quality by an interpolated modified Kneser-Ney model of trusted text.

Trusted text is what labels mark as good. Four fifths of it are counted, the rest sets the thresholds; no row is left out. The model
is one of 4-grams of characters of any script (lower case, white space collapsed), one for each language with trusted text. A word that
repeats the word before it is not spelled again; instead each word has one more 4-gram, which says whether it is such a repeat and hangs
on nothing before it. So the model learns how rare repeats are in trusted text, and text that repeats a word over and over surprises it
as noise does, however long it goes on. Counts, and the shares and backoff weights made of them, are rows by (language, n-gram) and are
never gathered. Texts are packed into compressed blocks of one language; a block asks for its distinct n-grams only, the answers come by an equality join and meet the
block's texts again by its number. So what is shuffled is trusted texts, packed texts and the distinct n-grams of each block, and it
grows with the corpus. Documents are read twice; blocks that come out otherwise the second time are written and asked about again, so a
lost executor, or a table that is dealt anew at every reading, changes nothing.

A document's mean surprise is drawn towards its language's trusted mean by `PRIOR` symbols, so short texts are not judged by a few
letters. A document is kept if its perplexity is at most its language's quantile of the held-back trusted documents (raised where these are
few, `SLACK`).

Defined results: null and empty texts have no symbols and the trusted mean, and are kept. Very long texts are read whole.
The characters U+E000 to U+E002 of a text are read as U+FFFD. A perplexity
that equals the threshold is kept. A null language is 'und'. A language without
both counted and held-back trusted documents uses the model and threshold of all trusted text ('other'). Where that has none either,
all documents are kept. Repeated rows give a row each; an empty table gives no rows; other columns are ignored, whatever their names.
One row per language goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactica.llm.common import selected, short_batches, stored

PRIOR = 60.0
QUANTILE = 0.99
#: A quantile of n documents is raised by this many parts in n: of few it is unsure, and of many it is left as it is.
SLACK = 3.0
OTHER = -1
#: Characters of a block of texts, and of all blocks that a task has open (one for each language); how hard blocks are compressed.
BLOCK_CHARS, HELD_CHARS, ZSTD = 3_000_000, 18_000_000, 9
#: Bits of a character, and the characters an unseen one is among.
BITS, UNICODE = 21, 0x110000
LAST = (1 << BITS) - 1
#: What a word is besides its letters: one that repeats the word before, or any other; what they and the filler before them are read
#: as where they are in a text.
AGAIN, FRESH, FILL, PLAIN = 0xE000, 0xE001, 0xE002, "\ufffd"
_MARKS = {AGAIN: PLAIN, FRESH: PLAIN, FILL: PLAIN}


def written(text: str | None) -> tuple[str, int, int]:
    """The text as the model reads it, in lower case, with single blanks and without words that repeat the one before; how many of its
    words do so, and how many do not."""
    words = text.translate(_MARKS).lower().split() if text else []
    kept = [b for a, b in zip(["", *words], words, strict=False) if a != b]
    return " ".join(kept), len(words) - len(kept), len(kept)


def packed(rows: DataFrame) -> DataFrame:
    """Rows (block, lang, ids, data) of rows (id, text, lang): data is the compressed texts, all of one language. A block's number is a hash of all it holds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # by language: ids, texts, characters

        def out(lang: str) -> pa.RecordBatch:
            ids, texts, _ = held.pop(lang)
            t = pa.table({"text": pa.array(texts, pa.large_string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD))) as w:
                w.write_table(t)
            block = xxhash.xxh3_64_intdigest(sink.getvalue().to_pybytes(), xxhash.xxh3_64_intdigest(repr((lang, ids)))) >> 1
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang]), pa.array([ids], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()])], ["block", "lang", "ids", "data"])

        size = 0
        for b in batches:
            for i, text, lang in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                own = held.setdefault(lang, [[], [], 0])
                own[0].append(i)
                own[1].append(text)
                own[2] += (n := len(text or "") + 1)
                size += n
                if own[2] >= BLOCK_CHARS or size >= HELD_CHARS:
                    most = lang if own[2] >= BLOCK_CHARS else max(held, key=lambda x: held[x][2])
                    size -= held[most][2]
                    yield out(most)
        for lang in list(held):
            yield out(lang)

    return rows.mapInArrow(pack, "block long, lang string, ids array<long>, data binary")


def _unpacked(data: bytes) -> list:
    return pa.ipc.open_stream(data).read_all()["text"].to_pylist()


def coded(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, which, n): first and last two characters of the distinct 4-grams; which of them stand in the texts, in order; how many in
    each text. After its characters a text has a 4-gram for each word, of three fillers and AGAIN or FRESH."""
    said = [written(t) for t in texts]
    n = np.array([len(t) + 1 if t else 0 for t, _, _ in said], np.int64)
    events = np.array([x[1:] for x in said], np.int64).reshape(-1, 2)
    cp = np.frombuffer("".join(f"   {t} " for t, _, _ in said if t).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n
    pair, pairs = pd.factorize(cp[:-1] << BITS | cp[1:])
    used = n[n > 0]
    at = np.arange(n.sum()) + np.repeat(3 * np.arange(len(used)), used)
    code = pair[at] * len(pairs)
    code += pair[at + 2]
    del cp, pair, at
    which, codes = pd.factorize(code)
    fill = FILL << BITS
    p = np.append(pairs[codes // len(pairs)], [fill | FILL] * 2)
    q = np.append(pairs[codes % len(pairs)], [fill | AGAIN, fill | FRESH])
    order = np.lexsort((q, p))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    own = events.sum(axis=1)
    before = np.cumsum(own) - own
    every = np.empty(int(n.sum() + own.sum()), np.int32)
    every[np.arange(len(which)) + np.repeat(before, n)] = rank[which]
    every[np.arange(int(own.sum())) + np.repeat(np.cumsum(n), own)] = np.repeat(np.tile(rank[-2:], len(n)), events.ravel())
    return p[order], q[order], every, n + own


def _keys(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What the 4-grams ask for: keys (p, q), n-grams of k < 4 being (-k, characters); and the places of their own n-grams and contexts, k from 3 down to 1."""
    kp, kq, places, start = [p], [q], [], len(p)
    tail, last = p & LAST, q >> BITS
    for k, own, context in ((3, tail << 2 * BITS | q, p << BITS | last), (2, q, tail << BITS | last), (1, q & LAST, last)):
        keys, place = np.unique(np.concatenate([own, context]), return_inverse=True)
        places += [place[: len(p)] + start, place[len(p) :] + start]
        kp.append(np.full(len(keys), -k))
        kq.append(keys)
        start += len(keys)
    return np.concatenate([*kp, [0]]), np.concatenate([*kq, [0]]), places


def _models(lang: str, number: dict[str, int], other: bool) -> list[int]:
    """The models that a language's texts go by; with `other`, all go by that one too."""
    return ([number[lang]] if lang in number else []) + [OTHER] * other


def counted(rows: DataFrame, number: dict[str, int], other: bool) -> DataFrame:
    """Rows (m, p, q, n): the 4-grams of rows (text, lang) for each model."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # by language: texts, characters

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            p, q, which, _ = coded(held.pop(lang)[0])
            n = np.bincount(which, minlength=len(p)).astype(np.int64)
            for m in _models(lang, number, other):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), m, np.int32)), pa.array(p), pa.array(q), pa.array(n)], ["m", "p", "q", "n"])

        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                own = held.setdefault(lang, [[], 0])
                own[0].append(text)
                own[1] += len(text or "") + 1
                if own[1] >= BLOCK_CHARS:
                    yield from out(lang)
        for lang in list(held):
            yield from out(lang)

    return rows.mapInArrow(count, "m int, p long, q long, n long").groupBy("m", "p", "q").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """Rows (m, p, q, alpha, gamma): an n-gram's discounted share in its context, and what it leaves as a context for shorter ones."""
    p, q, g, n = F.col("p"), F.col("q"), F.col("g"), F.col("n")
    left, right = F.shiftleft, F.shiftrightunsigned
    level = [stored(counts, "grams").withColumn("k", F.lit(4)).withColumn("x", left(p, BITS).bitwiseOR(right(q, BITS)))]
    shorter = level[0].select("m", left(p.bitwiseAND(F.lit(LAST)), 2 * BITS).bitwiseOR(q).alias("g"))
    for k in (3, 2, 1):  # a shorter n-gram counts the characters seen before it
        own = stored(shorter.groupBy("m", "g").agg(F.count(F.lit(1)).alias("n")), "grams")
        level.append(own.select("m", F.lit(-k).cast("long").alias("p"), g.alias("q"), "n", F.lit(k).alias("k"), right(g, BITS).alias("x")))
        shorter = own.select("m", g.bitwiseAND(F.lit((1 << (k - 1) * BITS) - 1)).alias("g"))
    grams_ = level[0]
    for x in level[1:]:
        grams_ = grams_.unionByName(x)
    seen = lambda k: F.greatest(F.sum((n == k).cast("long")), F.lit(1))
    few = grams_.groupBy("m", "k").agg(*[seen(k).alias(f"s{k}") for k in (1, 2, 3, 4)])
    y = F.col("s1") / (F.col("s1") + 2 * F.col("s2"))
    off = few.select("m", "k", *[F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"s{k + 1}") / F.col(f"s{k}"))).alias(f"d{k}") for k in (1, 2, 3)])
    contexts = grams_.groupBy("m", "k", "x").agg(F.sum("n").alias("total"), *[F.sum(c.cast("long")).alias(f"c{i}") for i, c in ((1, n == 1), (2, n == 2), (3, n > 2))])
    contexts = contexts.join(F.broadcast(off), ["m", "k"])
    gone = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    alpha = grams_.join(contexts, ["m", "k", "x"]).select("m", "p", "q", ((n - gone) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma"))
    rest = sum((F.col(f"c{i}") * F.col(f"d{i}") for i in (1, 2, 3)), F.lit(0.0)) / F.col("total")
    gamma = contexts.select("m", (1 - F.col("k")).cast("long").alias("p"), F.col("x").alias("q"), F.lit(None).cast("double").alias("alpha"), rest.alias("gamma"))
    return alpha.unionByName(gamma).groupBy("m", "p", "q").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"))


def surprises(blocks: DataFrame, known: DataFrame, number: dict[str, int], other: bool) -> DataFrame:
    """Rows (id, lang, m, n, surprise) of blocks, for each model that a text goes by; a block without answers comes back whole, in the
    columns block, ids and data, which are null otherwise."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                p, q, _, _ = coded(_unpacked(data.as_py()))
                kp, kq, _ = _keys(p, q)
                for k, m in enumerate(_models(lang, number, other)):
                    i = np.arange(k * len(kp), (k + 1) * len(kp), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kp), block)), pa.array(i), pa.array(np.full(len(kp), m, np.int32)), pa.array(kp), pa.array(kq)], ["block", "i", "m", "p", "q"])

    asked = blocks.select("block", "lang", "data").mapInArrow(ask, "block long, i int, m int, p long, q long")
    found = F.expr("alpha is not null or gamma is not null or p = 0 and q = 0")  # the empty n-gram is always answered, so a block that asked has rows
    answers = asked.join(known, ["m", "p", "q"], "left").filter(found).select(F.col("block").alias("b"), "i", F.col("alpha").cast("float").alias("alpha"), F.col("gamma").cast("float").alias("gamma"))

    kinds = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("m", pa.int32()), ("n", pa.int64()), ("surprise", pa.float64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])

    def rows_of(size: int, **given) -> pa.Table:
        return pa.table([given.get(f.name, pa.nulls(size, f.type)) for f in kinds], kinds)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["i"].to_numpy()
        if not len(place) and left.num_rows:  # the documents were dealt otherwise when they were read for the questions
            return rows_of(left.num_rows, lang=left["lang"], block=left["b"], ids=left["ids"], data=left["data"])
        alphas, gammas = right["alpha"].fill_null(0).to_numpy(), right["gamma"].fill_null(1).to_numpy()
        out = []
        for lang, ids, data in zip(left["lang"].to_pylist(), left["ids"].to_pylist(), left["data"], strict=True):
            p, q, which, n = coded(_unpacked(data.as_py()))
            kp, _, places = _keys(p, q)
            for k, m in enumerate(_models(lang, number, other)):
                start = k * len(kp)
                alpha, gamma = np.zeros(len(kp)), np.ones(len(kp))
                mine = (place >= start) & (place < start + len(kp))
                alpha[place[mine] - start], gamma[place[mine] - start] = alphas[mine], gammas[mine]
                g3, x3, g2, x2, g1, x1 = places
                chance = alpha[g1] + gamma[-1] / UNICODE
                chance = alpha[g2] + gamma[x1] * chance
                chance = alpha[g3] + gamma[x2] * chance
                chance = alpha[: len(p)] + gamma[x3] * chance
                ends = np.cumsum(n)
                sums = np.concatenate([[0.0], np.cumsum(-np.log(chance)[which])])
                out.append(rows_of(len(ids), id=pa.array(ids, pa.int64()), lang=pa.array([lang] * len(ids), pa.string()), m=pa.array(np.full(len(ids), m, np.int32)), n=pa.array(n), surprise=pa.array(sums[ends] - sums[ends - n])))
        return pa.concat_tables(out) if out else kinds.empty_table()

    texts = blocks.select(F.col("block").alias("b"), "lang", "ids", "data")
    return texts.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(score, "id long, lang string, m int, n long, surprise double, block long, ids array<long>, data binary")


def scored_all(rows: DataFrame, known: DataFrame, number: dict[str, int], other: bool) -> DataFrame:
    """The surprises of rows (id, text, lang). Texts are packed for the questions and again for the answers; blocks that were dealt
    otherwise the second time have been written by then, and are asked about once more."""
    done: DataFrame | None = None
    blocks = packed(rows)
    while True:
        out = stored(surprises(blocks, known, number, other), "scored")
        own = out.filter("data is null").select("id", "lang", "m", "n", "surprise")
        done = done.unionByName(own) if done is not None else own
        blocks = out.filter("data is not null").select("block", "lang", "ids", "data")
        if blocks.isEmpty():
            return done


def _held(col: str = "id"):
    return F.pmod(F.xxhash64(col), F.lit(5)) == 0


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Rows (doc_id, lang, n_symbols, perplexity, threshold, keep)."""
    short_batches(docs.sparkSession)
    good = labels.filter("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("id")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    langs = rows.select("id", "lang")
    both = langs.join(good, "id").groupBy("lang").agg(F.max(_held()).alias("held"), F.min(_held()).alias("least")).filter("held and not least")
    number = {r.lang: i for i, r in enumerate(both.orderBy("lang").select("lang").collect())}
    other = any(r.lang not in number for r in langs.select("lang").distinct().toLocalIterator())

    table = stored(model(counted(selected(rows, good.filter(~_held())).select("text", "lang"), number, other)), "model")
    scored = scored_all(rows, table, number, other)

    held = scored.join(good.filter(_held()), "id")
    means = held.groupBy("m").agg((F.sum("surprise") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    limits = perplexity(held.join(F.broadcast(means), "m")).groupBy("m").agg((F.percentile_approx("perplexity", quantile, 10_000) * (1 + F.lit(SLACK) / F.count(F.lit(1)))).alias("threshold"))
    judged = means.join(limits, "m")
    names = docs.sparkSession.createDataFrame([(k, v) for k, v in number.items()], "lang string, own int")
    out = scored.join(F.broadcast(names), "lang", "left").filter(F.col("m") == F.coalesce("own", F.lit(OTHER))).join(F.broadcast(judged), "m", "left")
    out = perplexity(out.withColumn("mean", F.coalesce("mean", F.lit(float(np.log(UNICODE))))).withColumn("threshold", F.coalesce("threshold", F.lit(float("inf")))))
    return out.select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_symbols"), "perplexity", "threshold", ((F.col("perplexity") <= F.col("threshold")) | (F.col("n") == 0)).alias("keep"))


def perplexity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("perplexity", F.exp((F.col("surprise") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)))


def query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
