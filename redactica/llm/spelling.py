"""Spelling variants by a rare-first prefix filter over positional bigrams.

Words are near if they differ by one inserted, deleted or replaced code point. One such edit destroys two bigrams at most, so if the
bigrams of both words are ordered globally, rarest first, the three first of either share one that the edit leaves alone, and its
position moves by one at most. So

1. bigrams of the distinct words are counted in buckets of fixed number, and each word keeps its three rarest with their positions,
2. for each of them the word gets keys. An edit lies after a surviving bigram or before it, so what comes before it, or what comes after
   it, is the same in both words, and so is its distance from the start or from the end: that, with the length of the shorter word, is
   the key. Words meet where keys are equal, which is the position limit in the form of an equality,
3. under a key with many words the part that may differ is halved, and one of the halves is the same as well: the words meet under the
   longer keys instead, down to a part of one code point. What is left is compared directly, code point by code point.

Keys are met in sorted batches of bounded size. A key with more words than `HELD` is not met in a task at all: its words are dealt again
under their longer keys, in another round. So no key is quadratic in its words. Only pairs that are near are emitted, and each once.

Then each word has its number of near words and its form, the most frequent near word if that is so many times as frequent. Forms of
forms are followed by doubling, in rounds of the order of the logarithm of the longest chain.

Defined results: a null text has no words, a null id is written as the empty string where ids are part of a hash. A very long word is
handled whole. Equally frequent near words: the first in code-point order is the form. Repeated rows count as often as they are there.
An empty table gives no rows. Other columns are ignored, whatever their names. Words shorter than four code points have too few bigrams
for the filter, so `least` must be four or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactica.llm.common import documents, mixed, stored

LEAST, OFTEN, TIMES = 7, 2, 10
#: Buckets of bigrams, a power of two: what is broadcast is a count for each, at any size of the corpus.
BUCKETS = 1 << 16
#: Rarest bigrams of a word: two are destroyed by an edit.
RARE = 3
#: Rows of a key that a task holds at most.
HELD = 100_000
#: Words under one key that are compared with each other.
FEW = 6
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Letters:
    """Words as one array of code points, with hashes of all their beginnings and ends."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.arange(len(self.codes)) - np.repeat(self.starts, self.sizes)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, position, bigram) of all bigrams."""
        first = np.flatnonzero(self.at < np.repeat(self.sizes, self.sizes) - 1)
        pair = self.codes[first].astype(np.uint64) << np.uint64(32) | self.codes[first + 1].astype(np.uint64)
        return np.repeat(np.arange(len(self.sizes)), np.maximum(self.sizes - 1, 0)), self.at[first], pair

    def keys(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, short: np.ndarray) -> np.ndarray:
        """A hash of the first a and the last b code points of words w, and of the length of the shorter word of a pair."""
        if not hasattr(self, "sums"):
            longest = int(self.sizes.max()) + 1
            self.back = np.cumprod(np.full(longest, _INVERSE, np.uint64)) * np.uint64(_BASE)
            powers = np.cumprod(np.full(longest, _BASE, np.uint64)) * np.uint64(_INVERSE)
            self.sums = np.append(np.uint64(0), np.cumsum(mixed(self.codes.astype(np.uint64) + np.uint64(1)) * powers[self.at], dtype=np.uint64))
        head = self.sums[self.starts[w] + a] - self.sums[self.starts[w]]
        tail = (self.sums[self.ends[w]] - self.sums[self.ends[w] - b]) * self.back[self.sizes[w] - b]
        out = mixed(head + mixed(a.astype(np.uint64) + np.uint64(11)))
        out = mixed(out ^ tail + mixed(b.astype(np.uint64) + np.uint64(29)))
        return mixed(out ^ short.astype(np.uint64))


def bucket(bigrams: np.ndarray) -> np.ndarray:
    return (mixed(bigrams) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bigram_counts(words: DataFrame) -> np.ndarray:
    """How many bigrams of rows (word) fall into each bucket: a fixed number of counts comes to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(bucket(Letters(batch.column(0).to_pylist()).bigrams()[2]), minlength=BUCKETS)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in words.select("word").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def rarest(letters: Letters, counts: np.ndarray, n: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(word, position) of the n bigrams of each word that come first in the global order."""
    w, at, pair = letters.bigrams()
    order = np.lexsort((at, pair, counts[bucket(pair)], w))
    w, at = w[order], at[order]
    rank = np.arange(len(w)) - np.searchsorted(w, w)
    return w[rank < n], at[rank < n]


#: A word under a key: whether it is the longer word of a pair, and how much of its start and end the key holds.
KEYED = "key long, longer boolean, a int, b int, word string, n long"
#: A near pair (word, n, near, near_n), or a word that is dealt again (far false).
MET = f"pair boolean, near string, near_n long, {KEYED}"
_MET = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int64()]


def keyed(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """The rows (word, n) under their keys."""
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = Letters(batch.column(0).to_pylist())
            w, p = rarest(letters, shared.value)
            size = letters.sizes[w]
            none, both = np.zeros_like(p), np.concatenate
            a, b, of = both([p + 2, none]), both([none, size - p]), both([w, w])
            longer = np.repeat([False, True], len(of))
            a, b, of = np.tile(a, 2), np.tile(b, 2), np.tile(of, 2)
            short = letters.sizes[of] - longer
            own = np.flatnonzero(a + b <= short)
            a, b, of, longer, short = a[own], b[own], of[own], longer[own], short[own]
            taken = [batch.column(c).take(pa.array(of)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(letters.keys(of, a, b, short).view(np.int64)), pa.array(longer), pa.array(a, pa.int32()), pa.array(b, pa.int32()), *taken], ["key", "longer", "a", "b", "word", "n"])

    return words.select("word", "n").mapInArrow(each, KEYED)


def near(x: str, y: str, a: int = 0) -> bool:
    """Whether x and y, which is as long or longer by one, differ by one edit; a code points at the start are probably the same."""
    if x == y or x[:a] != y[:a]:
        return x != y and near(x, y)
    for i in range(a, len(x)):
        if x[i] != y[i]:
            return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]
    return len(y) == len(x) + 1


class Rows:
    """Words under keys, as arrays."""

    def __init__(self, letters: Letters, w: np.ndarray, longer: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.letters, self.w, self.longer, self.a, self.b = letters, w, longer, a, b
        self.short = letters.sizes[w] - longer

    def take(self, own: np.ndarray) -> Rows:
        return Rows(self.letters, self.w[own], self.longer[own], self.a[own], self.b[own])

    def open(self) -> np.ndarray:
        """Whether the part that may differ can be halved."""
        return self.short - self.a - self.b > 1

    def finer(self) -> Rows:
        """The same words under the two longer keys."""
        rest = self.short - self.a - self.b
        half = rest // 2
        same = [np.tile(x, 2) for x in (self.w, self.longer)]
        return Rows(self.letters, *same, np.concatenate([self.a + half, self.a]), np.concatenate([self.b, self.b + rest - half]))

    def keys(self) -> np.ndarray:
        return self.letters.keys(self.w, self.a, self.b, self.short)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(shorter or equal word, other word, start that is the same) of rows that are few under their key."""
        key = self.keys()
        order = np.lexsort((self.w, self.longer, key))
        key, rows = key[order], self.take(order)
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        head = np.flatnonzero(new)
        usable = (size > 1) & ~rows.longer[head]  # a pair needs a word that is not the longer one
        many = usable & (size > FEW) & rows.open()[head]
        if many.any():
            yield from rows.take(np.flatnonzero(many[group])).finer().candidates()
        left = np.flatnonzero((usable & ~many)[group])
        key, rows = key[left], rows.take(left)
        lag = 1
        at = np.flatnonzero(~rows.longer)
        while True:
            at = at[at + lag < len(key)]
            at = at[key[at] == key[at + lag]]
            if not at.size:
                break
            yield rows.w[at], rows.w[at + lag], rows.a[at]
            lag += 1


def met(rows: DataFrame, held_most: int = HELD) -> DataFrame:
    """The near pairs of rows under keys, and the rows whose key has too many; rows are sorted by key within their partition."""

    def batch_of(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else pa.array(c).cast(k) for c, k in zip(columns, _MET, strict=True)], [c.split()[0] for c in MET.split(", ")])

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        longer, a, b = (table.column(c).to_numpy() for c in ("longer", "a", "b"))
        rows_ = Rows(Letters(words), np.arange(len(words)), longer, a.astype(np.int64), b.astype(np.int64))
        found: dict[tuple[str, str], tuple[int, int]] = {}
        for x, y, same in rows_.candidates():
            for i, j, s in zip(x.tolist(), y.tolist(), same.tolist(), strict=True):
                p, q = words[i], words[j]
                if len(p) == len(q) and p > q:
                    p, q, i, j = q, p, j, i
                if (p, q) not in found and near(p, q, s):
                    found[p, q] = (int(n[i]), int(n[j]))
        if found:
            p, q = zip(*found, strict=True)
            np_, nq = zip(*found.values(), strict=True)
            k = len(found)
            yield batch_of([True] * k, list(q), list(nq), [None] * k, [None] * k, [None] * k, [None] * k, list(p), list(np_))

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        longer, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("longer", "a", "b"))
        rows_ = Rows(Letters(words), np.arange(len(words)), longer, a.astype(np.int64), b.astype(np.int64)).finer()
        k = len(rows_.w)
        return batch_of([False] * k, [None] * k, [None] * k, rows_.keys().view(np.int64), rows_.longer, rows_.a, rows_.b, [words[i] for i in rows_.w.tolist()], n[rows_.w])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, hot = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            if hot is not None:
                n = int(np.searchsorted(key != hot, True))  # the rows go on with the hot key up to here
                if n:
                    yield again(batch.slice(0, n))
                if n == len(key):
                    continue
                batch, key, hot = batch.slice(n), key[n:], None
            cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])  # where the last key begins
            if cut or (held and held[-1].column("key")[-1].as_py() != key[0]):
                held.append(batch.slice(0, cut))
                if size + cut >= held_most:
                    yield from pairs(held)
                    held, size = [], 0
                else:
                    size += cut
                batch = batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
            last = int(key[-1])
            if size >= held_most:
                own = [b for b in held if b.num_rows and b.column("key")[0].as_py() == last]
                before = [b for b in held if b.num_rows and b.column("key")[0].as_py() != last]
                n = sum(b.num_rows for b in own)
                if n >= held_most and int(len(own[0].column("word")[0].as_py())) - bool(own[0].column("longer")[0].as_py()) - own[0].column("a")[0].as_py() - own[0].column("b")[0].as_py() > 1:
                    if before:
                        yield from pairs(before)
                    for b in own:
                        yield again(b)
                    held, size, hot = [], 0, last
                elif before:
                    yield from pairs(before)
                    held, size = own, n
        if held:
            yield from pairs(held)

    return rows.mapInArrow(each, MET)


def near_pairs(words: DataFrame, held_most: int = HELD) -> DataFrame:
    """Rows (word, n, near, near_n): the near pairs of rows (word, n), each once."""
    rows = keyed(words, bigram_counts(words))
    found: DataFrame | None = None
    while True:
        out = stored(met(rows.repartition("key").sortWithinPartitions("key"), held_most), "met")
        pairs = out.filter("pair").select("word", "n", "near", "near_n")
        found = found.unionByName(pairs) if found is not None else pairs
        rows = out.filter("not pair").select("key", "longer", "a", "b", "word", "n")
        if rows.isEmpty():
            return found.distinct()


def followed(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form) without cycles: the end of each word's chain of forms."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        now = stored(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, held_most: int = HELD) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) of rows (word, n); n_near counts the near words."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = stored(near_pairs(words, held_most), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    each = both.groupBy("word").agg(F.first("n").alias("own"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    each = each.select("word", "n_near", F.when(-F.col("best.m") >= times * F.col("own"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("to"))
    each = stored(each.select("word", "n_near", "to.form", "to.form_n"), "near")
    roots = followed(each.filter("form is not null"))
    out = words.join(each.join(roots, "word", "left"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def counted(runs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """Rows (word, n) of the words, of at least so many code points, that rows (word) hold often enough."""
    if least < RARE + 1:
        raise ValueError("shorter words have too few bigrams")
    return runs.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, run): maximal runs of letters, A-Z lower-cased; those too short for a word are not looked at."""
    low = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))


def query(spark, sf_dir: str) -> DataFrame:
    found = runs(documents(spark, sf_dir)).withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return variants(counted(found.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))))


#: Near words of one length agree when the same place is left out of both; others when one place is left out of the longer.
SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
), u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS k FROM r GROUP BY 1, 2),
h AS (
  SELECT run, k, xor(list_reduce(flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM u, crc
), w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM h)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2
), d AS (SELECT word, n, i, CASE WHEN i = 1 THEN '' ELSE word[1 : i - 1] END || word[i + 1 :] AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT DISTINCT word, o, m FROM (
    SELECT a.word, b.word AS o, b.n AS m FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT d.word, w.word, w.n FROM d JOIN w ON d.s = w.word
    UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON d.s = w.word
  )
), f AS (
  SELECT word, count(*) AS n_near, min({'m': -m, 'o': o}) AS b FROM near GROUP BY 1
), g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * n THEN b.o END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n FROM w LEFT JOIN f USING (word)),
c AS (WITH RECURSIVE c(word, place, k) AS (SELECT word, word, 0 FROM g UNION ALL SELECT c.word, g.form, k + 1 FROM c JOIN g ON g.word = c.place WHERE g.form IS NOT NULL) SELECT word, arg_max(place, k) AS root FROM c GROUP BY 1)
SELECT g.word, g.n, g.n_near, g.form, g.form_n, c.root FROM g JOIN c USING (word)
"""
