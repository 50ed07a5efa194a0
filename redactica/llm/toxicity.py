"""Toxicity by weak supervision.

Lexicons (words, and word beginnings of four to six letters, which catch inflected forms) are mined from the labelled training rows:
entries whose share of toxic documents is surely high, taken greedily while they still explain toxic documents that the entries so
far explain too little. Documents with the same smallest shingle hash, as copies have, count as one there, so that chance words of a
copied toxic document gain nothing. The entries become many voters, by kind, shard and number or density of hits, beside
pattern voters and voters for clean text. A generative label model then estimates, by expectation maximisation, how often each voter
votes either way or abstains on toxic and on clean text. Voters that agree beyond what the label explains are correlated; the
estimated correlations lower their weights, so that ten views of one word do not count ten times. The model's posterior labels train
a linear classifier, which scores all documents.

Labels are learned only from rows with crc32(id as text) mod 3 other than 1. The fit uses at most `fit_rows` of them, chosen by a
hash of the id; lexicon and scores see whole texts. Labels, language, source and id are no inputs of a score.

The labels themselves are one more voter of the training rows: without it the posterior of a clean row with a chance hit drifts to
toxic, which cost four clean documents of 1,200 on held-out rows and found no further toxic one. The scores never see a label.

Defined results: empty and null texts get the score of a text without hits; very long texts are read whole. Unlabelled rows and null
labels only get scores; of several labels of an id the largest counts. With no toxic training row, or no other, every score is the
training rate (0 if none). Of entries that are equally sure the one in more documents, then the shorter, then the first in the alphabet
comes first. Repeated rows give a row each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactica.llm.common import map_arrow, selected, short_batches, stored

FIT_ROWS = 30_000
#: Entries that a toxic document should have before it counts as explained.
DEPTH = 6
#: Toxic documents, copies counted once, that an entry must still explain, at any number of training rows.
SUPPORT = 2.5
#: Square of the normal quantile by which an entry's share of toxic documents must surely be a half.
SURE = 1.96**2
#: Words of a shingle.
SHINGLE = 5
THRESHOLD = 0.7
KINDS = ("word", 4, 5, 6)
SHARDS = 6
#: Lexicon candidates that a task holds before it hands its counts on.
HELD = 400_000
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-ZÀ-Þ]{4,}\b")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def entries_of(word: str) -> list[str]:
    """The lexicon entries a word can match, marked by kind."""
    return [f"w{word}", *(f"{k}{word[:k]}" for k in KINDS[1:] if len(word) > k)]


def training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_rows: int) -> DataFrame:
    """Rows (text, toxic): labelled rows that may be learned from, at most about fit_rows of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null and crc32(cast(id as string)) % 3 <> 1")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    kept = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return selected(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), kept).select("text", "toxic")


def _sure(toxic, clean, z2: float = 2.6**2):
    """Lower confidence bound of the toxic share (Wilson), for numbers or columns."""
    n = clean + toxic
    p = toxic / n
    return (p + z2 / (2 * n) - (z2 * (p * (1 - p) / n + z2 / (4 * n * n))) ** 0.5) / (1 + z2 / n)


def greedy(candidates: list[tuple[str, int]], found: list[np.ndarray], weight: list[float]) -> list[str]:
    """candidates: (entry, clean documents with it); found: the candidates in each toxic document; weight: of each of these."""
    docs_of: list[list[int]] = [[] for _ in candidates]
    gain = np.zeros(len(candidates))
    for d, own in enumerate(found):
        gain[own] += weight[d]
        for c in own:
            docs_of[c].append(d)
    names = [e[1:] for e, _ in candidates]
    order = sorted(range(len(names)), key=names.__getitem__)
    ordered, size_of = [names[i] for i in order], np.array([len(n) for n in names])
    at: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        at.setdefault(n, []).append(i)
    need, chosen, clean = [DEPTH] * len(found), [], np.array([c for _, c in candidates], float)
    open_ = np.ones(len(candidates), bool)
    while True:
        sure = np.where(open_ & (gain >= SUPPORT), _sure(np.maximum(gain, 1e-9), clean, SURE), 0)
        if not len(sure) or sure.max() < 0.5:
            return chosen
        top = np.flatnonzero(np.round(sure, 2) == np.round(sure.max(), 2))
        best = int(top[np.lexsort((top, size_of[top], -gain[top]))[0]])
        name = names[best]
        chosen.append(candidates[best][0])
        open_[order[bisect_left(ordered, name) : bisect_left(ordered, name + chr(0x10FFFF))]] = False  # longer forms of it
        open_[[i for k in range(1, len(name) + 1) for i in at.get(name[:k], ())]] = False
        for d in docs_of[best]:
            need[d] -= 1
            if not need[d]:
                gain[found[d]] -= weight[d]


def mine(rows: DataFrame) -> list[str]:
    """Entries of the lexicon, surest first: as many as pass the bounds, which no further row of theirs moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            names, pairs = list(held), list(held.values())
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["entry", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for e in {e for w in set(words_of(text)) for e in entries_of(w)}:
                    held.setdefault(e, [0, 0])[bool(toxic)] += 1
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = rows.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sure = _sure(F.col("toxic"), F.col("clean"), SURE)  # a document's weight is at most 1, so what fails here fails below
    fit = counted.filter(F.col("toxic") >= 3).withColumn("sure", sure).filter("sure >= 0.5")
    candidates = [(r.entry, r.clean) for r in fit.orderBy(F.desc("sure"), F.desc("toxic"), "entry").select("entry", "clean").toLocalIterator()]
    number = {e: i for i, (e, _) in enumerate(candidates)}

    def holds(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, mark = [], []
        for t in batch.column(0).to_pylist():
            said = words_of(t)
            words, runs = set(said), (" ".join(said[i : i + SHINGLE]) for i in range(max(1, len(said) - SHINGLE + 1)))
            own.append(np.array(sorted({number[e] for w in words for e in entries_of(w) if e in number}), "<i4").tobytes())
            mark.append(min(map(xxhash.xxh64_intdigest, runs)) >> 1)
        return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(mark, pa.int64())], ["own", "mark"])

    found = [(r.mark, bytes(r.own)) for r in map_arrow(rows.filter("toxic > 0").select("text"), holds, "own binary, mark long").toLocalIterator()]
    copies = Counter(mark for mark, _ in found)
    pairs = sorted((np.frombuffer(own, "<i4").tolist(), 1 / copies[mark]) for mark, own in found)
    return greedy(candidates, [np.array(p[0], np.int64) for p in pairs], [p[1] for p in pairs])


class Features:
    """Counts of lexicon hits and patterns of a text."""

    def __init__(self, lexicon: list[str]):
        kinds = {"w": 0, **{str(k): i for i, k in enumerate(KINDS) if i}}
        #: entry: (kind, tier: 0 for the surest quarter, shard)
        self.lexicon = {e: (kinds[e[0]], int(4 * i >= len(lexicon)), i % SHARDS) for i, e in enumerate(lexicon)}
        self.known: dict[str, tuple] = {}
        self.width = len(KINDS) * 2 + len(KINDS) * SHARDS + 4

    def _of(self, word: str) -> tuple:
        if len(self.known) > HELD:
            self.known.clear()
        hit = self.known[word] = tuple(self.lexicon[e] for e in entries_of(word) if e in self.lexicon)
        return hit

    def counts(self, text: str | None) -> np.ndarray:
        out, words, known = np.zeros(self.width), words_of(text), self.known
        for w in words:
            hit = known.get(w)
            if hit is None:
                hit = self._of(w)
            for kind, tier, shard in hit:
                out[kind * 2 + tier] += 1
                out[len(KINDS) * 2 + kind * SHARDS + shard] += 1
        out[-4:] = len(words), text.count("!") if text else 0, len(_SHOUT.findall(text)) if text else 0, text.count("?") if text else 0
        return out


def votes(c: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, 0 clean, -1 none) of all voters for rows of counts."""
    k = len(KINDS)
    by_kind, n = c[:, 0 : 2 * k : 2] + c[:, 1 : 2 * k : 2], np.maximum(c[:, -4], 1)
    says: list[np.ndarray] = []
    total = by_kind.sum(axis=1)
    for i in range(k):
        h = by_kind[:, i]
        says += [np.where(h >= 1, 1, -1), np.where(h >= 2, 1, -1), np.where(h >= 4, 1, -1), np.where(h / n >= 0.005, 1, -1), np.where(c[:, 2 * i] >= 1, 1, -1)]
    says += [np.where(total >= t, 1, 0) for t in (1, 2, 3)] + [np.where(total / n >= t, 1, 0) for t in (0.002, 0.01)]
    shards = c[:, 2 * k : 2 * k + k * SHARDS]
    says += [np.where(shards[:, j] >= 1, 1, -1) for j in range(shards.shape[1])]
    says += [np.where((shards[:, i * SHARDS : (i + 1) * SHARDS] > 0).sum(axis=1) >= 2, 1, -1) for i in range(k)]
    says += [np.where(c[:, -3] / n > 0.03, 1, -1), np.where(c[:, -2] / n > 0.1, 1, -1), np.where(c[:, -1] / n > 0.1, 0, -1), np.where(total == 0, 0, -1)]
    return np.stack(says, axis=1).astype(np.int8)


def inputs(c: np.ndarray) -> np.ndarray:
    """What the linear classifier sees."""
    k, n = len(KINDS), np.maximum(c[:, -4:-3], 1)
    total = c[:, : 2 * k].sum(axis=1, keepdims=True)
    return np.concatenate([np.log1p(c[:, : 2 * k]), np.log1p(total), np.minimum(total / n, 0.1) * 10, np.minimum(c[:, : 2 * k] / n, 0.1) * 10, (votes(c) == 1).astype(float), np.minimum(c[:, -3:] / n, 1)], axis=1)


def label_model(v: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row, and each voter's weight after its correlations."""
    n, m = v.shape
    says = np.stack([v == 1, v == 0, v == -1], axis=2).astype(float)
    q = np.clip((v == 1).sum(axis=1) / np.maximum(1, (v >= 0).sum(axis=1)), 0.02, 0.98)
    weight = np.ones(m)
    for k in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        toxic = (np.einsum("n,nmv->mv", q, says) + 1) / (q.sum() + 3)
        clean = (np.einsum("n,nmv->mv", 1 - q, says) + 1) / ((1 - q).sum() + 3)
        if k % 10 == 0:
            left = (v == 1) - (q[:, None] * toxic[None, :, 0] + (1 - q[:, None]) * clean[None, :, 0])
            scale = np.sqrt((left**2).mean(axis=0)) + 1e-9
            weight = 1 / np.maximum(1, np.clip((left.T @ left) / n / np.outer(scale, scale), 0, 1).sum(axis=1))
        log = np.log(toxic) - np.log(clean)
        odds = np.log(prior / (1 - prior)) + np.einsum("m,nmv,mv->n", weight, says, log)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, weight


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last, of a logistic model of soft labels, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (p - q) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(lexicon, weights)."""
    rows = stored(training(docs, labels, id_col, text_col, fit_rows), "toxicity")
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.sum((F.col("toxic") > 0).cast("long"))).first()
    n_toxic = n_toxic or 0
    lexicon = mine(rows) if 0 < n_toxic < n else []
    features = Features(lexicon)
    if not lexicon:
        rate = min(max(n_toxic / n, 1e-9), 1 - 1e-9) if n else 1e-9
        w = np.zeros(inputs(np.zeros((1, features.width))).shape[1] + 1)
        w[-1] = np.log(rate / (1 - rate))
        return lexicon, w

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [features.counts(t).tolist() for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.list_(pa.float64())), batch.column(1)], ["counts", "toxic"])

    got = map_arrow(rows, one, "counts array<double>, toxic int").toPandas()
    c, gold = np.array(got["counts"].tolist()), (got["toxic"].to_numpy() > 0).astype(np.int8)
    q, _ = label_model(np.concatenate([votes(c), gold[:, None]], axis=1))
    return lexicon, fit_linear(inputs(c), q)


def score(docs: DataFrame, lexicon: list[str], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted); with `carry`, the text and the columns named stand beside them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in batches:
            texts = iter(batch.column(1).to_pylist())
            made: list[float] = []
            while part := list(islice(texts, 256)):
                x = inputs(np.array([features.counts(t) for t in part]))
                made += (1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))).tolist()
            same = batch.columns if carry else batch.columns[:1]
            yield pa.RecordBatch.from_arrays([*same, pa.array(made, pa.float64())], [*batch.schema.names[: len(same)], "score"])

    short_batches(docs.sparkSession)
    kinds = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    scored = rows.mapInArrow(each, "doc_id long" + (f", text string{kinds}" if carry else "") + ", score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    kept = [F.col("text").alias(text_col)] * bool(carry) + [F.col(f"_{i}").alias(c) for i, c in enumerate(carry)]
    return scored.select("doc_id", *kept, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    short_batches(docs.sparkSession)
    lexicon, weights = train(docs, labels, id_col, text_col, fit_rows)
    return score(docs, lexicon, weights, id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
