"""Joins by bins and cells, sentences on pages, and block-wise retrieval, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F
from redactica.functions import grid
from redactica.operators import model_review, retrieval, scoring


def boxes(rng, n, big=0.1):
    out = []
    for k in range(n):
        x, y = rng.uniform(-40, 600), rng.uniform(0, 800)
        size = (lambda: rng.uniform(0, 900)) if rng.random() < big else (lambda: rng.choice([0.0, rng.uniform(0, 20)]))
        out.append((k, rng.choice([1, 2]), x, y, x + size(), y + size()))
    return [*out, (n, 1, 0.0, 0.0, 1e9, 1e9), (n + 1, 2, None, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_meet_once_through_cells(spark, seed):
    rng = random.Random(seed)
    a, b = boxes(rng, 150), boxes(rng, 150)
    left = spark.createDataFrame(a, "k int, page int, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "k2 int, page int, ax0 double, ay0 double, ax1 double, ay1 double")
    near = "x0 <= ax1 + 0.5 and ax0 - 0.5 <= x1 and y0 <= ay1 + 0.5 and ay0 - 0.5 <= y1"
    got = sorted((r.k, r.k2) for r in grid.meeting(left, right, ["page"], near, b_box=("ax0", "ay0", "ax1", "ay1"), tolerance=0.5).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if None not in p + q and p[1] == q[1] and p[2] <= q[4] + 0.5 and q[2] - 0.5 <= p[4] and p[3] <= q[5] + 0.5 and q[3] - 0.5 <= p[5])
    assert got == want and len(got) > 300


def test_intervals_meet_once_through_bins(spark):
    rng = random.Random(3)
    make = lambda n, most: [(k, rng.choice("ab"), s := rng.randint(0, 900), s + rng.randint(0, most)) for k in range(n)]
    a, b = make(80, 700), make(200, 30)
    got = grid.overlapping(spark.createDataFrame(a, "k int, g string, s int, e int"), spark.createDataFrame(b, "k2 int, g string, start int, end int"), ["g"], ("s", "e"), ("start", "end")).collect()
    assert sorted((r.k, r.k2) for r in got) == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and q[3] > p[2] and q[2] < p[3])


def test_ten_thousand_boxes_on_one_page(spark):
    x = (F.col("id") % 200 * 3).cast("double")
    y = (F.floor(F.col("id") / 200) * 10).cast("double")
    chars = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("span_id"), F.lit(0).alias("i"), F.lit(1).alias("page"), F.lit("a").alias("c"), x.alias("x0"), y.alias("y0"), (x + 2).alias("x1"), (y + 8).alias("y1"))
    fills = chars.filter("span_id % 2 = 0").select("doc_id", "page", "x0", "y0", "x1", "y1")
    began = time.time()
    rows = {r.status: r.n for r in scoring.span_scores(scoring.char_status(chars, fills, chars)).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows == {"full": 10_000} and scoring.over_redaction(fills, chars).count() == 0 and time.time() - began < 60


def brute_place(pages, sentence):
    want = sentence.split()
    for page in sorted(pages):
        words = pages[page]
        for fold in (str, str.lower):
            for i in range(len(words) - len(want) + 1):
                if want and [fold(w) for w in words[i : i + len(want)]] == [fold(w) for w in want]:
                    return page, i
    return None


def test_sentences_are_found_where_a_plain_search_finds_them(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "A", "b", "c.", "Ż", "ż"])
    docs = {d: {p: [word() for _ in range(rng.randint(0, 25))] for p in range(1, 4)} for d in range(25)}
    asked = []
    for d, pages in docs.items():
        for k in range(12):
            own = pages[rng.randint(1, 3)]
            i = rng.randint(0, max(0, len(own) - 1))
            run = own[i : i + rng.randint(0, 9)] if k % 3 else [word() for _ in range(rng.randint(1, 3))]
            asked.append((d, f"s{k}", "  ".join(w.lower() if k % 4 == 1 else w for w in run)))
    asked += [(99, "s0", "a"), (0, "null", None)]
    pages = spark.createDataFrame([(d, p, w) for d, of in docs.items() for p, w in of.items()], "doc_id int, page int, words array<string>")
    got = {(r.doc_id, r.id): (r.page, r.word) for r in model_review.located(spark.createDataFrame(asked, "doc_id int, id string, sentence string"), pages).collect()}
    want = {(d, k): brute_place(docs.get(d, {}), s or "") or (None, None) for d, k, s in asked}
    assert got == want and sum(v[0] is not None for v in got.values()) > 150


@pytest.mark.parametrize(("block_chunks", "first_blocks"), [(64, 8), (3, 1), (1, 2)])
def test_blocks_give_what_all_postings_give(spark, block_chunks, first_blocks):
    rng = random.Random(block_chunks)
    vocabulary = [f"w{k}" for k in range(60)] + ["the"] * 30
    pieces = [(f"f{k % 37}", k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for k in range(300)] + [("f1", 900, ""), ("f2", 901, None)]
    questions = [(q, " ".join(rng.choice([*vocabulary, "none"]) for _ in range(rng.randint(1, 6)))) for q in range(30)] + [(50, "nothing here"), (51, "")]
    chunks = spark.createDataFrame(pieces, "source_file string, chunk_index int, text string")
    asked = spark.createDataFrame(questions, "q_id int, question string")
    shown = lambda df: sorted((r.q_id, r["rank"], r.source_file, r.chunk_index, round(r.score, 9)) for r in df.collect())
    found, read = retrieval.top_k_blocks(retrieval.block_index(chunks, block_chunks), asked, 3, first_blocks)
    assert shown(found) == shown(retrieval.top_k(retrieval.token_index(chunks), asked, 3))
    counts = {r.q_id: (r.postings_read, r.postings) for r in read.collect()}
    assert all(a <= b for a, b in counts.values())
    if block_chunks == 1:
        assert sum(a for a, _ in counts.values()) < 0.8 * sum(b for _, b in counts.values())
