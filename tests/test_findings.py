"""What a review of queries at larger sizes found."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from redactica.functions import catalogue as C
from redactica.functions import grid, regex
from redactica.functions import spans as S
from redactica.operators import automaton, cascade, detect, geometry, ner, retrieval, review, scoring, synthetic
from redactica.plans import fixtures
from redactica.sources import scratch

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["span_scores", "glyph_scores", "over_redaction", "words_under_boxes", "doc_summary", "doc_details", "recall"])
def test_no_boxes_pass_through_the_driver(spark, name):
    plan = entry.queries()[name](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_sizes_are_rounded_as_c_does(spark):
    rows = spark.createDataFrame([(262144.0,), (786432.0,), (1310720.0,), (115343.36,), (104857.7,)], "b double")
    assert [r.t for r in rows.select(review.size_text(F.col("b")).alias("t")).collect()] == [f"{b / 1048576:.1f} MB" for b in (262144.0, 786432.0, 1310720.0, 115343.36, 104857.7)]


def test_sentences_move_words_once_and_none_through_the_driver(spark):
    plans = {n: entry.queries()[n](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString() for n in ("sentence_places", "suggestion_rects")}
    assert "Window" not in plans["sentence_places"]
    assert "BroadcastExchange" not in plans["suggestion_rects"]


def test_first_words_are_found_at_the_start_though_they_come_again_in_lower_case(spark, tmp_path):
    spark.createDataFrame([(1, "The big cat saw the big cat here"), (2, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in entry.queries()["sentence_run"](spark, str(tmp_path)).collect()] == [(1, 1, 0)]


def test_a_search_that_skips_finds_the_same():
    rng = random.Random(5)
    patterns = [*C.DETECTORS.values(), *((p, False) for p in (C.WEAK_PHONE, *C.BARE_VALUE.values(), C.PATRON_FACILITY, C.QUOTED_ORGANISATION))]
    heads = {p for p, _ in patterns if regex._behind(p) != p}
    assert C.WEAK_PHONE in heads and C.BARE_VALUE["REGON"] in heads and C.DETECTORS["PESEL"][0] in heads
    for _ in range(400):
        text = "".join(rng.choice(["1", "22", "333", "123456789", "-", " ", ".", "A", "Ab", "ABC123456", "_", "NIP", "im.", "\n", "٣", "+", "sp. z o.o."]) for _ in range(60))
        for p, fold in patterns:
            plain = re.compile(p, re.IGNORECASE if fold else 0)
            assert [m.span() for m in plain.finditer(text)] == [m.span() for m in regex.python(p, fold).finditer(text)]


def test_made_texts_are_dealt_out_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "MADE", 1000)
    spark.range(5000).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp'2020-01-01' as o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert fixtures.notes(spark, str(tmp_path)).rdd.getNumPartitions() > 20


def test_the_cascade_runs_once_for_a_gap(spark):
    plan = entry.queries()["coverage_gap"](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_texts_that_come_out_otherwise_when_made_again_are_masked_whole(spark):
    """More parts than one pass takes; each making of a text shuffles its words."""
    words = [f"word{k}x" for k in range(8)]

    @F.udf("string")
    def mixed(n):
        some = ["of " * (k + 1) + w for k, w in enumerate(words)]
        random.Random().shuffle(some)
        return " ".join(some)

    docs = spark.range(50).select(F.col("id").alias("doc_id"), mixed.asNondeterministic()("id").alias("text"))
    terms = spark.createDataFrame([(w, f"L{k}") for k, w in enumerate(words)], "term string, label string")
    for r in automaton.masked(docs, terms, part_chars=2).collect():
        assert r.counters == {f"L{k}": 1 for k in range(8)}
        assert re.sub(r"of |\[L\d\]| ", "", r.masked) == ""


def test_texts_are_cut_some_bytes_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["aa", None, "b" * 9, "", "cc", "dd", "e"])], ["k", "t"])
    parts = list(retrieval.slices(batch, 1, 4))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5], [6]]


def test_tokens_are_counted_where_their_piece_lies(spark):
    docs = spark.createDataFrame([("a", 1, "One two one x"), ("b", 1, None), ("c", 2, "")], "source_file string, chunk_index int, text string")
    index = retrieval.token_index(docs)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in index.collect()) == [("a", 1, 3, "one", 2), ("a", 1, 3, "two", 1)]


def test_words_that_no_span_reaches_are_not_dealt_over_bins(spark):
    rows = [(1, 1, 0, 0, k, f"w{k:05d}", 0.0, 0.0, 1.0, 1.0) for k in range(500)]
    words = spark.createDataFrame(rows, "doc_id long, page int, block_no int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(7, 1, 1, "X", 14, 27)], "span_id long, doc_id long, page int, label string, s int, e int")
    seen, before = [], grid.overlapping
    try:
        grid.overlapping = lambda a, b, *rest: seen.append(b.count()) or before(a, b, *rest)
        assert [r.text for r in geometry.span_words(geometry.word_pages(words), spans).collect()] == ["w00002", "w00003"]
    finally:
        grid.overlapping = before
    assert seen == [2]


def test_entities_are_resolved_in_many_tasks(spark):
    docs = spark.createDataFrame([(k, "Jan Nowak") for k in range(40)], "doc_id long, text string")
    found = docs.select("doc_id", F.lit("raw").alias("pass"), F.lit(0).alias("ord"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit("persName").alias("model_label"))
    out = ner.resolved(docs, found)
    assert out.rdd.getNumPartitions() >= 16 and out.count() == 40


def test_characters_of_keys_lie_where_the_text_has_them(spark):
    text = "a b\nżółw 😀x\n\nyz q"
    key = spark.createDataFrame([(1, "k", 1, 2, 15, text), (1, "l", 1, 4, 8, text)], "doc_id long, span_id string, page int, s int, e int, text string")
    rows = {(r.span_id, r.i): (r.c, r.x0, r.y0) for r in synthetic.key_chars(key).collect()}
    want = {}
    for name, s, e in (("k", 2, 15), ("l", 4, 8)):
        for i, c in enumerate(text[s:e]):
            head = text[: s + i]
            if c not in " \n":
                want[name, i] = (c, synthetic.LEFT + synthetic.WIDTH * len(head.split("\n")[-1]), synthetic.TOP + synthetic.LINE * head.count("\n"))
    assert rows == want


#: Texts in which one character is the neighbour of two matches, and how often the audit's label is in each.
SIDE_BY_SIDE = (("A.\nThatha " * 24, "INITIAL_SURNAME", 24), ("al. De al. De ", "STREET_LIKE", 2), ("x@y.pl x@y.pl;x@y.pl", "EMAIL", 3), ("12-345 67-890", "POSTAL_CODE", 2), (None, "EMAIL", 0))


def test_an_audit_counts_both_of_two_matches_that_share_a_neighbour(spark, tmp_path):
    rows = [(k, text, "en") for k, (text, _, _) in enumerate(SIDE_BY_SIDE)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in entry.queries()["audit_documents"](spark, str(tmp_path)).collect():
        text, label, n = SIDE_BY_SIDE[r.doc_id]
        assert n == len(re.findall(C.AUDIT[label], text or ""))
        assert (r[label], r.total) == (n, n)


def test_labels_count_both_of_two_matches_that_share_a_neighbour(spark, tmp_path):
    rows = [(1, "x@y.pl x@y.pl", "en"), (2, "x@y.pl;al.\nThatha al.\nThatha ", "en"), (3, "12-345 67-890", None), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.lang, r.label): r.n for r in entry.queries()["label_counts_documents"](spark, str(tmp_path)).collect()}
    assert (found["en", "EMAIL"], found["en", "ULICA"], found[None, "POSTAL_CODE"]) == (3, 2, 2)
    for lang in ("en", None):
        for label, (pattern, fold) in C.DETECTORS.items():
            of = re.compile(pattern, re.IGNORECASE if fold else 0)
            assert found.pop((lang, label)) == sum(len(of.findall(text)) for _, text, of_lang in rows if of_lang == lang and text), (lang, label)
    assert not found


def test_towns_are_looked_for_once_and_words_inflected_once(spark):
    towns = detect.town_pattern(detect.town_names(F.col("text")))
    plan = spark.createDataFrame([("00-512 Kamionka",)], "text string").select(towns.alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
    assert plan.count(C.PLACE_ENDING) == 1


def test_texts_without_what_a_rule_needs_are_not_searched(spark):
    text = F.col("text")
    docs = spark.createDataFrame([("Szkoła Marii",), (None,)], "text string")
    row = docs.select(detect.organisations(text).alias("o"), detect.table_pairs(text, "NIP").alias("p")).collect()
    assert [tuple(r) for r in row] == [([], []), (None, [])]
    plan = docs.select(detect.organisations(text).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert "contains(text" in plan.lower() and "im." in plan


def test_matches_begin_as_the_catalogue_says():
    rng = random.Random(6)
    seen = set()
    for _ in range(3000):
        text = "".join(rng.choice(["12345678901", "ABA300000", "PL61 1090 1014 0000 0712 1981 2874", "nip 5260001246", "REGON: 123456785", "Kwiatek Sp. z o.o.", "600100200", "+48 600 100 200", "2020-01-02", "ul. Lipowa 3", "Adres Lipowa 3", "pl. Nowy", "00-512 Kamionka", "Anna-Kowalska Maria", " ", "\n", ",", "x", "٣"]) + rng.choice(["", " "]) for _ in range(6))
        for label, (pattern, fold) in C.DETECTORS.items():
            plain, ahead = re.compile(pattern, re.IGNORECASE if fold else 0), re.compile(f"(?={C.FIRST[label]}){pattern}" if label in C.FIRST else pattern, re.IGNORECASE if fold else 0)
            spans = [m.span() for m in plain.finditer(text)]
            assert spans == [m.span() for m in ahead.finditer(text)], (label, text)
            seen |= {label} if spans else set()
    assert seen >= set(C.FIRST)


@pytest.mark.parametrize("overlapping", [(), (2,)])
def test_ranked_claims_are_those_of_a_plain_loop(spark, overlapping):
    rng, kind = random.Random(7), "struct<s:int,e:int,r:int,label:string>"
    rows = []
    for k in range(300):
        found = []
        for r in range(5):  # of one rank disjoint, but for those that may overlap
            at = 0
            for _ in range(rng.randint(0, 4)):
                s = rng.randint(0, 30) if r in overlapping else at + rng.randint(0, 12)
                found.append((s, s + rng.randint(0, 5), r, rng.choice("ab")))
                at = found[-1][1]
        rows.append((k, found))
    want = {}
    for k, found in rows:
        kept = []
        for x in sorted(found, key=lambda x: (x[2], x)):
            if x[0] < x[1] and not any(x[0] < y[1] and y[0] < x[1] for y in kept):
                kept.append(x)
        want[k] = sorted(kept)
    got = spark.createDataFrame(rows, f"k int, found array<{kind}>").select("k", S.ranked_claims(F.col("found"), kind, 5, overlapping).alias("c")).collect()
    assert {r.k: [tuple(x) for x in r.c] for r in got} == want


def _made(spark, n):
    return synthetic.corpus(spark.range(n).withColumnRenamed("id", "n"))


def test_recall_of_a_corpus_moves_numbers_and_writes_nothing(spark, monkeypatch):
    def never(*_):
        raise AssertionError("written")

    monkeypatch.setattr(scratch, "stored", never)
    monkeypatch.setattr(geometry, "stored", never)
    plan = entry.queries()["corpus_recall"](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    moved = re.findall(r"(?<!Broadcast)Exchange (\w+)\(([\w#]*)", plan)
    assert [(kind, column.partition("#")[0]) for kind, column in moved if kind != "SinglePartition"] == [("hashpartitioning", "kind"), ("RoundRobinPartitioning", "4")]


def test_claims_beside_documents_are_those_in_rows(spark):
    docs = spark.createDataFrame([(1, "a", f"PESEL 12345678901{C.PAGE_SEPARATOR}00-512 Kamionka, w Kamionce"), (2, "b", None), (3, "c", "")], "doc_id long, other string, text string")
    beside = cascade.with_claims(docs, 2026)
    assert beside.columns == ["doc_id", "other", "text", "claims"]
    rows = [(r.doc_id, k, *x) for r in beside.collect() for k, page in enumerate(r.claims, 1) for x in page]
    assert sorted(rows) == sorted(tuple(r) for r in cascade.claimed(docs, 2026).collect()) and len(rows) == 3
    assert [len(r.claims) for r in beside.orderBy("doc_id").collect()] == [2, 1, 1]


def test_boxes_within_a_row_are_those_of_joins(spark):
    """Spans of any kind: over blanks, lines and parts of words, and outside of the text."""
    rng = random.Random(8)
    texts = synthetic.paged(_made(spark, 40)).select("doc_id", "page", "text").collect()
    spans = [(f"{k}-{i}", r.doc_id, r.page, "X", s, s + rng.randint(0, 40)) for k, r in enumerate(texts) for i in range(8) for s in [rng.randint(0, len(r.text) + 3)]]
    spans += [(f"{k}-w{i}", r.doc_id, r.page, "X", m.start(), m.end()) for k, r in enumerate(texts) for i, m in enumerate(re.finditer(r"\w+(?:\s\w+){0,4}", r.text))]
    rows = spark.createDataFrame(spans, "span_id string, doc_id long, page int, label string, s int, e int")
    made = _made(spark, 40)
    joined = geometry.line_rects(geometry.span_words(geometry.word_pages(synthetic.words(made)), rows))
    want = sorted((r.doc_id, r.page, r.x0, r.y0, r.x1, r.y1) for r in joined.collect())
    beside = synthetic.paged(made).join(rows.groupBy("doc_id", "page").agg(F.collect_list(F.struct("s", "e")).alias("spans")), ["doc_id", "page"])
    boxes = beside.select("doc_id", "page", F.explode(geometry.page_rects(F.col("text"), synthetic.page_words(F.col("text")), F.col("spans"))).alias("b")).select("doc_id", "page", "b.*")
    assert sorted(tuple(r) for r in boxes.collect()) == want and len(want) > 200


def test_leaks_within_a_row_are_those_of_joins(spark):
    rng = random.Random(9)
    text = "a b\nżółw 😀x\n\nyz q"
    keys = [(f"k{k}", 1, 1, s, s + n, text) for k, (s, n) in enumerate([(2, 13), (4, 4), (0, 1), (9, 2), (12, 5), (3, 1)])]
    edge = lambda least, most: round(rng.uniform(least, most) * 2) / 2
    fills = [(x, y, x + edge(0, 30), y + edge(0, 25)) for _ in range(6) for x, y in [(edge(45, 80), edge(35, 80))]]
    key = spark.createDataFrame(keys, "span_id string, doc_id long, page int, s int, e int, text string")
    boxes = spark.createDataFrame([(1, 1, *f) for f in fills], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    joined = scoring.span_scores(scoring.char_status(synthetic.key_chars(key), boxes))
    beside = key.join(boxes.groupBy("doc_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes")), "doc_id")
    centres = synthetic.key_centres(F.col("text"), F.col("s"), F.col("e"))
    got = beside.select("span_id", F.size(centres).alias("total"), scoring.leaks(centres, F.col("boxes")).alias("leaked")).filter("total > 0")
    assert sorted(map(tuple, got.collect())) == sorted((r.span_id, r.total, r.leaked) for r in joined.collect())
