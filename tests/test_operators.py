"""Entities, geometry, review, model answers, retrieval, scoring, sources, sinks, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from redactica.operators import geometry, model_review, ner, retrieval, review, rollup, scoring
from redactica.sources import readers, writers
from redactica.streaming import inbox


def test_entities_bridged_pass_claims_first():
    text = "Pani Jan\nKowalski oraz [NER_ORG] Salmonella enterica"
    found = list(ner.resolve(text, [("bridged", 0, 5, 17, "NER_PERSON"), ("raw", 0, 5, 8, "NER_PERSON"), ("raw", 1, 24, 31, "NER_ORG"), ("raw", 2, 33, 52, "NER_MISC"), ("raw", 3, 0, 4, "NER_ORG")]))
    assert found == [(0, 17, "NER_PERSON", None), (33, 52, "NER_MISC", "SCIENTIFIC_NAME")]


def test_entity_exclusions_native_equal_python(spark):
    values = ["wersja 2.10, 2024", "PESEL", "Ministra Zdrowia", "w Ministra – Zdrowia", "Quercus robur", "Jan Testowski", "who", "Whoo", "odra", "kodra", " ", "błonica - tężec - krztusiec"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", ner.exclusion(F.col("v"), F.lit("NER_PERSON")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: ner._excluded(v, "NER_PERSON") for i, v in enumerate(values)}


def test_analysis_text_keeps_length():
    text = "Jan\nKowalski\nlives\u00a0in – x\nAnna\n\nNowak"
    assert ner.analysis_text(text, True) == "Jan Kowalski\nlives in - x\nAnna\n\nNowak"
    assert len(ner.analysis_text(text, False)) == len(text)


@pytest.mark.parametrize(("padding", "start", "safe"), [("", True, True), (".,", True, True), ("-Nowak", True, True), ("-Maria-Zaremba,", True, True), ("Nowak", True, False), ("Zaremba-", False, True), ("x1-", False, False), ("-", True, False)])
def test_padding(spark, padding, start, safe):
    assert spark.range(1).select(geometry.safe_padding(F.lit(padding), start)).first()[0] is safe


def test_trim_fails_closed(spark):
    rects = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 50.0, 12.0), (2, 2, 1, 0.0, 0.0, 50.0, 12.0), (3, 3, 1, 0.0, 0.0, 50.0, 12.0)], "rect_id int, doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    glyphs = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 10.0), (1, 1, 9.0, 8.0, 15.0, 20.0), (2, 1, 9.0, 8.0, 15.0, 20.0), (3, 1, 0.0, 0.0, 5.0, 10.0), (3, 1, 9.0, 1.0, 15.0, 30.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r.rect_id: (r.y0, r.y1) for r in geometry.trimmed(rects, glyphs).collect()} == {1: (0.0, 8.0), 2: (0.0, 12.0), 3: (0.0, 12.0)}


def test_span_status(spark):
    rect = "span_id int, doc_id int, page int, label string, x0 double, y0 double, x1 double, y1 double"
    rects = spark.createDataFrame([(1, 1, 1, "A", 0.0, 0.0, 1.0, 1.0), (2, 1, 1, "A", 0.0, 0.0, 1.0, 1.0), (3, 1, 1, "A", 5.0, 0.0, 6.0, 1.0)], rect)
    removed = rects.filter("span_id = 3")
    spans = spark.createDataFrame([(i, "A") for i in range(1, 5)], "span_id int, label string")
    got = geometry.span_status(spans, rects, geometry.resolved_rects(rects, removed), removed)
    assert {r.span_id: r.status for r in got.collect()} == {1: "applied", 2: "unmapped", 3: "removed", 4: "unmapped"}


def test_pending_overrides(spark):
    rect = "doc_id int, page int, label string, x0 double, y0 double, x1 double, y1 double"
    make = lambda *x: spark.createDataFrame([(1, 1, "A", float(v), 0.0, v + 1.0, 1.0) for v in x], rect)
    removed, added = geometry.apply_pending(make(1), make(7, 8), make(2, 7), make(1, 2, 3))
    assert sorted(r.x0 for r in removed.collect()) == [1, 2] and [r.x0 for r in added.collect()] == [8]


def test_classified_files(spark):
    names = ["a_ANON.txt", "a_ANON_12.txt", "_BATCH_SUMMARY_2.txt", "a_ANON_VISUAL.pdf", "notes.txt", "a_ANON_VISUAL.txt"]
    got = {r.name: (r.grp, r.generation) for r in review.classified(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {"a_ANON.txt": ("a|anon_txt", 1), "a_ANON_12.txt": ("a|anon_txt", 12), "_BATCH_SUMMARY_2.txt": ("batch_summary", 2), "a_ANON_VISUAL.pdf": ("a|visual", 1)}


def test_names_and_sizes(spark):
    row = spark.range(1).select(review.safe_name(F.lit("C:\\x\\y.txt")), review.safe_name(F.lit(" ")), review.size_text(F.lit(2_500_000)), review.size_text(F.lit(10)), writers.parsed_folder(F.lit("31.02.2024")), review.file_name_pii(F.lit("umowa_600111222.pdf"))).first()
    assert row[:5] == ("y.txt", "unknown", "2.4 MB", "1 KB", None) and row[5] == ["REGON", "numer telefonu"]


def test_sentences(spark):
    text = "Mieszka przy ul. Lipowej 3, m.in. tu. Kraków. Drugi\r\nTrzeci np. Jan? 12 lat! „Tak” tak"
    got = spark.range(1).select(model_review.sentences(F.lit(text))).first()[0]
    assert got == ["Mieszka przy ul. Lipowej 3, m.in. tu.", "Kraków.", "Drugi", "Trzeci np. Jan?", "12 lat!", "„Tak” tak"]


def test_narrative_answers(spark):
    item = '{"confidence": "likely", "category": "QUASI_IDENTIFIER_COMBINATION", "sentence_indices": %s}'
    answers = [(1, '{"suggestions": [' + item % "[1, 3]" + "]}"), (2, '{"suggestions": [' + item % "[1, 9]" + "]}"), (3, '{"suggestions": [' + item % "[]" + "]}"), (4, '{"suggestions": [' + item % "[true]" + "]}"), (5, "[1]"), (6, None)]
    rows = spark.createDataFrame(answers, "doc_id int, response string").withColumn("max_sentence", F.lit(3))
    got = {r.doc_id: (r.status, r.sentence_indices) for r in model_review.narrative_suggestions(rows).collect()}
    assert got == {1: ("completed", [1, 3]), 2: ("completed", None), 3: ("completed", None), 4: ("completed", None), 5: ("invalid_response", None), 6: ("invalid_response", None)}


def test_selected_text(spark):
    import hashlib

    want = hashlib.sha256(b"b").hexdigest()
    rows = spark.createDataFrame([(1, 0, "a", want), (1, 1, "\ufeffb", want), (2, 0, "a", want), (3, 0, " ", None), (3, 1, "c", None)], "doc_id int, ord int, text string, wanted string")
    assert {r.doc_id: r.text for r in model_review.selected_text(rows).collect()} == {1: "\ufeffb", 2: None, 3: "c"}


def test_chunks():
    text = ("słowo " * 500).strip()
    parts = list(retrieval.pieces(text))
    assert all(len(p) <= 1200 for p in parts) and parts[0].endswith("słowo") and len(parts) > 2
    assert list(retrieval.pieces(" \n ")) == [] and list(retrieval.pieces("x" * 1300)) == ["x" * 1200, "x" * 220]
    with pytest.raises(ValueError):
        list(retrieval.pieces("x", 50))


def test_answers(spark):
    questions = spark.createDataFrame([(1, "alfa beta"), (2, "nic")], "q_id int, question string")
    pieces = spark.createDataFrame([("a", 1, "Alfa beta gamma"), ("b", 1, "alfa"), ("c", 1, "")], "source_file string, chunk_index int, text string")
    found = retrieval.top_k(retrieval.token_index(pieces), questions, 2)
    got = {r.q_id: (r.status, r.sources) for r in retrieval.answers(questions, found).collect()}
    assert got == {1: ("generation_unavailable", ["b#1", "a#1"]), 2: ("no_relevant_context", [])}
    asked = retrieval.prompts(questions, found, pieces).collect()
    assert [r.q_id for r in asked] == [1] and "[b#1]\nalfa\n[a#1]\nAlfa beta gamma\nDATA_" in asked[0].prompt and asked[0].prompt.endswith("Question: alfa beta")


def test_policy_raises_on_unknown_tags(spark):
    assert spark.range(1).select(scoring.expectation(F.lit("case_reference")), scoring.expectation(F.lit("case_reference"), ("sygnatury",))).first()[:] == ("optional", "must")
    with pytest.raises(Exception, match="unknown policy tag"):
        spark.createDataFrame([("odd",)], "t string").select(scoring.expectation(F.col("t"))).collect()


def test_glyph_scores(spark):
    chars = spark.createDataFrame([(1, 1, 1, 0, "a", 0.0, 0.0, 8.0, 10.0), (1, 1, 1, 1, "b", 10.0, 0.0, 18.0, 10.0)], "doc_id int, span_id int, page int, i int, c string, x0 double, y0 double, x1 double, y1 double")
    fills = chars.filter("i = 0").select("doc_id", "page", "x0", "y0", "x1", "y1")
    glyphs = chars.select("doc_id", "page", "c", "x0", "y0", "x1", "y1")
    row = scoring.span_scores(scoring.char_status(chars, fills, glyphs)).first()
    assert (row.leaked, row.residue, row.status) == (2, 1, "full")


def test_checksums(spark):
    row = spark.range(1).select(scoring.pesel_valid(F.lit("44051401359")), scoring.pesel_valid(F.lit("44051401358")), scoring.nip_valid(F.lit("526-000-12-46")), scoring.regon_valid(F.lit("123456785")), scoring.iban_valid(F.lit("PL61 1090 1014 0000 0712 1981 2874")), scoring.iban_valid(F.lit("PL62 1090 1014 0000 0712 1981 2874")), scoring.pesel_valid(F.lit("x"))).first()
    assert row[:] == (True, False, True, True, True, False, False)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("zażółć".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.xyz").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('A')}<w:tbl><w:tr><w:tc>{p('C1')}</w:tc><w:tc>{p('C2')}</w:tc></w:tr></w:tbl>{p('')}{p('B')}</w:body></w:document>")
    (tmp_path / "d.DOCX").write_bytes(data.getvalue())
    got = {r.path[-6:]: (r.text, r.error_kind) for r in readers.files(spark, str(tmp_path)).collect()}
    assert got["/a.txt"] == ("zażółć", None) and got["/b.txt"] == (None, "decode") and got["/c.xyz"] == (None, "unsupported")
    assert got["d.DOCX"] == ("A\nB\nC1\nC2", None) and got["/e.pdf"][1] in ("dependency", "processing")
    plain = {r.path[-5:]: r.error_kind for r in readers.text_files(spark, str(tmp_path / "*.txt")).collect()}
    assert plain == {"a.txt": None, "b.txt": "decode"}


def test_index_round_trip(spark, tmp_path):
    (tmp_path / "x_ANON.txt").write_bytes("\ufeffJan".encode())
    docs = readers.approved(spark, str(tmp_path))
    assert docs.first()[:] == ("x_ANON.txt", "Jan")
    writers.knowledge_index(retrieval.chunks(docs), str(tmp_path / "i"))
    assert readers.knowledge_index(spark, str(tmp_path / "i")).first().chunk_id == "x_ANON.txt#1"
    spark.createDataFrame([("../x", "a", 1, "t")], "source_file string, chunk_id string, chunk_index int, text string").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="malformed chunk"):
        readers.knowledge_index(spark, str(tmp_path / "bad")).collect()


def test_export_and_manifest(spark):
    items = spark.createDataFrame([("w", "a", "r", "ok", "approved"), ("w", "b", None, "ok", "approved"), ("w", "c", None, "ok", "rejected")], "workspace string, output_name string, report_name string, risk_level string, status string")
    texts = spark.createDataFrame([(x, x) for x in "abc"], "output_name string, text string")
    kept, missing = writers.approved_export(items, texts)
    assert sorted(r.output_name for r in kept.collect()) == ["a", "b"] and [r.output_name for r in missing.collect()] == ["b"]
    assert '"item_count":3' in writers.manifest(items).first().json


def test_rollup_statuses(spark):
    row = spark.range(1).select(rollup.upgraded_status(F.lit("completed"), F.lit(True)), rollup.error_text(F.lit("odd")), geometry.redaction_status(F.lit(0), F.lit(0)), rollup.error_text(F.lit(None).cast("string"))).first()
    assert row[:] == ("completed_with_warnings", "file processing failed", "no_matches", None)


def test_inbox_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("PESEL 12345678901, a@b.pl")
    query = inbox.label_totals(inbox.texts(spark, str(tmp_path / "in")), 2026).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    assert {r.label: r.n for r in spark.table("totals").collect()} == {"PESEL": 1, "EMAIL": 1}
