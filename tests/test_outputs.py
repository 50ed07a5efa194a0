"""Reports, checklists, workspaces, binary outputs, model calls, entity masking, command line."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from redactica import cli
from redactica.operators import cascade, model_review, ner, reports, review
from redactica.sources import binary, readers

W = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"


def docx(*paragraphs):
    data = io.BytesIO()
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in p) + "</w:p>" for p in paragraphs)
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("other.xml", "<a/>")
    return data.getvalue()


def test_masked_docx(spark):
    mask = lambda t: cascade.substitute(t, 2026)
    data, counters = binary.masked_docx(docx(["PESEL ", "12345678901"], ["123456", "78901 x"], ["plain"]), mask)
    assert readers.docx_text(data) == "PESEL [PESEL]\n[PESEL] x\nplain" and counters == {"PESEL": 2}
    assert zipfile.ZipFile(io.BytesIO(data)).read("other.xml") == b"<a/>"
    files = spark.createDataFrame([("a", docx(["a@b.pl"])), ("b", b"no zip")], "path string, content binary")
    got = {r.path: r for r in binary.masked_docx_files(files, mask).collect()}
    assert readers.docx_text(bytes(got["a"].content)) == "[EMAIL]" and got["b"].error_kind == "processing" and got["a"].counters == {"EMAIL": 1}


def test_pdf_is_optional():
    assert binary.page_count(b"no pdf") is None


def test_report_reads_back(spark):
    rows = spark.createDataFrame([({"ZZZ": 2, "NIP": 1, "PESEL": 3}, {"EMAIL": 1})], "c map<string,bigint>, f map<string,bigint>")
    text = rows.select(reports.report(F.lit("completed"), F.lit("txt"), F.col("c"), F.lit("high_risk"), F.col("f")).alias("t"))
    t = text.first().t
    assert t.index("* PESEL: 3") < t.index("* NIP: 1") < t.index("* ZZZ: 2")
    risk, found = review.parsed_report(F.col("t"))
    assert text.select(risk, found).first()[:] == ("high_risk", ["PESEL: 3", "NIP: 1", "ZZZ: 2", "EMAIL: 1"])
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([({"NIP": -1},)], "c map<string,bigint>").select(reports.counter_lines(F.col("c"))).collect()
    assert spark.createDataFrame([({},)], "c map<string,bigint>").select(reports.counter_lines(F.col("c"))).first()[0] == "* none: 0"


def test_manual_note(spark):
    note = lambda text, n: spark.range(1).select(reports.with_manual_note(F.lit(text), F.lit(n))).first()[0]
    once = note("Report\n", 2)
    assert "hidden by hand: 2" in once and note(once, 0) == "Report\n" and note(once, 3).count("by hand") == 1 and note(note(once, 3), 2) == once


def test_batch_and_checklist(spark):
    files = spark.createDataFrame([("x", 0, "C:\\a.txt", None, "ok", 1), ("x", 1, "b.pdf", "file processing failed", None, 0)], "batch string, position int, name string, error string, risk_level string, masked int")
    assert reports.batch_report(files).first().text == "Files: 2\nDone: 1\nFailed: 1\n* a.txt: ok, risk ok, masked 1\n* b.pdf: error, file processing failed"
    docs = spark.createDataFrame([(1, "x [EMAIL]\n[PESEL]", {"EMAIL": 1}, {"LONG_NUMBER_SEQUENCE": 1}, True), (2, "", {}, {}, False)], "doc_id int, text string, counters map<string,bigint>, findings map<string,bigint>, is_pdf boolean")
    got = {r.doc_id: r.text for r in reports.checklist(docs).collect()}
    assert got[1] == "Review\n[ ] contacts\n[ ] audit: LONG_NUMBER_SEQUENCE\n[ ] text_order\n[EMAIL] line 1\n[PESEL] line 2" and got[2] == "Review\n[ ] output_and_report"


def test_workspace(spark):
    listing = spark.createDataFrame([("f", "txt", "a_ANON.txt"), ("f", "", "a_ANON.txt"), ("f", "", "b_ANON_2.docx"), ("f", "", "notes.txt")], "folder string, sub string, name string")
    written = spark.createDataFrame([("f", "a_RAPORT.txt", "x\nRisk level: warning\n"), ("f", "b_RAPORT_7.txt", "x"), ("f", "b_RAPORT_8.txt", "x")], "folder string, name string, text string")
    got = {r.output_name: (r.report_name, r.risk_level) for r in review.workspace(listing, written).collect()}
    assert got == {"a_ANON.txt": ("a_RAPORT.txt", "warning"), "b_ANON_2.docx": (None, None)}
    folders = spark.createDataFrame([("r", "22.09.2026"), ("r", "05.10.2026"), ("r", "31.02.2027"), ("r", "x")], "root string, folder string")
    assert review.newest_folder(folders).first().folder == "05.10.2026"


def test_entities_masked(spark):
    docs = spark.createDataFrame([(1, "Jan Nowak w Acme"), (2, "x")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, 9, "NER_PERSON", None), (1, 12, 16, "NER_ORG", None), (1, 10, 11, "NER_MISC", "ORDINARY_WORD")], "doc_id long, start int, end int, label string, exclusion string")
    got = {r.doc_id: r for r in ner.masked(docs, found, ("NER_PERSON",)).collect()}
    assert got[1].masked == "[NER_PERSON] w Acme" and got[1].redacted["NER_ORG"] == 0 and got[1].detected["NER_ORG"] == 1 and got[2].masked == "x"
    meta = ner.metadata("odd", found).first()
    assert meta.status == "unavailable" and meta.counters == {"NER_PERSON": 1, "NER_ORG": 1, "NER_LOCATION": 0, "NER_MISC": 0} and meta.exclusions["ORDINARY_WORD"] == 1


def test_model_calls(spark):
    docs = spark.createDataFrame([(1, "Jeden. Dwa.", "Jeden. [X]."), (2, "z", "z")], "doc_id long, text string, masked string")
    rows = model_review.prompts(docs, "text", "masked")
    r = rows.filter("doc_id = 1").first()
    assert r.prompt.count(r.fence) == 2 and "S2: Dwa." in r.prompt and r.max_sentence == 2
    assert {x.status for x in model_review.asked(rows, "comparison").collect()} == {"disabled"}

    def client(prompt, schema):
        if "S2" not in prompt:
            raise TimeoutError
        return '{"findings": [{"finding_type": "missed_redaction", "category": "PERSON_LIKE", "sentence_index": 2}]}'

    got = model_review.asked(rows, "comparison", client)
    assert {x.doc_id: x.status for x in got.collect()} == {1: "completed", 2: "timeout"}
    assert model_review.comparison_findings(got.filter("status = 'completed'")).first().sentence_index == 2


def test_command_line(spark, tmp_path, capfd, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_ANON.txt").write_text("PESEL 12345678901 alfa")
    assert cli.main(["mask", f"{tmp_path}/in", f"{tmp_path}/out"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/out").first().masked == "PESEL [PESEL] alfa"
    assert cli.main(["build-index", f"{tmp_path}/in", f"{tmp_path}/index"], spark) == 0
    assert cli.main(["ask", f"{tmp_path}/index", "alfa"], spark) == 0 and cli.main(["audit", f"{tmp_path}/in"], spark) == 0
    assert "No answer: generation_unavailable" in capfd.readouterr().out
    (tmp_path / "some_model.py").write_text("def say(prompt, schema):\n    return 'Yes.'\ndef slow(prompt, schema):\n    raise TimeoutError(prompt)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    for args in (["ask", f"{tmp_path}/index", "alfa", "--client", "some_model:say"], ["ask", f"{tmp_path}/index", "zzz", "--client", "some_model:say"], ["ask", f"{tmp_path}/index", "alfa", "--client", "some_model:slow"], ["model-status"], ["model-status", "--client", "some_model:say"], ["model-status", "--client", "some_model:none"]):
        assert cli.main(args, spark) == 0
    said = capfd.readouterr().out
    assert "Yes.\nSources:" in said and "No answer: no_relevant_context" in said and "No answer: timeout" in said and said.endswith("disabled\navailable\nprocessing_error\n")


def test_masked_files_have_free_names(spark, tmp_path):
    from redactica.sources import writers

    listing = spark.createDataFrame([("f", "a_ANON.txt"), ("f", "a_ANON_99999999999999999999.txt"), ("f", "a_RAPORT_2.txt")], "folder string, name string")
    rows = [("f", "a", "txt", "zażółć", None, 1), ("f", "a", "pdf", "x", None, 2), ("f", "b", "txt", "", None, 3), ("f", "c", "docx", None, b"PK", 4), ("f", "d", "txt", None, None, 5)]
    docs = spark.createDataFrame(rows, "folder string, stem string, ext string, text string, content binary, doc_id long")
    written = {r.name: r.size for r in writers.masked_files(docs, listing, f"file://{tmp_path}/out").collect()}
    assert written == {"txt/a_ANON_3.txt": 1, "txt/a_ANON_4.txt": 10, "txt/b_ANON.txt": 0, "c_ANON.docx": 2}  # the report has the second number
    assert (tmp_path / "out/txt/a_ANON_4.txt").read_text() == "zażółć" and (tmp_path / "out/c_ANON.docx").read_bytes() == b"PK"
    assert sorted(p.name for p in (tmp_path / "out/txt").iterdir()) == ["a_ANON_3.txt", "a_ANON_4.txt", "b_ANON.txt"]


def test_scalar_function(spark):
    mask = cascade.register(spark, 2026, "mask_here")
    rows = spark.createDataFrame([("PESEL 12345678901",), (None,)], "t string")
    assert [r[0] for r in rows.select(mask("t")).collect()] == [r[0] for r in rows.selectExpr("mask_here(t)").collect()] == ["PESEL [PESEL]", None]
