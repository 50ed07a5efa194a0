"""Folders, batch texts in parts, invented documents, exports, and the client of a local model."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from redactica import cli
from redactica.operators import reports, rollup, scoring, synthetic
from redactica.sources import folder, local_model, named, writers


def test_folder_is_cut_by_bytes_and_filtered_before_it_is_read(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"s{k % 4}").mkdir(exist_ok=True)
        (tmp_path / f"s{k % 4}" / f"f{k}.{['txt', 'TXT', 'xyz', 'txt'][k % 4]}").write_bytes(b"x" * k if k % 8 else b"\xff")
    rows = folder.files(spark, f"file://{tmp_path}", part_bytes=folder.FILE_BYTES * 10)
    assert rows.rdd.getNumPartitions() >= 4 and rows.count() == 40
    got = {r.path: (r.ext, r.text, r.error_kind, r.size) for r in rows.collect()}
    assert got["s0/f8.txt"] == ("txt", None, "decode", 1) and got["s1/f9.TXT"] == ("txt", "x" * 9, None, 9) and got["s2/f2.xyz"] == ("xyz", None, "unsupported", 2)
    one = rows.filter((F.col("ext") == "txt") & F.col("path").startswith("s3/"))
    assert one.rdd.getNumPartitions() <= 2 and one.count() == 10
    assert rows.filter(F.col("path").endswith("f9.TXT")).count() == rows.filter(F.col("path") == "s1/f9.TXT").count() == 1
    assert rows.filter(F.col("ext").isin("xyz", "pdf")).count() == 10 and rows.filter(F.col("path").contains("/f1")).count() == 11
    reader = folder.DocumentReader(f"file://{tmp_path}", 1 << 20)
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    assert len(list(reader.pushFilters([EqualTo(("ext",), "txt"), StringStartsWith(("path",), "s3/")]))) == 2
    assert sum(len(p.files) for p in reader.partitions()) == 10
    (tmp_path / "none").mkdir()
    assert folder.files(spark, f"file://{tmp_path}/none").count() == 0


def test_batch_texts_in_parts_make_up_the_whole(spark):
    files = spark.range(500).select((F.col("id") % 3).alias("batch"), F.col("id").alias("position"), F.concat(F.lit("d/f"), "id").alias("name"), F.when(F.col("id") % 7 == 0, "bad").alias("error"), F.when(F.col("id") % 2 == 0, "ok").otherwise("high_risk").alias("risk_level"), F.lit(1).alias("masked"))
    for make in (reports.batch_report, reports.batch_checklist):
        parts, whole = make(files, 300).collect(), {r.batch: r.text for r in make(files).collect()}
        for b in range(3):
            own = sorted((r.part, r.text) for r in parts if r.batch == b)
            assert [p for p, _ in own] == list(range(len(own))) and len(own) > 5
            assert "\n".join(t for _, t in own) == whole[b] and max(len(t) for _, t in own) < 450
    assert whole[0].startswith("Review: ") and whole[0].index("high_risk") < whole[0].index("(risk: ok)")
    assert [r.place for r in rollup.batch_files(files).filter("batch = 1").orderBy("position").collect()] == list(range(1, 168))


def test_invented_documents(spark):
    made = synthetic.corpus(spark.range(26).select(F.col("id").alias("n")))
    again = synthetic.corpus(spark.range(26).repartition(5).select(F.col("id").alias("n")))
    texts = {r.doc_id: r.text for r in synthetic.documents(made).collect()}
    assert texts == {r.doc_id: r.text for r in synthetic.documents(again).collect()} and len(set(texts.values())) == 26
    keys = synthetic.keys(made).collect()
    assert {k.kind for k in keys} == set(synthetic.VALUES) and {k.doc_kind for k in keys} == set(synthetic.KINDS)
    chars = {}
    for r in synthetic.key_chars(synthetic.keys(made)).orderBy("i").collect():
        chars[r.span_id] = chars.get(r.span_id, "") + r.c
    assert all(chars[k.span_id] == k.text[k.s : k.e].replace(" ", "") for k in keys)
    assert all(texts[k.doc_id].split("\n\f\n")[k.page - 1] == k.text for k in keys)
    words = synthetic.words(made)
    fills = words.filter("length(text) > 0").select("doc_id", "page", "x0", "y0", "x1", "y1")
    status = scoring.span_scores(scoring.char_status(synthetic.key_chars(synthetic.keys(made)), fills))
    assert {r.status for r in status.collect()} == {"covered"}  # every character of a key lies in the box of its word


def test_approved_export_reads_back(spark, tmp_path):
    items = spark.createDataFrame([("w", "a_ANON.txt", "a_RAPORT.txt", "a_ANON_VISUAL.pdf", "approved", "ok"), ("w", "b_ANON.txt", None, "b_ANON.txt", "approved", None), ("w", "c_ANON.txt", None, "c_ANON.txt", "rejected", "ok"), ("v", "d_ANON.txt", None, "d_ANON.txt", "approved", "ok")], "workspace string, output_name string, report_name string, artefact string, status string, risk_level string")
    files = spark.createDataFrame([("w", n, n.encode()) for n in ("a_ANON.txt", "a_RAPORT.txt", "a_ANON_VISUAL.pdf", "b_ANON.txt", "c_ANON.txt", "secret.docx")], "workspace string, name string, content binary")
    copied, index = writers.approved_batch(items, files)
    named.write(copied.filter("workspace = 'w'").select("name", "content"), f"file://{tmp_path}")
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()} == {"txt/a_ANON.txt", "txt/a_RAPORT.txt", "a_ANON_VISUAL.pdf", "txt/b_ANON.txt"}
    said = {r.workspace: r.text.split("\n") for r in index.collect()}
    assert said["w"][:4] == ["Approved files", "Files: 2", "Reports: 1", "Missing reports: 1"] and said["w"][said["w"].index("Without a report:") + 1] == "* b_ANON.txt"
    assert "Files: 0" in said["v"] and said["v"].count("* none") == 3 and "secret" not in str(said)


@pytest.mark.parametrize(("url", "local"), [("http://localhost:1", True), ("http://127.0.0.1:11434", True), ("http://127.9.9.9/x", True), ("http://[::1]:80", True), ("https://localhost", False), ("http://192.168.0.1", False), ("http://localhost.example.com", False), ("http://user:pw@localhost", False), ("http://127.0.0.1@example.com", False), ("file:///etc", False), ("http://", False), ("http://localhost:bad", False), ("", False)])
def test_only_this_machine_is_asked(url, local):
    assert local_model.is_local(url) == local
    if not local:
        with pytest.raises(ValueError):
            local_model.LocalModel("m", url)


def test_local_model(capfd):
    seen = []

    class Service(BaseHTTPRequestHandler):
        def _say(self, body, code=200):
            self.send_response(code)
            if code == 302:
                self.send_header("Location", "http://example.com/")
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self._say(json.dumps({"models": [{"name": "small:latest"}, {"name": "m"}]}).encode())

        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self._say(b"", 302) if seen[-1]["prompt"] == "away" else self._say(json.dumps({"response": seen[-1]["prompt"] + "!"}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    model = local_model.LocalModel("small", url)
    assert model("hi", {"type": "object"}) == "hi!" and seen[0]["format"] == {"type": "object"} and model.status() == "available"
    assert local_model.LocalModel("other", url).status() == "model_missing" and local_model.LocalModel("", url).status() == "no_model_configured"
    with pytest.raises(ConnectionError):
        model("away", {})
    assert cli.main(["warm-up", "m", "--url", url]) == 0 and capfd.readouterr().out == "available\n"
    server.shutdown()
    server.server_close()
    assert model.warm_up() == "service_unavailable"
