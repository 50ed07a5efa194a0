"""Free names, batches of named files, and sums along an order."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from redactica.functions.ranks import running
from redactica.operators import cascade, detect
from redactica.sources import named, writers


def test_no_name_is_taken_twice_and_nothing_is_overwritten(spark, tmp_path):
    out = tmp_path / "out" / "txt"
    out.mkdir(parents=True)
    (out / "a_ANON_2.txt").write_text("kept")
    listing = spark.createDataFrame([("f", "a_ANON_2.txt")], "folder string, name string")
    docs = spark.createDataFrame([("f", "a", "txt", "one", None, 1), ("f", "a", "pdf", "two", None, 2), (None, "a", "pdf", "three", None, 3)], "folder string, stem string, ext string, text string, content binary, doc_id long")
    names = {r.doc_id: r.name for r in writers.masked_names(docs, listing).collect()}
    assert names == {2: "txt/a_ANON.txt", 1: "txt/a_ANON_3.txt", 3: "txt/a_ANON.txt"}
    writers.masked_files(docs.filter("folder = 'f'"), listing, f"file://{tmp_path}/out")
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a_ANON_2.txt": "kept", "a_ANON.txt": "two", "a_ANON_3.txt": "one"}


def test_numbers_are_drawn_from_the_gaps(spark):
    rng = random.Random(4)
    taken = {(f, s, n) for f in "xy" for s in "ab" for n in rng.sample(range(1, 30), rng.randint(0, 12))}
    listing = spark.createDataFrame([(f, f"{s}_ANON{'' if n == 1 else f'_{n}'}.txt") for f, s, n in taken] + [("x", "other.txt")], "folder string, name string")
    docs = [(rng.choice("xyz"), rng.choice("abc"), "txt", i) for i in range(150)]
    got = writers.masked_names(spark.createDataFrame(docs, "folder string, stem string, ext string, doc_id long"), listing).collect()
    for f, s in {d[:2] for d in docs}:
        own = sorted(d[3] for d in docs if d[:2] == (f, s))
        free = (n for n in range(1, 1000) if (f, s, n) not in taken)
        assert [r.number for r in sorted(got, key=lambda r: r.doc_id) if (r.folder, r.stem) == (f, s)] == [next(free) for _ in own]


def _files(folder: Path) -> dict:
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_a_failed_task_leaves_no_part_of_a_batch(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.range(200).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.encode(F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise("x"), "UTF-8").alias("content"))
    with pytest.raises(Exception, match="broken"):
        named.write(rows.repartition(4), folder)
    assert _files(tmp_path) == {}
    written = named.write(rows.filter("id < 150").repartition(4), folder)
    assert len(_files(tmp_path)) == 150 and {r.size for r in written.collect()} == {1}


def test_a_taken_name_takes_the_batch_back(spark, tmp_path):
    (tmp_path / "b").write_bytes(b"old")
    for rows in ([("a", b"1"), ("b", b"2"), ("c", b"3")], [("d", b"1"), ("d", b"2")]):
        with pytest.raises(Exception, match="taken"):
            named.write(spark.createDataFrame(rows, "name string, content binary"), f"file://{tmp_path}")
        assert _files(tmp_path) == {"b": b"old"}
    for name in ("../x", "a/b/c", "_staging-1", None, "a\\b"):
        with pytest.raises(Exception, match="a name is that of a file"):
            named.write(spark.createDataFrame([(name, b"1")], "name string, content binary"), f"file://{tmp_path}")
    assert _files(tmp_path) == {"b": b"old"}


def test_a_batch_that_was_cut_short_is_finished(tmp_path):
    stage = tmp_path / "_staging-1"
    stage.mkdir()
    (tmp_path / "_staging-2").mkdir()
    for k in (1, 2):
        (stage / f"m{k}").write_bytes(b"x")
    (stage / "list-1").write_text("".join(f'["{stage}/m{k}", "{tmp_path}/s/f{k}"]\n' for k in (1, 2, 3)))
    (stage / "whole").write_text(f"{stage}/list-1")
    assert named.recover(f"file://{tmp_path}") == 2 and _files(tmp_path) == {"s/f1": b"x", "s/f2": b"x"}
    assert named.recover(f"file://{tmp_path}/none") == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_along_an_order(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(parts)
    got = {(r.g, r.i): r.before for r in running(df, ["g"], [F.desc("i")], "before", F.col("n")).collect()}
    assert got == {(g, i): sum(n for h, j, n in rows if h == g and j > i) for g, i, _ in rows}
    assert sorted(r.k for r in running(df, [], ["i"], "k").collect()) == list(range(400))
    assert running(df.limit(0), ["g"], ["i"], "k").count() == 0


def test_both_forms_of_kept_dates_agree(spark):
    rng = random.Random(9)
    parts = ["Ustawa", "ustawy", "kodeksu", "Dyrektywa", ". ", "? Z", "! ", "; ", "z dnia ", "Z  dnia ", "z\ndnia ", "x ", " Nowa ", "Ł", "ab. cd ", "dnia ", "konwencją", " " * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) + rng.choice(["", "z dnia ", " Z dnia "]) + rng.choice(["3 maja 2004", "12.03.2004", "3 maja 1804"]) for _ in range(1500)] + ["Ustawa. Z dnia 3 maja 2004 r."]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in docs.select("id", detect.label_spans(F.col("t"), "DATA", 2026).alias("s")).collect():
        assert [(x.s, x.e) for x in r.s] == [x[:2] for x in cascade.by_pattern("DATA", 2026)(texts[r.id])], texts[r.id]
    assert list(cascade.by_pattern("DATA", 2026)(texts[-1])) == []
