"""The pipeline's stages one by one, and the guard that lets the rest live without this subpackage."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in ("ara", "ono", "ile", "usu") for c in ("", "n", "ta")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, passage = prose(40), prose(60)
    docs = [(i, prose(rng.randint(30, 200))) for i in range(200)]
    for i in range(0, 200, 6):
        w = docs[i][1].split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "nasty"]))
        docs[i] = (i, " ".join(w))
    docs += [(300, docs[1][1]), (301, docs[1][1]), (302, item), (303, prose(30) + " " + passage + " " + prose(30)), (304, prose(30) + " " + passage + " " + prose(30)), (305, None), (306, ""), (None, prose(40))]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), passage


def test_stages(spark, tables):
    path, passage = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "decontamination", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen.append({r.doc_id: r for r in docs.collect()})
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    toxic, near, cut, clean, packed = seen
    assert not any(i in toxic for i in range(0, 200, 6)) and {1, 2, 302, 305, 306, None} <= set(toxic)
    assert 1 in near and 300 not in near and 301 not in near and len(near) >= len(toxic) - 3
    assert passage in cut[303].text and passage not in cut[304].text and cut[304].n_chars == len(cut[304].text) and cut[305].text is None
    assert 302 in cut and 302 not in clean and set(clean) == set(cut) - {302}
    assert set(packed) == set(clean)


def test_run_equals_brute_force_stage_by_stage(spark, tables):
    """All but the toxicity score, which its own tests hold against labels, by plain loops over the whole fixture."""
    from test_ops import brute_components, brute_decontaminate, brute_fingerprint, brute_substring, checked_packing

    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, docs, path).collect()]
    last = 1 << 40  # a row without an id comes after all others
    fps = {d: brute_fingerprint(t) for d, t in rows if d is not None}
    named = brute_components(fps)
    rows = [(last if d is None else d, t) for d, t in rows if (brute_fingerprint(t) not in fps.values() if d is None else named[d] == d)]
    texts = dict(rows)
    cut = [(d, left if gone else texts[d]) for d, _, gone, left in brute_substring(rows)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    clean = {d for d, words, hit, _ in brute_decontaminate(cut, items) if not (hit and 20 * hit >= words)}
    want = [(None if d == last else d, t) for d, t in cut if d in clean]
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == {d for d, _ in want} and len(want) < len(cut) < docs.count()
    checked_packing(got, want, 2048)


def test_run_and_empty(spark, tables, tmp_path):
    path, _ = tables
    assert corpus_pipeline.run(spark, path).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_stay_whole(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    twice = docs.unionByName(docs.filter("doc_id = 2"))
    assert corpus_pipeline.drop_toxic(spark, twice, path).filter("doc_id = 2").count() == 2
    assert corpus_pipeline.drop_contaminated(spark, twice, path).filter("doc_id = 2").count() == 2
    assert corpus_pipeline.cut_substrings(spark, twice, path).filter("doc_id = 2").count() == 2


def test_near_duplicates_are_judged_row_by_row(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "quite another text altogether here " * 9)
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in [(1, a), (1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, a.upper()), (9, None), (10, ""), (9, "  ")]], DOCS + ", component_id string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == corpus_pipeline.COLUMNS
    got = sorted(((r.doc_id or 0, r.text) for r in left.collect()), key=str)
    wordless = [x for x in got if not (x[1] or "").strip()]
    assert [x for x in got if x not in wordless] == sorted([(0, c), (0, c), (1, a), (1, a), (5, b)], key=str) and [i for i, _ in wordless] == [9]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_of_a_stage(spark, tables, name):
    path, _ = tables
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = [(1, None), (2, ""), (3, "word " * 30_000), (3, "other text of that id " * 3), (4, "tie tie"), (4, "tie tie"), (None, None), (None, "no id " + "x y z " * 9)]
    docs = spark.createDataFrame([(i, t, None, None, None, "score", "item", 1) for i, t in odd], DOCS + ", score string, item_ids string, _0 int")
    rows = stage(spark, docs, path).collect()
    if name == "packing":
        assert {(r.doc_id, r.piece) for r in rows} >= {(1, 0), (2, 0), (3, 0), (3, 14), (4, 0), (None, 0)}
    elif name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "3", "3", "4", "4", "None"])
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in odd)
        assert {r.text for r in rows if r.doc_id == 4} == {"tie tie"} and all(tuple(r.asDict()) == tuple(corpus_pipeline.COLUMNS) for r in rows)
    assert stage(spark, docs.limit(0), path).count() == 0


def test_rest_works_without_this_subpackage(tmp_path):
    code = "import sys; sys.modules['redactica.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert 'cascade_masked' in n and not any(k.startswith('op') for k in n); print(len(n))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 60
