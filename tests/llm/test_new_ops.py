"""Blob ledger, spelling variants and Merkle manifest against brute force, and their defined results for odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from redactica.llm import ledger, merkle, spelling

RNG = random.Random(5)


def frame(spark, rows, schema="doc_id long, text string, blob string, own string, spans string, word string, n string, g string, digest string, pid string"):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g", "h") for r in rows], schema)


# --- secrets --------------------------------------------------------------------------------------------------------------------

SECRET = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in SECRET.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def secret_text(rng):
    parts = ["password=", "PassWord = 'abc", "secret : ", "token\"=", "api_key=", "ApiKey:abcdefgh", "AKIA", "ABCDEFGH0123", "deadbeef" * 3, "0123456789abcdef", " ", "\n", "é", "😀", "==", "abcdefgh", "x", "https://", "me:pw@", "-----BEGIN RSA PRIVATE KEY-----", "passſwd=abcdefghi"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


ODD_SECRETS = [(1, None), (2, ""), (3, "token=abc token=abcdefgh"), (4, "secret=token:abcdefgh"), (5, "x" * 200_000 + " password=hunter2hunter2"), (5, "x"), (None, "AKIA" + "Z" * 20), (None, "AKIA" + "Z" * 20), (6, "a1" * 40), (7, "password=abcdefgh " * 700)]


def test_ledger_brute_force(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, secret_text(rng)) for i in range(300)] + ODD_SECRETS + [(1000 + i, "token=copycopycopy") for i in range(80)]
    rows = ledger.scan(frame(spark, docs), str(tmp_path / "ledger")).collect()
    got = sorted(((r.path is None, r.path or 0), [(f.rule, f.start, f.end) for f in r.spans if f.rule in ledger.BASE]) for r in rows)
    assert got == sorted(((d is None, d or 0), brute_spans(t)) for d, t in docs)
    kept = spark.read.parquet(str(tmp_path / "ledger"))
    assert kept.count() == kept.select("blob").distinct().count() == len({t or "" for _, t in docs})


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = frame(spark, [(1, "token=abcdefgh1"), (2, "nothing"), (3, "token=abcdefgh1")])
    first = ledger.scan(one, path).collect()
    assert sorted(len(r.spans) for r in first) == [0, 1, 1] and spark.read.parquet(path).count() == 2
    more = frame(spark, [(1, "token=abcdefgh1"), (1, "a later version token=zzzzzzzz9"), (4, "nothing")])
    again = {(r.path, r.spans[0].start if r.spans else None) for r in ledger.scan(more, path).collect()}
    assert again == {(1, 0), (1, 16), (4, None)} and spark.read.parquet(path).count() == 3
    newer = ledger.RULES | {"access": ledger.Rule("nothing", "nothing", version=2)}
    todo = ledger.pending(more.select(ledger.blob(F.col("text")).alias("blob"), F.xxhash64("doc_id").alias("own")), path, newer).collect()
    assert {tuple(r.missing) for r in todo} == {("access@2",)} and len(todo) == 3
    spans = {r.path: [(f.rule, f.start) for f in r.spans] for r in ledger.scan(more, path, newer).collect() if r.path == 4}
    assert spans == {4: [("access", 0)]}
    assert [len(r.spans) for r in ledger.scan(more.filter("doc_id = 4"), path).collect()] == [0]  # findings of another version do not count


def test_ledger_ways_agree_and_empty(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    docs = frame(spark, [(i % 40, secret_text(rng)) for i in range(120)])
    want = sorted(map(str, ledger.scan(docs, str(tmp_path / "a")).collect()))
    monkeypatch.setattr(ledger, "FEW", 1)
    assert sorted(map(str, ledger.scan(docs, str(tmp_path / "b")).collect())) == want
    assert ledger.scan(docs.limit(0), str(tmp_path / "c")).count() == 0 and not (tmp_path / "c").exists()


def test_ledger_plan_has_no_python(spark, tmp_path):
    out = ledger.scan(frame(spark, ODD_SECRETS), str(tmp_path / "ledger"))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


# --- spelling -------------------------------------------------------------------------------------------------------------------


def brute_near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_variants(words, times=10):
    out = {}
    for w, n in words.items():
        near = [v for v in words if brute_near(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= times * n else None
        out[w] = (n, len(near), form, words.get(form))
    full = {}
    for w in out:
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        full[w] = (*out[w], at)
    return full


def word_table(seed, alphabet="abé", n=350, sizes=(7, 12)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :]]))
    return {w: rng.choice([2, 3, 25, 400, 5000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize(("alphabet", "held"), [("abé", 100_000), ("a", 100_000), ("ab", 12), ("abcdefghij", 5), ("thionsed", 40)])
def test_variants_brute_force(spark, alphabet, held):
    words = word_table(len(alphabet) + held, alphabet)
    df = spark.createDataFrame([(w, n, "x", "y", 1) for w, n in words.items()], "word string, n long, near string, key string, form int")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, held_most=held).collect()}
    assert got == brute_variants(words)


def test_variants_of_a_common_beginning(spark):
    """Very many words under one key: it is taken apart, round by round."""
    words = {f"commonbeginning{a}{b}{c}": 2 + (a == b == c) * 50 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, held_most=30).collect()}
    assert got == brute_variants(words)


def test_variants_odd(spark):
    long = "a" * 30_000
    words = {long: 2, long + "b": 40, "b" + long + "b": 900, "ßtraßen": 3, "ÿÿÿÿÿÿÿ": 2, "ÿÿÿÿÿÿÿÿ": 2, "àèìòùáé": 2}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == brute_variants(words) and got[long][4] == "b" + long + "b"
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0
    with pytest.raises(ValueError):
        spelling.counted(none, least=3)


def test_words_of_documents(spark):
    docs = [(1, None), (2, ""), (None, "ABCDEFGH abcdefgh"), (3, "abc defghij1klmnopq klmnopq×r"), (3, "x" * 50_000), (4, "x" * 50_000), (4, "Éàéabcd")]
    got = {r.word: r.n for r in spelling.counted(spelling.runs(frame(spark, docs)).select(F.col("run").alias("word")), often=1).collect()}
    assert got == {"abcdefgh": 2, "defghij": 1, "klmnopq": 1, "klmnopq×r": 1, "x" * 50_000: 2, "Éàéabcd": 1}
    assert spelling.runs(frame(spark, docs).limit(0)).count() == 0


# --- Merkle ---------------------------------------------------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_tree(leaves):
    """(root, siblings of each leaf from the bottom up)."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            proofs[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], proofs


def brute_manifest(rows):
    groups = defaultdict(list)
    for g, o, d in rows:
        groups[g].append((o is not None, o or 0, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([d for *_, d in sorted(groups[g])]) for g in names]
    root, tops = brute_tree([t[0] for t in trees])
    return sorted((("-" if g is None else g, o if has else -1, d, t[0], root, p + top) for g, t, top in zip(names, trees, tops, strict=True) for (has, o, d), p in zip(sorted(groups[g]), t[1], strict=True)), key=str)


@pytest.mark.parametrize(("sizes", "each"), [({"en": 700, "de": 1, None: 65, "": 8, "zz": 64}, 50), ({"en": 9}, 1), ({f"l{i}": 1 + i % 3 for i in range(90)}, 7), ({"a": 513, "b": 512}, 3), ({"a": 1}, 10), ({"x": 8, None: 8}, 100)])
def test_manifest_brute_force(spark, sizes, each):
    rng = random.Random(each)
    rows = [(g, rng.choice([None, i, i // 2, 7]), sha(f"{g}{i // 3}")) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "lang string, doc_id long, leaf string, g string, pid string, root int")
    got = merkle.manifest(df, leaves_each=each).collect()
    shown = sorted(((r.lang if r.lang is not None else "-", -1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.proof]) for r in got), key=str)
    assert shown == brute_manifest(rows)


def test_manifest_of_one_hot_row(spark):
    """A third of all rows are the same row; no partition holds them all, and every proof holds."""
    df = spark.createDataFrame([("en", 1, sha("same"))] * 400 + [("en", i, sha(str(i))) for i in range(800)], "lang string, doc_id long, leaf string")
    out = merkle.manifest(df, leaves_each=40).withColumn("up", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(out) == 1200 and all(r.up == r.root for r in out) and len({r.root for r in out}) == 1
    assert merkle.manifest(df.limit(0)).count() == 0


def test_leaf_of_nulls_and_long_texts(spark):
    rows = [(1, "s", None, 3, "é" * 70_000), (None, None, "en", None, None), (-5, "", "", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    shown = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    got = df.select(merkle.leaf(*map(F.col, df.columns)).alias("d")).collect()
    assert [r.d for r in got] == [sha("".join(map(shown, r))) for r in rows]


def test_tampering_is_found(spark, tmp_path):
    docs = [(i, random.Random(i).choice(["Abc", "abc", None, ""]), random.Random(i).choice(["en", "de", None]), "src", 3) for i in range(200)] + [(None, "Abc", "en", "src", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.verified for r in merkle.query(spark, str(tmp_path)).collect()}
    assert got == {d: not (d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and t == "Abc") for d, t, *_ in docs}


# --- quality of what is read twice ----------------------------------------------------------------------------------------------


def test_quality_of_a_table_that_is_dealt_anew_at_every_reading(spark):
    from redactica.llm import quality

    rng = random.Random(21)
    words = ["alpha", "beta", "of", "the", "gamma"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(30)), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    want = {r.doc_id: round(r.perplexity, 9) for r in quality.quality(docs, labels).collect()}
    chance = F.udf(lambda _: random.SystemRandom().random(), "double").asNondeterministic()
    dealt = docs.withColumn("r", chance("doc_id")).repartition(7, "r").drop("r")
    assert {r.doc_id: round(r.perplexity, 9) for r in quality.quality(dealt, labels).collect()} == want
