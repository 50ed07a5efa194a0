"""Claims and pairs in columns against the cascade's, and texts of very many spans."""

import random
import time

import pytest
from pyspark.sql import functions as F
from redactica.functions import catalogue as C
from redactica.functions import spans as S
from redactica.operators import cascade, claims, detect, dictionary

PIECES = ["PESEL 12345678901", "a.b@c.pl", "00-512 Kamionka", "w Kamionce", "ul. Lipowa 3", "NIP", "REGON", "526-000-12-46", "012345678", "526 000 12 46 012345678", "NIP: 5260001246", "12.03.2004", "ustawa z dnia 3 maja 1791", "tel. 600-123-123", "600 123 123", "Szkoła im. Marii Dolnej", "firma „Nad Stawem”", "Kwiatek i Syn Sp. z o.o.", "ABA300000", "\n", "\n\n", " ", ", ", "x", "Anna-Kowalska Maria", C.PAGE_SEPARATOR, "PL61 1090 1014 0000 0712 1981 2874", "Bank"]


def texts(n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("terms", "active", "pages"), [(None, None, None), ("Bank | Kamionka = [X]\nMarii = [Y]", None, None), (None, ["address", "company"], None), (None, None, frozenset({1, 3}))])
def test_claims_are_those_of_the_cascade(spark, terms, active, pages):
    terms, active = dictionary.parse(terms) if terms else None, detect.active_labels(active)
    rows = [*enumerate(texts(250, 1)), (900, None), (901, ""), (902, " ".join(texts(30, 2, 40)))]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, claims string, k int")
    got, want = (sorted(r[:] for r in f(docs, 2026, terms=terms, active=active, pages=pages).collect()) for f in (claims.claimed, cascade.claimed))
    assert got == want and len(got) > 200


def test_claims_use_no_python(spark):
    plan = claims.claimed(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 2026)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEvalPython"))


def test_fifty_thousand_claims_in_one_text(spark):
    line = "PESEL 12345678901 a@b.pl 00-512 x\n"
    docs = [spark.createDataFrame([(1, line * n)], "doc_id long, text string") for n in (1000, 4000, 17_000)]
    took = []
    for d, n in zip(docs, (1000, 4000, 17_000), strict=True):
        began = time.time()
        assert claims.claimed(d, 2026, active=detect.active_labels(["pesel", "email", "address"])).count() == 3 * n
        took.append(time.time() - began)
    assert took[2] < 12 * took[1] + 5


@pytest.mark.parametrize("label", ["NIP", "REGON"])
def test_pairs_are_those_of_the_cascade(spark, label):
    rng = random.Random(label)
    parts = {"NIP": ["NIP", "5260001246", "526-000-12-46"], "REGON": ["REGON", "012345678", "01234567812345"]}[label]
    rows = ["".join(rng.choice([*parts, "-", "", "x y"]) + rng.choice(["\n", " ", "\n\n"]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    for r in docs.select("id", detect.table_pairs(F.col("t"), label).alias("p")).collect():
        assert sorted((x.s, x.e) for x in r.p) == [x[:2] for x in cascade.table_pairs((label,))(rows[r.id])], rows[r.id]


def test_twenty_thousand_labels_take_no_square(spark):
    took = []
    for n in (2500, 20_000):
        d = spark.createDataFrame([("NIP NIP\n5260001246 5260001246\n" * (n // 2),)], "t string")
        began = time.time()
        assert d.select(F.size(detect.table_pairs(F.col("t"), "NIP"))).first()[0] == n
        took.append(time.time() - began)
    assert took[1] < 16 * took[0] + 3


def test_places_in_texts_that_hold_the_marks(spark):
    first, last, other = S.MARKS
    text = f"{first}12{last}3\n{other} 45 {first}{last}\n\n6"
    row = spark.createDataFrame([(text,)], "t string").select(S.spans(F.col("t"), r"\d+", lines=True).alias("x")).first()
    assert [tuple(x) for x in row.x] == [(1, 3, 0), (4, 5, 0), (8, 10, 1), (15, 16, 3)]


@pytest.mark.parametrize("n", [0, 1, 300, 3000])
def test_merged_and_disjoint_spans(spark, n):
    rng = random.Random(n)
    rows = sorted((s := rng.randint(0, 4 * n), s + rng.randint(1, 6)) for _ in range(n))
    merged, kept = [], []
    for s, e in rows:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
        if not kept or s >= kept[-1][1]:
            kept.append((s, e))
    got = spark.createDataFrame([(rows,)], f"x {S.SPANS}").select(S.merged(F.col("x")).alias("m"), S.disjoint(F.col("x"), S.SPAN).alias("d"), S.first_at(F.col("x"), F.lit(2 * n)).alias("k")).first()
    assert ([tuple(x) for x in got.m], [tuple(x) for x in got.d], got.k) == (merged, kept, sum(s < 2 * n for s, _ in rows))
