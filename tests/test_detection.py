"""Golden texts, and the native detectors against the same catalogue in Python."""

import random

import pytest
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import spans as S
from redactica.functions.regex import java, python
from redactica.operators import audit, automaton, cascade, detect, dictionary

TABLE = "NIP\nREGON\n526-000-12-46\n012345678"
GOLDEN = [
    ("Synthetic PESEL: 00000000000.", "Synthetic PESEL: [PESEL]."),
    ("NIP: 123-456-32-18.", "[NIP]."),
    ("REGON: 123456785. REGON: 12345678512347.", "[REGON]. [REGON]."),
    ("Sprawa numer 12345 dotyczy zamowienia.", "Sprawa numer 12345 dotyczy zamowienia."),
    (TABLE, "NIP\nREGON\n[NIP]\n[REGON]"),
    ("ul. Lipowa 7, 34-512 Borowiec Dolny.\nOŚRODEK W BOROWCU DOLNYM. Bank w Borowcu\nDolnym. Działka w obrębie Borowiec Górny.", "[ULICA], [POSTAL_CODE] [MIEJSCOWOSC].\nOŚRODEK W [MIEJSCOWOSC]. Bank w [MIEJSCOWOSC]. Działka w obrębie [MIEJSCOWOSC]."),
    ("43-100 Tychy. Mieszka w Tychach. Tych dokumentów, tych ludzi.", "[POSTAL_CODE] [MIEJSCOWOSC]. Mieszka w [MIEJSCOWOSC]. Tych dokumentów, tych ludzi."),
    ("Umowa: Kwiatek i Syn Sp. z o.o. i 3M Polska S.A.", "Umowa: [NAZWA_FIRMY] i [NAZWA_FIRMY]."[:-1]),
    ("tel. 600-111-222, inne 600-111-223", "tel. [TELEFON], inne 600-111-223"),
    ("ola@poczta-\ntestowa.test 😀 ola@b.pl", "[EMAIL] 😀 [EMAIL]"),
    ("ustawa z dnia 12 marca 2004 r. i 11 listopada 1918 r., ur. 3 maja 1901 r.", "ustawa z dnia 12 marca 2004 r. i 11 listopada 1918 r., ur. [DATA] r."),
    ("obok Przychodnia „Nad Stawem” i Szpital Powiatowy im. Anny Leśnej", "obok [NAZWA_FIRMY] i [NAZWA_FIRMY]"),
    ("Adres: Ogrodowa 22, Adres Testowy Warszawa", "[ULICA], Adres Testowy Warszawa"),
    ("ABA300000 PL61 1090 1014 0000 0712 1981 2874", "[DOWOD_OSOBISTY] [IBAN]"),
    ("", ""),
]


@pytest.mark.parametrize(("text", "expected"), GOLDEN)
def test_golden_text(text, expected):
    assert cascade.substitute(text, 2026)[0] == expected


def _texts(n=300):
    rng = random.Random(5)
    bits = ["ul. Lipowa 7", "34-512 Borowiec", " ", "\n", "12345678901", "a@b.pl", "PL61", "NIP 526-000-12-46", "REGON", "600 111 222", "tel. ", "Jan", "-Kowalska Maria", "ł", "😀", "²", "12.03.2004", "z dnia ", "ustawa ", "3 maja 1901", ".", "S.A.", "Firma ", "123456789", "\u00a0", "A/12/2020", "W. Nowak", "„Nad Stawem”", "przychodnia "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_native_spans_equal_python(spark):
    texts = _texts() + [g[0] for g in GOLDEN]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    columns = [S.spans(F.col("text"), detect.detector(x)).alias(x) for x in C.DETECTORS]
    for row in docs.select("id", *columns).collect():
        for label, (pattern, fold) in C.DETECTORS.items():
            assert [(x.s, x.e) for x in row[label]] == [m.span() for m in python(pattern, fold).finditer(texts[row.id])], (label, texts[row.id])


def test_native_gates_equal_cascade(spark):
    texts = _texts() + [g[0] for g in GOLDEN]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = F.col("text")
    rows = docs.select("id", detect.label_spans(t, "DATA", 2026).alias("d"), detect.organisations(t).alias("o"), detect.table_pairs(t, "NIP").alias("n"), detect.table_pairs(t, "REGON").alias("r"), detect.weak_phones(t, True).alias("w"), detect.town_mentions(t, detect.town_pattern(detect.town_names(t))).alias("m")).collect()
    for row in rows:
        text = texts[row.id]
        towns = cascade.Gazetteer([text])
        wanted = [cascade.by_pattern("DATA", 2026)(text), cascade.organisations(text), cascade.table_pairs(("NIP",))(text), cascade.table_pairs(("REGON",))(text), cascade.weak_phones(text), towns(text)]
        assert [[(x.s, x.e) for x in got] for got in row[1:]] == [[s[:2] for s in w] for w in wanted], text


def test_audit_counts_equal_python(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in audit.findings(docs, F.col("text"), 2026, ["id"]).collect():
        for label, pattern in C.AUDIT.items():
            found = [m for m in python(pattern).finditer(texts[row.id]) if label != "LONG_NUMBER_SEQUENCE" or sum(map(str.isdigit, m[0])) >= 12]
            if label == "DATA":
                found = [m for m in found if not cascade.kept_date(texts[row.id], m.start(), m[0], 2026)]
            assert row[label] == len(found), (label, texts[row.id])


def test_long_inputs_do_not_overflow(spark):
    docs = spark.createDataFrame([("a@" + "b" * 40_000,), ("1 " * 20_000,), ("x-\n" * 10_000,)], "text string")
    assert audit.findings(docs, F.col("text"), 2026).count() == 3
    assert detect.label_counts(docs, F.col("text"), 2026).count() == 3 * len(C.DETECTORS)


def test_first_claim_keeps_what_a_rejected_span_overlaps(spark):
    chain = F.expr("array(named_struct('s', 0, 'e', 5), named_struct('s', 3, 'e', 8), named_struct('s', 7, 'e', 10))")
    kept = spark.range(1).select(S.first_claim(chain, S.SPANS).alias("x")).first().x
    assert [(k.s, k.e) for k in kept] == [(0, 5), (7, 10)]


def test_filtered_labels_claim_nothing():
    text = "34-512 Borowiec Dolny, w Borowcu Dolnym"
    assert cascade.substitute(text, 2026, active=frozenset({"POSTAL_CODE"}))[0] == "[POSTAL_CODE] Borowiec Dolny, w Borowcu Dolnym"
    spans = list(cascade.claims("ul. Lipowa 7", [], 2026, active=frozenset({"NER_PERSON"}), entities=[(4, 10, "NER_PERSON")]))
    assert spans == [(4, 10, "NER_PERSON", "ner")]


def test_categories_and_pages():
    assert detect.active_labels(None) is None
    assert detect.active_labels([]) == {"DOWOD_OSOBISTY", "PERSON_NAME_TYPO", "NER_MISC"}
    assert "ULICA" in detect.active_labels(["address", "nonsense"])
    assert detect.active_pages(" ") is None and detect.active_pages("1-3,5") == {1, 2, 3, 5}
    for bad in ("x", "0", "3-1", "20001", "1--2"):
        with pytest.raises(ValueError):
            detect.active_pages(bad)
    with pytest.raises(ValueError):
        detect.active_pages("4", page_count=3)


def test_dictionary(spark):
    terms = dictionary.parse("﻿# x\n\nJan  Kowalski | JK = [ OSOBA ]\nAcme = [FIRMA]\nacme = [FIRMA]\n(x) = [ZNAK]")
    assert [(t.term, t.label) for t in terms] == [("Jan  Kowalski", "OSOBA"), ("JK", "OSOBA"), ("Acme", "FIRMA"), ("(x)", "ZNAK")]
    for bad in ("a", "a = b", " = [X]", "a = [X]\nA = [Y]", "a = []"):
        with pytest.raises(ValueError) as e:
            dictionary.parse(bad)
        assert "a =" not in str(e.value)
    text = "Jan\tKowalski i jk, ACME (x). Acmeson, JKx"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.m for r in docs.select("doc_id", dictionary.masked(F.col("text"), terms).alias("m")).collect()}
    assert rows[1] == cascade.substitute(text, 2026, terms)[0] == "[OSOBA] i [OSOBA], [FIRMA] [ZNAK]. Acmeson, JKx" and rows[2] is None


def test_java_form_of_classes(spark):
    probe = ["a²b", "e\u0301x", "x‿y", "\u00a0", "İstanbul", "ŁÓDŹ"]
    docs = spark.createDataFrame(list(enumerate(probe)), "id int, t string")
    for p in (r"\w+", r"\s", r"[\w-]+", r"(?<!\w)x", r"\d"):
        for r in docs.select("id", F.regexp_extract_all("t", F.lit(java(p)), F.lit(0)).alias("m")).collect():
            assert r.m == python(p).findall(probe[r.id]), (p, probe[r.id])


def test_no_value_leaves_the_engine(spark):
    docs = spark.createDataFrame([(1, GOLDEN[5][0])], "doc_id long, text string")
    rows = str(cascade.claimed(docs, 2026).collect()) + str(audit.findings(docs, F.col("text"), 2026, ["doc_id"]).collect())
    assert "Borow" not in rows and "Lipowa" not in rows


def test_large_dictionary(spark):
    terms = dictionary.parse("alfa = [A]\nalfa beta = [B]\nbeta gamma = [C]\nŻółć = [D]")
    texts = ["Alfa  beta gamma, alfa\nbeta", "żółć alfabeta alfa-beta", "", None, "beta gamma beta\tgamma 😀 alfa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(t.term, t.label) for t in terms], "term string, label string")
    got = sorted(r[:] for r in automaton.spans(docs, table).collect())
    want = docs.select("doc_id", F.explode(dictionary.labelled_spans(F.col("text"), terms)).alias("x")).select("doc_id", "x.s", "x.e", "x.label").collect()
    assert got == sorted(r[:] for r in want) and len(got) > 6


def test_large_dictionary_finds_marks_and_long_terms(spark):
    long = "a b c d e f g h i j"
    terms = dictionary.parse(f"Nowak-Kowalska = [A]\nSp. z o.o. = [B]\n{long} = [C]\nC++ = [D]\n-x = [E]\nz = [F]\n😀 k. = [G]")
    texts = ["Anna NOWAK-KOWALSKA, Acme sp. z  o.o., Nowak - Kowalska", f"{long} k", "C++ c+ xC++ C++y", "a-x a-xy --x", "sp.\nz o.o. 😀 K.😀\nk.", "...", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(t.term, t.label) for t in terms], "term string, label string")
    got = sorted(r[:] for r in automaton.spans(docs, table).collect())
    want = docs.select("doc_id", F.explode(dictionary.labelled_spans(F.col("text"), terms)).alias("x")).select("doc_id", "x.s", "x.e", "x.label").collect()
    assert got == sorted(r[:] for r in want) and {r[3] for r in got} == set("ABCDEFG")
    assert automaton.spans(docs, table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 256, 257, 1000])
def test_many_matches_have_the_places_of_few(spark, n):
    text = "ż" + "ab 12 😀" * n
    row = spark.range(1).select(S.spans(F.lit(text), r"\d+").alias("x"), S.spans(F.lit(None).cast("string"), r"\d+").alias("none")).first()
    assert [(x.s, x.e) for x in row.x] == [m.span() for m in python(r"\d+").finditer(text)] and row.none is None


def test_twenty_thousand_matches_take_no_square(spark):
    import time

    began = time.time()
    assert spark.range(1).select(F.size(S.spans(F.lit("1 x " * 20_000), r"\d")).alias("n")).first().n == 20_000
    assert time.time() - began < 3


def test_needed_parts_hide_no_match(spark):
    texts = [t.upper() if i % 3 else t for i, t in enumerate(_texts(400))] + [g[0] for g in GOLDEN] + ["Firma \u017fp. z o.o.", "n\u0131p 5260001246"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {(r.id, r.label): r.n for r in detect.label_counts(docs, F.col("text"), 2026, keep=["id"]).collect()}
    for i, t in enumerate(texts):
        for label in C.DETECTORS:
            pattern, fold = C.DETECTORS[label]
            found = [m for m in python(pattern, fold).finditer(t) if label != "DATA" or not cascade.kept_date(t, m.start(), m[0], 2026)]
            assert rows[i, label] == len(found) == len(list(cascade.by_pattern(label, 2026)(t))), (label, t)


def test_null_text_is_counted_and_audited(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = audit.findings(docs, F.col("text"), 2026, ["doc_id"], dictionary.parse("a = [A]")).first()
    assert all(row[x] == 0 for x in C.AUDIT_LABELS) and (row.total, row.status, row.risk_level) == (0, "ok", "ok")
    assert all(r.n == 0 for r in detect.label_counts(docs, F.col("text"), 2026).collect())


FOREIGN = "Straße = [A]\nKis = [B]\nsklep | kelwin = [C]\nSp. z o.o. = [D]\nKowalski-Nowak = [E]\na b c d e f g h i = [F]\n\\E.x = [G]"
FOREIGN_TEXTS = ["Die Straße hier", "STRASSE straße", "Kıs KIS K\u0130S k\u0131s", "\u017fklep \u212aelwin SKLEP", "Acme Sp. z  o.o., sp.z o.o.", "KOWALSKI-NOWAK Kowalski - Nowak", "A b c d e f g h I j", "\\e.X \\E", "", None]


def test_dictionary_beyond_ascii(spark):
    terms = dictionary.parse(FOREIGN)
    docs = spark.createDataFrame(list(enumerate(FOREIGN_TEXTS)), "doc_id long, text string")
    native = {r.doc_id: r.m for r in docs.select("doc_id", dictionary.masked(F.col("text"), terms).alias("m")).collect()}
    for i, t in enumerate(FOREIGN_TEXTS):
        if t is not None:
            assert native[i] is not None and cascade.substitute(t, 2026, terms)[0] is not None
    assert native[0] == "Die [A] hier" and native[1] == "STRASSE [A]" and native[3] == "[C] [C] [C]" and native[4] == "Acme [D], sp.z o.o."
    assert native[5] == "[E] Kowalski - Nowak" and native[6] == "[F] j" and native[7] == "[G] \\E" and native[2].startswith("[B] [B]") and native[9] is None
    for i in (0, 1, 3, 4, 5, 6, 7):
        assert cascade.substitute(FOREIGN_TEXTS[i], 2026, terms)[0] == native[i]
    table = spark.createDataFrame([(t.term, t.label) for t in terms], "term string, label string")
    got = sorted(r[:] for r in automaton.spans(docs, table).collect())
    want = docs.select("doc_id", F.explode(dictionary.labelled_spans(F.col("text"), terms)).alias("x")).select("doc_id", "x.s", "x.e", "x.label").collect()
    assert got == sorted(r[:] for r in want)
    with pytest.raises(ValueError, match="labels"):
        dictionary.labelled_spans(F.col("text"), dictionary.parse("\n".join(f"t{i} = [L{i}]" for i in range(101))))


def test_a_dictionary_says_whether_it_was_loaded(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("Kowalski = [KLIENT]\n")
    bad.write_text("Kowalski\n")
    terms, status = dictionary.chosen(spark, str(good))
    assert [t.label for t in terms] == ["KLIENT"] and status == "loaded"
    assert dictionary.chosen(spark) == (None, "not selected")
    assert dictionary.chosen(spark, terms=terms) == (terms, "loaded")
    assert dictionary.chosen(spark, str(bad)) == dictionary.chosen(spark, str(tmp_path / "none.txt")) == (None, "invalid")
