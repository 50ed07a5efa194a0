"""Automata against the pattern that they stand for, whole or cut into parts, and on large dictionaries and long texts."""

import random
import re
import time

import pytest
from redactica.operators import automaton, dictionary


def _found(parts, texts):
    scan, by_text = automaton.Scan(texts), {}
    for a in parts:
        for row, *hit, label in zip(*(x.tolist() for x in scan.hits(a)), strict=True):
            by_text.setdefault(row, []).append((*hit, a.labels[label]))
    return [automaton.claimed(by_text.get(k, [])) for k in range(len(texts))]


@pytest.mark.parametrize("alphabet", ["ab", "abAB é_-.", "kKıİiIK sſß ẞ", "a b-\n\t .", "aΑα.Ωω Ω"])
def test_automata_find_what_the_pattern_finds(alphabet):
    rng = random.Random(alphabet)
    words = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(80):
        terms = {}
        for _ in range(rng.randint(1, 14)):
            if t := words(rng.randint(1, 7)).strip():
                terms.setdefault(dictionary.Term(t, "").key, dictionary.Term(t, rng.choice("XYZ")))
        terms, texts = list(terms.values()), [words(rng.randint(0, 70)) for _ in range(6)]
        rows = [(t.term, t.label, k) for k, t in enumerate(terms)]
        whole, cut = [automaton.Automaton(rows)], [automaton.Automaton(rows[k::3]) for k in range(3)]
        pattern = re.compile(dictionary.pattern(terms) or "(?!)", re.IGNORECASE)
        want = [[m.span() for m in pattern.finditer(t)] for t in texts]
        assert [[h[:2] for h in found] for found in _found(whole, texts)] == want
        assert _found(cut, texts) == _found(whole, texts)


def test_many_terms_and_a_long_text():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(60_000)]
    terms = dict.fromkeys(vocabulary[:30_000]) | {f"{a} {b}": None for a, b in zip(vocabulary[:20_000], vocabulary[20_000:40_000], strict=True)}
    a = automaton.Automaton([(t, f"L{k % 7}", k) for k, t in enumerate(terms)])
    words = [rng.choice(vocabulary) for _ in range(200_000)]
    text, want, k = " ".join(words), 0, 0
    while k < len(words):
        n = 2 if k + 1 < len(words) and f"{words[k]} {words[k + 1]}" in terms else 1 if words[k] in terms else 0
        want, k = want + bool(n), k + max(n, 1)
    assert len(_found([a], [text])[0]) == want
    took = []
    for part in (text[: len(text) // 4], text):
        began = time.process_time()
        automaton.Scan([part]).hits(a)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_a_long_term_and_nested_ones():
    terms = [("x" * 5000 + " y", "A", 0), *(("a " * n + "a", "B", n) for n in range(1, 40))]
    text = "z " + "X" * 5000 + "   Y " + "a " * 100 + "\na"
    assert [(e - s, label) for s, e, label in _found([automaton.Automaton(terms)], [text])[0]] == [(5004, "A"), (79, "B"), (79, "B"), (39, "B")]


def test_parts_and_masks(spark):
    rng = random.Random(5)
    terms = [(f"{a}{b}", f"L{ord(a) % 3}", k) for k, (a, b) in enumerate((x, y) for x in "abcdefgh" for y in ("", "b", " c", "-d e"))]
    texts = [" ".join(rng.choice(["a", "bb", "C  c", "d", "e-d", "e", "h\n", "ż"]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, label string, place int")
    table = spark.createDataFrame(terms, "term string, label string, place long")
    whole = sorted(r[:] for r in automaton.spans(docs, table).collect())
    assert sorted(r[:] for r in automaton.spans(docs, table, part_chars=9).collect()) == whole and len(whole) > 100
    masked = {r.doc_id: (r.masked, r.counters) for r in automaton.masked(docs, table).collect()}
    assert {r.doc_id: (r.masked, r.counters) for r in automaton.masked(docs, table, part_chars=9).collect()} == masked
    pattern = [dictionary.Term(t, label) for t, label, _ in terms]
    from redactica.operators import cascade

    rule = cascade.from_dictionary(pattern)
    for k, t in enumerate(texts):
        want = list(rule(t)) if t else []
        assert [x[1:] for x in whole if x[0] == k] == want and sum(masked[k][1].values() if masked[k][1] else []) == len(want)
    assert masked[40][0] is None and masked[41][0] == "" and automaton.spans(docs, table.limit(0)).count() == 0


def test_dictionary_files_of_any_size(spark, tmp_path):
    good = tmp_path / "good.txt"
    good.write_text("﻿# private\n\nJan Nowak | J. Nowak = [ OSOBA ]\nAcme=[FIRMA]\n", encoding="utf-8")
    rows = automaton.read(spark, str(good))
    assert [(r.term, r.label) for r in rows.orderBy("place").collect()] == [(t.term, t.label) for t in dictionary.parse(good.read_text(encoding="utf-8"))]
    for text, line in (("a = [X]\nb\n", 2), ("a = [X]\n\nb | = [X]", 3), ("a = []", 1), ("a = [X] y", 1), ("a = [[X]]", 1), ("a = [X]\n# n\nA  = [Y]", 3)):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(ValueError, match=f"line {line}( |$)"):
            automaton.read(spark, str(tmp_path / "bad.txt"))
        with pytest.raises(ValueError, match=f"line {line}( |$)"):
            dictionary.parse(text)
