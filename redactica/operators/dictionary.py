"""Private dictionaries: parsing, one longest-first alternation, counting, masking and spans, all on columns.

A dictionary is configuration: its terms are checked against MOST_TERMS and become one literal pattern that is compiled once per task;
of each match the patterns of the labels say which it is. A larger dictionary, or one of more labels than MOST_LABELS, is a table;
`automaton` finds its terms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactica.functions import spans as S
from redactica.functions.regex import java

#: Terms of one dictionary. More belong in a table of documents to scan, not in a pattern.
MOST_TERMS = 20_000
#: Labels of one dictionary that is a pattern.
MOST_LABELS = 100


@dataclass(frozen=True)
class Term:
    term: str
    label: str

    @property
    def key(self) -> str:
        return " ".join(self.term.split()).casefold()


def parse(text: str) -> list[Term]:
    """Lines `alias | alias = [LABEL]`; blank lines and # comments are skipped. Errors name the line only, never its text."""
    found: dict[str, Term] = {}
    for number, line in enumerate(text.removeprefix("﻿").splitlines(), 1):
        line = line.strip()
        if not line or line[0] == "#":
            continue
        left, sign, right = line.partition("=")
        m = re.fullmatch(r"\[\s*([^\[\]]*[^\[\]\s])\s*\]", right.strip())
        aliases = [a.strip() for a in left.split("|")]
        if not sign or not m or not all(aliases):
            raise ValueError(f"malformed dictionary line {number}")
        for alias in aliases:
            term = Term(alias, m[1])
            if found.setdefault(term.key, term).label != term.label:
                raise ValueError(f"dictionary line {number} gives an alias a second label")
    if len(found) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms")
    return list(found.values())


def load(spark: SparkSession, path: str) -> list[Term]:
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a dictionary is one file")
    return parse(rows[0].value)


def chosen(spark: SparkSession, path: str | None = None, terms: list[Term] | None = None) -> tuple[list[Term] | None, str]:
    """A dictionary and its status: 'not selected', 'loaded', or 'invalid' where the file is malformed or cannot be read."""
    if path is not None and terms is not None:
        raise ValueError("a path or terms, not both")
    if path is None:
        return terms, "not selected" if terms is None else "loaded"
    try:
        return load(spark, path), "loaded"
    except (ValueError, AnalysisException, PySparkException):
        return None, "invalid"


def ordered(terms: list[Term]) -> list[Term]:
    """Longer terms first."""
    return sorted(terms, key=lambda t: (len(t.key), len(t.term)), reverse=True)


def pattern(terms: list[Term]) -> str:
    """The alternation in Python's dialect, longer terms first."""

    def one(t: Term) -> str:
        body = r"[^\S\r\n]+".join(re.escape(w) for w in t.term.split())
        word = lambda c: c.isalnum() or c == "_"
        return (r"(?<!\w)" if word(t.term[0]) else "") + body + (r"(?!\w)" if word(t.term[-1]) else "")

    return "|".join(map(one, ordered(terms)))


def java_pattern(terms: list[Term]) -> str:
    return java(pattern(terms).replace(r"[^\S\r\n]", r"(?:(?![\r\n])\s)"), True) if terms else "(?!)x"


def labelled_spans(text: Column, terms: list[Term]) -> Column:
    """array<struct<s, e, label>>"""
    by_label: dict[str, list[Term]] = {}
    for t in ordered(terms):
        by_label.setdefault(t.label, []).append(t)
    if len(by_label) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels; a table of terms has no such bound")

    def label(value: Column) -> Column:
        name = F.lit(next(reversed(by_label), None)).cast("string")  # what no other label's pattern takes is of the last
        for x in [*reversed(by_label)][1:]:
            name = F.when(value.rlike(_whole(java_pattern(by_label[x]))), x).otherwise(name)
        return name

    return F.transform(S.spans(text, java_pattern(terms)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), label(S.value(text, x)).alias("label")))


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def counts(docs: DataFrame, text: Column, terms: list[Term], *keep: str) -> DataFrame:
    """Rows (*keep, label, n) for labels with hits."""
    rows = docs.select(*keep, F.explode(labelled_spans(text, terms)).alias("x"))
    return rows.groupBy(*keep, F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def masked(text: Column, terms: list[Term]) -> Column:
    return S.spliced(text, labelled_spans(text, terms), lambda x: F.concat(F.lit("["), x["label"], F.lit("]")))
