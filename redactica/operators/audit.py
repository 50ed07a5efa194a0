"""Residual-risk audit of masked text: independent patterns, a zero-filled row per category, status and risk."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import spans as S
from redactica.functions.regex import java
from redactica.operators import detect, dictionary


def count(text: Column, label: str, current_year: int, terms: list[dictionary.Term] | None = None) -> Column:
    if label == "SENSITIVE_DICTIONARY_TERM":
        n = F.regexp_count(text, F.lit(dictionary.java_pattern(terms))) if terms else F.lit(0)
    elif label == "LONG_NUMBER_SEQUENCE":
        long = F.size(F.filter(S.found(text, java(C.AUDIT[label])), lambda m: F.length(F.regexp_replace(m, "[ -]", "")) >= C.LONG_NUMBER_DIGITS))
        n = F.when(detect.may_hold(text, label), long).otherwise(0)
    elif label == "DATA":
        n = detect.date_count(text, java(C.AUDIT[label]), current_year)
    else:
        n = detect.counted(text, label, java(C.AUDIT[label]))
    return F.coalesce(n, F.lit(0)).cast("long")


def excluded_labels(active: frozenset[str] | None) -> frozenset[str]:
    """What the audit skips when only some labels were masked."""
    if active is None:
        return frozenset()
    out = {*C.LABELS, *C.NER_LABELS} - active
    return frozenset(out | set(C.AUDIT_ONLY_ADDRESS_LABELS)) if out & set(C.CATEGORIES["address"]) else frozenset(out)


def findings(docs: DataFrame, text: Column, current_year: int, keep: Iterable[str] = (), terms: list[dictionary.Term] | None = None, excluded: Iterable[str] = ()) -> DataFrame:
    """Columns (*keep, one per audit category), then total, status and risk_level. A null text has nothing left over: zeros and ok."""
    skip = set(excluded) - {"SENSITIVE_DICTIONARY_TERM"}
    rows = docs.select(*keep, *[(F.lit(0).cast("long") if x in skip else count(text, x, current_year, terms)).alias(x) for x in C.AUDIT_LABELS])
    total = sum((F.col(x) for x in C.AUDIT_LABELS), F.lit(0).cast("long"))
    high = sum((F.col(x) for x in C.HIGH_RISK_LABELS), F.lit(0).cast("long"))
    return rows.select("*", total.alias("total"), F.when(total > 0, "warning").otherwise("ok").alias("status"), risk(total, high).alias("risk_level"))


def risk(total: Column, high: Column) -> Column:
    return F.when(total == 0, "ok").when((high > 0) | (total >= C.HIGH_RISK_TOTAL), "high_risk").otherwise("warning")


def long_form(found: DataFrame, *keep: str) -> DataFrame:
    """Rows (*keep, label, n)."""
    return found.unpivot(list(keep), list(C.AUDIT_LABELS), "label", "n")
