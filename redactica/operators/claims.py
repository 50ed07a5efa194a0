"""First claim on the original offsets, in column expressions: what `cascade.claimed` finds, without Python workers.

Rules apply one after the other. Each adds the spans that overlap none that are claimed; claims are disjoint and sorted, so a span is
looked up among them by halving, and a text of many spans takes no square of their number. Texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import spans as S
from redactica.operators import detect, dictionary

CLAIM = "struct<s:int,e:int,r:int,label:string>"
#: The rank of the dictionary's spans.
DICTIONARY = 0


def _rules(text: Column, towns: Column, current_year: int, terms: list[dictionary.Term] | None, active: frozenset[str] | None) -> Iterator[tuple[str | None, Column]]:
    """(label, spans) of each rule in the cascade's order; the dictionary's spans have labels of their own. Pairs of both labels are one
    rule."""
    on = lambda x: active is None or x in active
    yield None, dictionary.labelled_spans(text, terms) if terms else None
    if on("NAZWA_FIRMY"):
        yield "NAZWA_FIRMY", detect.organisations(text)
    for label in C.DETECTORS:
        if on(label):
            yield label, F.when(detect.may_hold(text, label), detect.label_spans(text, label, current_year)).otherwise(S.empty())
        if label == "REGON":
            yield from (("+" + x, detect.table_pairs(text, x)) for x in ("NIP", "REGON") if on(x))
    if on("MIEJSCOWOSC"):
        yield "MIEJSCOWOSC", detect.town_mentions(text, towns)
    if on("TELEFON"):
        yield "TELEFON", detect.weak_phones(text, True)


def _ranked(rules: Iterator[tuple[str | None, Column | None]]) -> tuple[Column, int, tuple[int, ...]]:
    """All claims in one array, how many ranks they have, and the ranks whose claims may overlap each other."""
    arrays, rank, pairs = [], 0, None
    for label, found in rules:
        if label is None:
            label_of, own = (lambda x: x["label"]), rank
        elif label.startswith("+"):
            own = pairs = rank + 1 if pairs is None else pairs
            label_of = lambda x, name=label[1:]: F.lit(name)
        else:
            own = rank + 1
            label_of = lambda x, name=label: F.lit(name)
        rank = max(rank, own)
        if found is not None:
            arrays.append(_with(found, own, label_of))
    return F.concat(S.empty(f"array<{CLAIM}>"), *arrays), rank + 1, () if pairs is None else (pairs,)


def _with(found: Column, rank: int, label_of) -> Column:
    return F.transform(found, lambda x: F.named_struct(F.lit("s"), x["s"], F.lit("e"), x["e"], F.lit("r"), F.lit(rank), F.lit("label"), label_of(x))).cast(f"array<{CLAIM}>")


def claimed(docs: DataFrame, current_year: int, id_col: str = "doc_id", text_col: str = "text", terms: list[dictionary.Term] | None = None, active: frozenset[str] | None = None, pages: frozenset[int] | None = None) -> DataFrame:
    """Rows (doc_id, page, start, end, label, source); pages are numbered from 1, and towns are known throughout their document."""
    parts = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), C.PAGE_SEPARATOR, -1)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), parts.alias("pages"))
    names = F.array_distinct(F.flatten(F.transform("pages", lambda p: F.when(detect.may_hold(p, "MIEJSCOWOSC"), detect.town_names(p)).otherwise(F.expr("cast(array() as array<string>)")))))
    rows = rows.select("doc_id", "pages", detect.town_pattern(names).alias("towns")).select("doc_id", "towns", F.posexplode("pages").alias("k", "text"))
    if pages is not None:
        rows = rows.filter((F.col("k") + 1).isin(*sorted(pages)))
    found, ranks, overlapping = _ranked(_rules(F.col("text"), F.col("towns"), current_year, terms, active))
    rows = rows.select("doc_id", (F.col("k") + 1).alias("page"), found.alias("found"))
    # an outer one, as a filter for empty arrays would make the claims be found twice
    rows = rows.select("doc_id", "page", F.explode_outer(S.ranked_claims(F.col("found"), CLAIM, ranks, overlapping)).alias("c")).filter("c is not null")
    source = F.when(F.col("c.r") == DICTIONARY, "dictionary").otherwise("regex")
    return rows.select("doc_id", "page", F.col("c.s").alias("start"), F.col("c.e").alias("end"), "c.label", source.alias("source"))
