"""Detectors as column expressions: matches, gates, pairing and the town gazetteer. No shuffle; the scan reads id and text."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import spans as S
from redactica.functions.regex import java


def _begins(first: str, pattern: str) -> str:
    """The same pattern, which asks for the first character of a match before it looks behind."""
    return f"(?={first}){pattern}"


def detector(label: str) -> str:
    pattern, ignore_case = C.DETECTORS[label]
    if label in C.FIRST:
        pattern = _begins(C.FIRST[label], pattern)
    if label == "EMAIL":  # what comes before the @ holds none, so nothing is gained by giving any of it back
        pattern = pattern.replace("+@", "++@", 1)
    return java(pattern, ignore_case)


def may_hold(text: Column, label: str) -> Column:
    """Whether a text holds what every match of a label needs."""
    return text.rlike(java(*C.NEEDED[label])) if label in C.NEEDED else F.lit(True)


def counted(text: Column, label: str, pattern: str) -> Column:
    """Matches of a label's pattern; a text without what they need is not searched."""
    n = F.regexp_count(text, F.lit(pattern))
    return F.when(may_hold(text, label), n).otherwise(0) if label in C.NEEDED else n


def date_count(text: Column, pattern: str, current_year: int) -> Column:
    """Dates that are not kept; one by one only where a text has a date in words or the words before an act's date."""
    kept = F.size(F.filter(S.spans(text, pattern), lambda x: ~kept_date(text, x, current_year)))
    return F.when(text.rlike(java(rf"z\s+dnia\s|{C.MONTHS}", True)), kept).otherwise(counted(text, "DATA", pattern))


def kept_date(text: Column, span: Column, current_year: int) -> Column:
    """True for a legal act's date and for a date in words a century old without a life event before it."""
    head = S.before(text, span["s"], C.LEGAL_ACT_CHARS)
    z_dnia, act = java(C.Z_DNIA, True), java(C.LEGAL_ACT, True)
    after_act = F.split(F.regexp_replace(head, z_dnia, ""), act, -1)
    legal = head.rlike(z_dnia) & (F.size(after_act) > 1) & ~F.element_at(after_act, -1).rlike(java(C.SENTENCE_BREAK))
    value = S.value(text, span)
    year = F.try_to_number(F.regexp_extract(value, r"(\p{Nd}{4})$", 1), F.lit("9999"))
    old = value.rlike(r"\p{L}") & (F.coalesce(year, F.lit(9999)) <= current_year - C.HISTORICAL_YEARS)
    personal = S.before(text, span["s"], C.PERSONAL_DATE_CHARS).rlike(java(C.PERSONAL_DATE, True))
    return legal | (old & ~personal)


def label_spans(text: Column, label: str, current_year: int) -> Column:
    found = S.spans(text, detector(label))
    if label != "DATA":
        return found
    # of many dates one by one only where a text has a date in words or the words before an act's date
    plain = lambda f: (F.size(f) > S.FEW) & ~text.rlike(java(rf"z\s+dnia\s|{C.MONTHS}", True))
    return S.once(found, lambda f: F.when(plain(f), f).otherwise(F.filter(f, lambda x: ~kept_date(text, x, current_year))))


def label_counts(docs: DataFrame, text: Column, current_year: int, labels: Iterable[str] = tuple(C.DETECTORS), keep: Iterable[str] = ()) -> DataFrame:
    """Rows (*keep, label, n) for each document and label, the detectors working independently of each other; a null text has none."""
    counts = [F.struct(F.lit(x).alias("label"), F.coalesce(date_count(text, detector(x), current_year) if x == "DATA" else counted(text, x, detector(x)), F.lit(0)).cast("long").alias("n")) for x in labels]
    return docs.select(*keep, F.explode(F.array(*counts)).alias("c")).select(*keep, "c.label", "c.n")


def has_phone_context(text: Column, start: Column) -> Column:
    return S.before(text, start, C.PHONE_CONTEXT_CHARS).rlike(java(C.PHONE_CONTEXT, True))


def weak_phones(text: Column, with_context: bool) -> Column:
    return F.filter(S.spans(text, java(_begins(r"\d", C.WEAK_PHONE))), lambda x: has_phone_context(text, x["s"]) == F.lit(with_context))


def organisations(text: Column) -> Column:
    """Quoted and patron organisations; the words before a quoted name count only on its line."""
    quoted = java(C.QUOTED)

    def trimmed(x: Column) -> Column:
        value = S.value(text, x)
        name = F.element_at(S.found(value, quoted), -1)
        head = F.substring(value, F.lit(1), F.length(value) - F.length(name))
        return F.when(F.contains(head, F.lit("\n")), F.struct((x["e"] - F.length(name)).alias("s"), x["e"].alias("e"))).otherwise(x)

    has_quote = functools.reduce(operator.or_, (F.contains(text, F.lit(q)) for q in C.QUOTES))
    names = F.when(has_quote, F.transform(S.spans(text, java(C.QUOTED_ORGANISATION)), trimmed)).otherwise(S.empty())
    patrons = F.when(F.contains(text, F.lit("im.")), S.spans(text, java(C.PATRON_FACILITY))).otherwise(S.empty())
    both = S.once(F.concat(names, patrons), lambda x: F.when(F.size(x) < 2, x).otherwise(S.merged(F.array_sort(x))))
    return F.when(text.isNotNull(), both)


def table_pairs(text: Column, label: str) -> Column:
    """Values (s, e) claimed by bare labels: each takes the nearest free value after it, a few lines ahead at most.

    Labels go forward, so the values that are taken end with the last one taken: that is all that one label tells the next."""
    named, valued = java(_begins(C.FIRST[label], C.BARE_LABEL[label]), True), java(_begins(r"\d", C.BARE_VALUE[label]))
    labels, values = S.spans(text, named, lines=True), S.spans(text, valued, lines=True)

    def claims(free: Column) -> Column:
        def claim(last: Column, x: Column) -> tuple[Column, Column]:
            k = F.greatest(x["k"], last + 1)
            near = S.once(F.try_element_at(free, k), lambda v: F.when(v["line"] - x["line"] <= C.TABLE_LINES_AHEAD, F.array(F.struct(v["s"].alias("s"), v["e"].alias("e")))).otherwise(S.empty()))
            return F.when(F.try_element_at(free, k)["line"] - x["line"] <= C.TABLE_LINES_AHEAD, k).otherwise(last), near

        # the first value after each label, looked up once
        ahead = F.transform(labels, lambda x: F.named_struct(F.lit("line"), x["line"], F.lit("k"), S.first_at(free, x["s"]) + 1))
        return S.scan(ahead, F.lit(0), S.SPAN, claim)

    needed = may_hold(text, label) & text.rlike(named)
    return F.when(needed, S.once(values, claims)).otherwise(S.empty())


def town_names(text: Column) -> Column:
    """Distinct towns that follow a postal code."""
    return F.array_distinct(F.transform(S.found(text, detector("MIEJSCOWOSC")), lambda x: F.trim(F.regexp_replace(x, java(r"\s+"), " "))))


def _quoted(word: Column) -> Column:
    return F.concat(F.lit("\\Q"), word, F.lit("\\E"))


def town_word(word: Column) -> Column:
    """A pattern of all inflections of one word of a town's name."""
    letters = java(f"[{C.LETTER}]")

    def of(stem: Column) -> Column:
        open_ = F.concat(_quoted(stem), F.when(stem == word, F.lit(f"{letters}{{0,{C.PLACE_MAX_INFLECTION}}}")).otherwise(F.lit(f"{letters}{{1,{C.PLACE_MAX_INFLECTION}}}")))
        return F.when(F.length(stem) < C.PLACE_MIN_STEM, _quoted(word)).otherwise(open_)

    return S.once(F.regexp_replace(word, java(C.PLACE_ENDING, True), ""), of)


def town_pattern(names: Column) -> Column:
    """One pattern for all towns, null without any: whole names, and first words with an adjective; the longest first."""
    gap = java(C.PLACE_GAP)

    def of(words: Column) -> Column:
        sibling = F.concat(F.element_at(words, 1), F.lit(gap + java(C.PLACE_ADJECTIVE)))
        return F.when(F.size(words) > 1, F.array(F.array_join(words, gap), sibling)).otherwise(F.array(F.array_join(words, gap)))

    def any_of(names: Column) -> Column:
        full = F.flatten(F.transform(names, lambda name: S.once(F.transform(F.split(name, " "), town_word), of)))
        longest = F.array_sort(full, lambda a, b: F.length(b) - F.length(a))
        initials = F.array_join(F.array_distinct(F.transform(names, lambda name: F.substring(name, 1, 1))), "")
        head = F.concat(F.lit("(?iu)(?=["), initials, F.lit(java(r"])(?<![\w@.-])(?:")))
        return F.when(F.size(names) > 0, F.concat(head, F.array_join(longest, "|"), F.lit(java(r")(?![\w@-])"))))

    return S.once(names, any_of)


def town_mentions(text: Column, pattern: Column) -> Column:
    """Spans of towns in any inflection that begin with a capital letter."""
    all_ = F.when(pattern.isNull(), S.empty()).otherwise(S.spans(text, F.coalesce(pattern, F.lit("(?!)x"))))
    return F.filter(all_, lambda x: F.substring(text, x["s"] + 1, F.lit(1)).rlike(r"\p{Lu}"))


def active_labels(categories: Iterable[str] | None) -> frozenset[str] | None:
    """None means all; else the labels of the chosen categories and those that no category controls."""
    if categories is None:
        return None
    controlled = {x for labels in C.CATEGORIES.values() for x in labels}
    return frozenset({*C.LABELS, *C.NER_LABELS} - controlled | {x for c in categories for x in C.CATEGORIES.get(c, ())})


def active_pages(pages: str | None, page_count: int | None = None) -> frozenset[int] | None:
    """The pages of a choice like '1-3,5'; None for all. Raises ValueError for what is no such choice."""
    import re

    chosen: set[int] = set()
    for token in (pages or "").split(","):
        token = token.strip()
        if not token:
            continue
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", token)
        first, last = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
        if not m or first < 1 or last < first or last > min(C.MAX_PAGE, page_count or C.MAX_PAGE):
            raise ValueError(f"no page range: {token}")
        chosen.update(range(first, last + 1))
    return frozenset(chosen) or None
