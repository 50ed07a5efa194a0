"""What follows a named-entity model: label mapping, two-pass resolution, exclusions and counters, over injected entity tables.

The model itself is pluggable: whoever runs one gives rows of `entities` (doc_id, pass 'bridged' or 'raw', ord, start, end, model_label).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import spans as S
from redactica.functions.regex import java, python

EXCLUSIONS = ("PUBLIC_INSTITUTION_PHRASE", "VERSION_LIKE", "SCIENTIFIC_NAME", "ORDINARY_WORD", "SINGLE_TOKEN_PERSON_SKIPPED", "LINEBREAK_NON_PERSON_SKIPPED")


def internal_label(model_label: Column) -> Column:
    """The label of a model's label; null for labels that are not used."""
    names = F.create_map(*[F.lit(x) for pair in C.MODEL_LABELS.items() for x in pair])
    return F.element_at(names, F.upper(F.replace(F.trim(model_label), F.lit("-"), F.lit("_"))))


def normalised(value: Column) -> Column:
    """Dashes alike and without blanks around them, white space collapsed, lower case."""
    plain = F.translate(value, C.DASHES, "-" * len(C.DASHES))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, java(r"\s*-\s*"), "-"), java(r"\s+"), " ")))


@functools.cache
def _phrases(phrases: tuple[str, ...]) -> str:
    """A pattern of whole values, and of phrases of several words anywhere at word bounds."""
    several = [re.escape(p) for p in phrases if len(re.findall(r"\w+", p)) > 1]
    return rf"^(?:{'|'.join(map(re.escape, phrases))})$|(?<!\w)(?:{'|'.join(several)})(?!\w)"


def exclusion(value: Column, label: Column) -> Column:
    """Why an entity is no finding, or null."""
    key, collapsed = normalised(value), F.trim(F.regexp_replace(value, java(r"\s+"), " "))
    return (
        F.when(key == "", F.lit(None).cast("string"))
        .when(collapsed.rlike("^(?:" + java(C.VERSION_LIKE, True) + ")$"), "VERSION_LIKE")
        .when(key.isin(*C.ORDINARY_WORDS), "ORDINARY_WORD")
        .when(key.rlike(java(_phrases(C.PUBLIC_INSTITUTIONS))), "PUBLIC_INSTITUTION_PHRASE")
        .when(key.rlike(java(_phrases(C.SCIENTIFIC_NAMES))), "SCIENTIFIC_NAME")
        .when((label == "NER_PERSON") & collapsed.rlike(C.LATIN_BINOMIAL), "SCIENTIFIC_NAME")
    )


def single_token_person(text: Column, start: Column, value: Column) -> Column:
    """A one-word person without a title before it."""
    words = F.regexp_count(value, F.lit(java(r"\w+")))
    return (words < 2) & ~S.before(text, start, C.TITLE_CONTEXT_CHARS).rlike(java(C.PERSON_TITLE, True))


def safe_term(label: Column, value: Column, min_length: int = 4, min_person_words: int = 2) -> Column:
    """Whether a value may be searched for as exact text."""
    plain = (F.length(value) >= min_length) & ~value.rlike(r"[\[\]]") & value.rlike(r"[\p{L}\p{N}]")
    return plain & ((label != "NER_PERSON") | (F.regexp_count(value, F.lit(java(r"\w+"))) >= min_person_words))


def redaction_plan(found: DataFrame, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(distinct safe (doc_id, label, value), skipped (doc_id, label, n)) of rows (doc_id, label, value)."""
    rows = found.filter(F.col("label").isin(*allowed)).select("doc_id", "label", F.trim("value").alias("value"))
    ok = safe_term(F.col("label"), F.col("value"))
    return rows.filter(ok).distinct(), rows.filter(~ok).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


# --- two-pass resolution: sequential by meaning, one document at a time


def _titlecase(word: str) -> bool:
    return len(word) > 1 and word.isalpha() and word[0].isupper() and word[1:].islower()


_BREAK = re.compile(r"([^\W\d_]*)[ \t\r]*\n[ \t\r]*(?=([^\W\d_]*))")


def analysis_text(text: str, bridged: bool) -> str:
    """The text as the model sees it, of the same length: plain blanks and dashes, and in the bridged form line breaks inside names
    as blanks."""
    plain = text.translate({0xA0: " ", **{ord(d): "-" for d in C.DASHES}})
    if not bridged:
        return plain
    breaks = [m.end() - len(m[0]) + m[0].index("\n") for m in _BREAK.finditer(text) if _titlecase(m[1]) and _titlecase(m[2])]
    chars = list(plain)
    for b in breaks:
        chars[b] = " "
    return "".join(chars)


def _key(value: str) -> str:
    return " ".join(re.sub(r"\s*-\s*", "-", value.translate({ord(d): "-" for d in C.DASHES})).split()).casefold()


def _excluded(value: str, label: str) -> str | None:
    key, collapsed = _key(value), " ".join(value.split())
    if not key:
        return None
    if python(C.VERSION_LIKE, True).fullmatch(collapsed):
        return "VERSION_LIKE"
    if key in C.ORDINARY_WORDS:
        return "ORDINARY_WORD"
    if python(_phrases(C.PUBLIC_INSTITUTIONS)).search(key):
        return "PUBLIC_INSTITUTION_PHRASE"
    if python(_phrases(C.SCIENTIFIC_NAMES)).search(key) or label == "NER_PERSON" and python(C.LATIN_BINOMIAL).search(collapsed):
        return "SCIENTIFIC_NAME"
    return None


_LEFT = re.compile(r"(?<![^\W\d_])([^\W\d_]+)[ \t]+$")


def widened(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> int:
    """A person's start, moved to a capitalised word before it on the same line."""
    own = re.match(r"[^\W\d_]*", text[start:end])[0]
    m = _LEFT.search(text, max(0, start - 200), start)
    usable = m and _titlecase(own) and _titlecase(m[1]) and not {_key(own), _key(m[1])} & set(C.SCIENTIFIC_NAMES)
    return m.start() if usable and not any(m.start() < b and start > a for a, b in taken) else start


def resolve(text: str, entities: list[tuple[str, int, int, int, str]]) -> Iterator[tuple[int, int, str, str | None]]:
    """(start, end, label, exclusion or None) of (pass, ord, start, end, label): bridged entities that cross a line come first; what
    overlaps a placeholder or an accepted entity is dropped before it could count as excluded."""
    marks = [m.span() for m in python(C.NER_PLACEHOLDER).finditer(text)]
    accepted: list[tuple[int, int]] = []
    done: set[tuple[int, int]] = set()
    bridges = analysis_text(text, True) != analysis_text(text, False)
    for which, _, start, end, label in sorted(entities, key=lambda e: (e[0] != "bridged", e[1])):
        if not 0 <= start < end <= len(text) or not text[start:end].strip():
            continue
        crossing = "\n" in text[start:end]
        if which == "bridged" and not (crossing and bridges) or (start, end) in done:
            continue
        done.add((start, end))
        if label == "NER_PERSON":
            start = widened(text, start, end, marks)
        if any(start < b and end > a for a, b in marks + accepted):
            continue
        why = _excluded(text[start:end], label)
        title = python(C.PERSON_TITLE, True).search(text[max(0, start - C.TITLE_CONTEXT_CHARS) : start])
        if not why and label == "NER_PERSON" and len(re.findall(r"\w+", text[start:end])) < 2 and not title:
            why = "SINGLE_TOKEN_PERSON_SKIPPED"
        if not why and crossing and label != "NER_PERSON":
            why = "LINEBREAK_NON_PERSON_SKIPPED"
        if not why:
            accepted.append((start, end))
        yield start, end, label, why


#: Tasks for each core that entities are resolved in.
TASKS = 4


def resolved(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (doc_id, start, end, label, exclusion); entities of one document meet by doc_id."""
    labelled = entities.withColumn("label", internal_label(F.col("model_label"))).filter("label is not null")
    grouped = labelled.groupBy("doc_id").agg(F.collect_list(F.struct("pass", "ord", "start", "end", "label")).alias("entities"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows = [(e["pass"], e["ord"], e["start"], e["end"], e["label"]) for e in found]
                out += [(doc, *x) for x in resolve(text or "", rows)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "start", "end", "label", "exclusion"])

    # so many tasks however few bytes the rows have: the work is in Python, and small partitions would be put together
    met = docs.select("doc_id", "text").join(grouped, "doc_id").select("doc_id", "text", "entities")
    return met.repartition(TASKS * met.sparkSession.sparkContext.defaultParallelism, "doc_id").mapInArrow(each, "doc_id long, start int, end int, label string, exclusion string")


def zero_filled(found: DataFrame, labels: tuple[str, ...] = C.NER_LABELS) -> DataFrame:
    """Rows (label, n) for every label, found or not."""
    dim = found.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return dim.join(found.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


STATUSES = ("available", "unavailable", "dependency_missing", "model_missing", "disabled", "processing_error")


def masked(docs: DataFrame, found: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (doc_id, masked, redacted, detected): accepted entities replaced; counters of what was replaced and of all that was found."""
    ok = found.filter("exclusion is null")
    spans = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), "label")))
    rows = docs.select("doc_id", "text").join(ok.groupBy("doc_id").agg(spans.alias("all")), "doc_id", "left")
    every = F.coalesce("all", S.empty("array<struct<s:int,e:int,label:string>>"))
    kept = every if allowed is None else F.filter(every, lambda x: x["label"].isin(*allowed))
    count = lambda a: F.map_from_entries(F.transform(F.array(*[F.lit(x) for x in C.NER_LABELS]), lambda k: F.struct(k, F.size(F.filter(a, lambda x: x["label"] == k)))))
    return rows.select("doc_id", S.spliced(F.col("text"), kept, lambda x: F.concat(F.lit("["), x["label"], F.lit("]"))).alias("masked"), count(kept).alias("redacted"), count(every).alias("detected"))


def metadata(status: str, found: DataFrame) -> DataFrame:
    """One row (status, counters, exclusions): zero-filled over the closed enumerations; an unknown status is 'unavailable'."""
    fill = lambda names, counted: F.map_from_entries(F.transform(F.array(*[F.lit(x) for x in names]), lambda k: F.struct(k, F.coalesce(F.try_element_at(counted, k), F.lit(0)))))
    kinds = found.groupBy(F.coalesce("exclusion", "label").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    one = kinds.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return one.select(F.lit(status if status in STATUSES else "unavailable").alias("status"), fill(C.NER_LABELS, F.col("m")).alias("counters"), fill(EXCLUSIONS, F.col("m")).alias("exclusions"))
