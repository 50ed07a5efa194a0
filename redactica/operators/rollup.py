"""Roll-ups: counters, histograms over closed enumerations, coverage of a redacted output."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions.ranks import running


def merged(counters: DataFrame, *keys: str) -> DataFrame:
    """Sums n by label (and keys); positive sums only. Partial sums form before the shuffle."""
    return counters.groupBy(*keys, "label").agg(F.sum("n").alias("n")).filter("n > 0")


def histogram(rows: DataFrame, column: str, values: Iterable[str], unknown: str | None = None) -> DataFrame:
    """Rows (value, n) for every value of an enumeration, zero-filled; other values count as `unknown`."""
    known = list(values)
    value = F.when(F.col(column).isin(*known), F.col(column)).otherwise(F.lit(unknown))
    counted = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dim = rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys([*known, *([unknown] if unknown else [])])], "value string")
    return dim.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def error_text(kind: Column) -> Column:
    """The closed description of a failure's kind; nothing of its message gets out."""
    known = {
        "unsupported": "unsupported file type", "empty_pdf": "PDF has no extractable text", "decode": "TXT file could not be decoded as UTF-8",
        "io": "file could not be read or written", "dependency": "required local document dependency is unavailable",
        "ocr_unavailable": "OCR unavailable for image-based input", "ocr_failed": "OCR failed for image-based input",
    }
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(names, kind), F.lit("file processing failed")))


def batch_summary(files: DataFrame) -> DataFrame:
    """One row (input_count, success_count, error_count, total_masked) of files (error_kind, masked)."""
    return files.agg(F.count(F.lit(1)).alias("input_count"), F.count_if(F.col("error_kind").isNull()).alias("success_count"), F.count_if(F.col("error_kind").isNotNull()).alias("error_count"), F.coalesce(F.sum("masked"), F.lit(0)).alias("total_masked"))


def batch_result(files: DataFrame, counters: DataFrame, findings: DataFrame, statuses: Iterable[str], risks: Iterable[str] = C.RISK_LEVELS) -> DataFrame:
    """One row per batch: input_count, success_count, error_count, total_masked, and the maps counters, findings (label to sum), errors
    (text to files), risks and ner (value to files, zero-filled). The files themselves are rows: batch_files.

    files has (batch, doc_id, position, name, error, risk_level, ner_status, masked); counters and findings have (batch, label, n).
    An unknown status of the entity recogniser counts as 'unavailable'. Maps form from sums by key, so only one small row per key
    meets."""
    known = [*dict.fromkeys([*statuses, "unavailable"])]
    ner = F.when(F.col("ner_status").isin(*known), F.col("ner_status")).otherwise("unavailable")

    def sums(rows: DataFrame, name: str) -> DataFrame:
        pairs = rows.groupBy("batch", "key").agg(F.sum("n").alias("n")).filter("n > 0")
        return pairs.groupBy("batch").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))

    def zeros(values: Iterable[str], name: str) -> Column:
        keys = F.array(*[F.lit(v) for v in values])
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.col(name), k), F.lit(0)))).alias(name)

    counts = files.groupBy("batch").agg(F.count(F.lit(1)).alias("input_count"), F.count_if(F.col("error").isNull()).alias("success_count"), F.count_if(F.col("error").isNotNull()).alias("error_count"), F.coalesce(F.sum("masked"), F.lit(0)).alias("total_masked"))
    per_file = {"errors": F.col("error"), "risks": F.when(F.col("error").isNull(), F.col("risk_level")), "ner": F.when(F.col("error").isNull(), ner)}
    maps = {"counters": counters.withColumnRenamed("label", "key"), "findings": findings.withColumnRenamed("label", "key")}
    maps |= {k: files.select("batch", c.alias("key"), F.lit(1).cast("long").alias("n")).filter("key is not null") for k, c in per_file.items()}
    for name, rows in maps.items():
        counts = counts.join(sums(rows, name), "batch", "left")
    none = F.expr("cast(map() as map<string,bigint>)")
    plain = [F.coalesce(name, none).alias(name) for name in ("counters", "findings", "errors")]
    return counts.select("batch", "input_count", "success_count", "error_count", "total_masked", *plain, zeros(risks, "risks"), zeros(known, "ner"))


def batch_files(files: DataFrame) -> DataFrame:
    """Rows (batch, place, position, name, error, risk_level, masked): the files of each batch, numbered from 1 in order of position."""
    rows = running(files.select("batch", "position", "name", "error", "risk_level", "masked"), ["batch"], ["position"], "place")
    return rows.withColumn("place", F.col("place") + 1)


def detected(counters: DataFrame, audit: DataFrame, ner: DataFrame) -> DataFrame:
    """Rows (doc_id, label, n): masked and residual findings add up; of named entities the larger count holds."""
    found = merged(counters.unionByName(audit), "doc_id")
    other = merged(ner, "doc_id").withColumnRenamed("n", "ner")
    return found.join(other, ["doc_id", "label"], "full").select("doc_id", "label", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("ner", F.lit(0))).alias("n"))


def coverage_gap(found: DataFrame, redacted: DataFrame, active: Iterable[str] | None = None, page_scoped: bool = False) -> DataFrame:
    """Detected labels (doc_id, label, n) that the output does not redact. With a page range there is no gap to tell."""
    if page_scoped:
        return found.limit(0)
    gap = found.filter("n > 0").join(redacted.filter("n > 0").select("doc_id", "label"), ["doc_id", "label"], "left_anti")
    return gap if active is None else gap.filter(F.col("label").isin(*active))


def upgraded_status(status: Column, has_gap: Column) -> Column:
    return F.when(has_gap & status.isin("completed", "no_matches"), "completed_with_warnings").otherwise(status)


def ordered(counters: DataFrame, order: Iterable[str] = (*C.LABELS, *C.NER_LABELS)) -> DataFrame:
    """Adds `place`: labels in the given order first, then the others by name."""
    known = list(order)
    rank = F.array_position(F.array(*[F.lit(x) for x in known]), F.col("label"))
    rank = F.when(rank > 0, rank).otherwise(len(known) + 1)
    return running(counters, [], [rank, "label"], "place").withColumn("place", (F.col("place") + 1).cast("int"))


def dictionary_result(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """Every label of a dictionary with its hits, 0 for none."""
    return labels.select("label").distinct().join(hits.groupBy("label").agg(F.sum("n").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
