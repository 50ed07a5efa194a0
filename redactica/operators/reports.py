"""Texts for people: reports, batch summaries, checklists and the note on manual edits. They hold labels, counts and positions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions.ranks import running
from redactica.operators import review

NOTE_BEGIN, NOTE_END = "--- manual edits ---", "--- end of manual edits ---"


def counter_lines(counters: Column, order: tuple[str, ...] = (*C.LABELS, *C.NER_LABELS)) -> Column:
    """Lines `* LABEL: n` of a map: the given order first, then the others by name; `* none: 0` without any. Negative counts raise."""
    first = F.filter(F.array(*[F.lit(x) for x in order]), lambda k: F.map_contains_key(counters, k))
    labels = F.concat(first, F.array_sort(F.array_except(F.map_keys(counters), F.array(*[F.lit(x) for x in order]))))
    count = lambda k: F.element_at(counters, k)
    line = lambda k: F.concat(F.lit("* "), k, F.lit(": "), F.when(count(k) < 0, F.raise_error(F.lit("negative count")).cast("string")).otherwise(count(k).cast("string")))
    return F.when(F.coalesce(F.size(counters), F.lit(0)) <= 0, "* none: 0").otherwise(F.array_join(F.transform(labels, line), "\n"))


def report(status: Column, ext: Column, counters: Column, risk: Column, findings: Column) -> Column:
    """One document's report."""
    lines = [F.lit("Masking report\n"), F.concat(F.lit("Status: "), status), F.concat(F.lit("Input type: "), ext), F.lit("\nMasked:"), counter_lines(counters), F.lit("\nLeft over:"), counter_lines(findings, C.AUDIT_LABELS), F.concat(F.lit("Risk level: "), risk), F.lit("\nManual review required: yes\nSource values stored: no\n")]
    return F.concat_ws("\n", *lines)


#: Characters of one part of a batch's text, about.
PART_CHARS = 1 << 16


def in_parts(lines: DataFrame, order: list, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (batch, part, text) of lines (batch, line, columns of `order`): a batch's text in parts, which follow each other with a line
    break between them. Where a line stands is the sum of the lengths before it, so no batch is in one task or cell."""
    placed = running(lines, ["batch"], order, "at", F.length("line") + 1)
    rows = placed.groupBy("batch", F.floor(F.col("at") / part_chars).alias("bin")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    numbered = running(rows.select("batch", "bin", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text")), ["batch"], ["bin"], "part")
    return numbered.select("batch", F.col("part").cast("int").alias("part"), "text")


def _headed(heads: DataFrame, lines: DataFrame) -> DataFrame:
    return heads.withColumns({"first": F.lit(0), "rank": F.lit(0), "position": F.lit(0).cast("long")}).unionByName(lines.withColumn("first", F.lit(1)))


def batch_report(files: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (batch, part, text): one summary of each batch, in parts, of files (batch, position, name, error, risk_level, masked)."""
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("error, "), "error")).otherwise(F.concat(F.lit("ok, risk "), "risk_level", F.lit(", masked "), F.col("masked").cast("string")))
    lines = files.select("batch", F.lit(0).alias("rank"), F.col("position").cast("long").alias("position"), F.concat(F.lit("* "), review.safe_name(F.col("name")), F.lit(": "), said).alias("line"))
    counts = files.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("ok"))
    head = F.concat(F.lit("Files: "), F.col("n").cast("string"), F.lit("\nDone: "), F.col("ok").cast("string"), F.lit("\nFailed: "), (F.col("n") - F.col("ok")).cast("string"))
    return in_parts(_headed(counts.select("batch", head.alias("line")), lines), ["first", "rank", "position"], part_chars)


def batch_checklist(files: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (batch, part, text): what to review of a batch, in parts, the riskiest first, and how many files failed; of files as
    batch_report takes them."""
    line = F.concat(F.lit("[ ] "), review.safe_name(F.col("name")), F.lit(" (risk: "), F.coalesce("risk_level", F.lit("unknown")), F.lit(")"))
    lines = files.filter("error is null").select("batch", review.risk_rank(F.col("risk_level")).alias("rank"), F.col("position").cast("long").alias("position"), line.alias("line"))
    counts = files.groupBy("batch").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad"))
    head = F.concat(F.lit("Review: "), F.col("ok").cast("string"), F.lit(", failed: "), F.col("bad").cast("string"))
    return in_parts(_headed(counts.select("batch", head.alias("line")), lines), ["first", "rank", "position"], part_chars)


def checklist(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text): tasks and first positions of placeholders, of rows (doc_id, text: masked, counters, findings, is_pdf)."""
    labels = F.map_keys(F.map_filter("counters", lambda _, n: n > 0))
    left = F.map_keys(F.map_filter("findings", lambda _, n: n > 0))
    tasks = F.array_join(F.transform(review.review_tasks(labels, left, F.col("is_pdf")), lambda t: F.concat(F.lit("[ ] "), t)), "\n")
    places = review.placeholder_positions(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "label", "line_no"))), lambda x: F.concat(x["label"], F.lit(" line "), x["line_no"].cast("string"))), "\n").alias("places"))
    return docs.select("doc_id", tasks.alias("tasks")).join(places, "doc_id", "left").select("doc_id", F.concat_ws("\n", F.lit("Review"), "tasks", "places").alias("text"))


def with_manual_note(text: Column, n: Column) -> Column:
    """A report whose note on manual edits says n; the note is replaced in place of an older one's, and gone for 0."""
    bare = F.regexp_replace(text, rf"\n*{NOTE_BEGIN}\n[\s\S]*?{NOTE_END}\n?", "\n")
    bare = F.concat(F.regexp_replace(bare, r"\n+$", ""), F.lit("\n"))
    note = F.concat(F.lit(f"\n{NOTE_BEGIN}\n* hidden by hand: "), n.cast("string"), F.lit(f"\n{NOTE_END}\n"))
    return F.when(n > 0, F.concat(bare, note)).otherwise(bare)
