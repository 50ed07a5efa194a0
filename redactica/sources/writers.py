"""Sinks: masked text, reports, checklists, manifests, exports and collision-safe names. All write through Spark's committers, or those of `named`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions.ranks import running
from redactica.operators import reports, review, rollup
from redactica.sources import named
from redactica.sources.scratch import stored


def masked_table(masked: DataFrame, path: str) -> None:
    """The masked corpus as Parquet, one row per document."""
    masked.write.mode("errorifexists").parquet(path)


def masked_names(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds `number` and `name` to documents (folder, stem, ext): <stem>_ANON.docx for DOCX, else txt/<stem>_ANON.txt, the documents of
    one stem taking, in order, the numbers that no companion in the folder's listing has. A stem may have very many documents."""
    families = ("anon_txt", "anon_docx", "report", "checklist")
    order = [c for c in ("position", "ext", "doc_id") if c in docs.columns]
    ranked = running(docs, ["folder", "stem"], order, "_rank")
    taken = review.classified(listing).filter(F.col("family").isin(*families)).select("folder", "stem", "generation").distinct()
    # so many numbers below a taken one are free
    holes = running(taken, ["folder", "stem"], ["generation"], "_j").select("folder", "stem", (F.col("generation") - 1 - F.col("_j")).alias("_rank"))
    both = ranked.withColumn("_taken", F.lit(0)).unionByName(holes.withColumn("_taken", F.lit(1)), allowMissingColumns=True)
    counted = running(both, ["folder", "stem"], ["_rank", F.desc("_taken")], "_below", F.col("_taken")).filter("_taken = 0")
    rows = counted.withColumn("number", F.col("_rank") + 1 + F.col("_below"))
    suffix = F.when(F.col("number") == 1, "").otherwise(F.concat(F.lit("_"), F.col("number").cast("string")))
    name = F.when(F.col("ext") == "docx", output_name(F.col("stem"), "anon_docx", suffix)).otherwise(F.concat(F.lit("txt/"), output_name(F.col("stem"), "anon_txt", suffix)))
    return rows.withColumn("name", name).select(*docs.columns, "number", "name")


def masked_files(masked: DataFrame, listing: DataFrame, folder: str) -> DataFrame:
    """Writes masked documents (folder, stem, ext, text, content) under their names: the text, or for DOCX the masked copy in `content`."""
    bytes_ = F.when(F.col("ext") == "docx", F.col("content")).otherwise(F.encode("text", "UTF-8"))
    return named.write(stored(masked_names(masked, listing).select("name", bytes_.alias("content")), "named"), folder)


def output_name(stem: Column, family: str, suffix: Column) -> Column:
    tail = {"anon_txt": "_ANON%s.txt", "anon_docx": "_ANON%s.docx", "visual": "_ANON_VISUAL%s.pdf", "review": "_ANON_REVIEW%s.pdf", "original_redacted": "_ORIGINAL_REDACTED%s.pdf", "report": "_RAPORT%s.txt", "checklist": "_REVIEW_CHECKLIST%s.txt", "manual_edits": "_MANUAL_EDITS%s.json"}[family]
    return F.concat(stem, F.format_string(tail, suffix))


def free_suffix(stems: DataFrame, listing: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Rows (folder, stem, suffix): the first of '', _2, _3, ... that is free for every companion at once.

    Taken numbers are gathered per stem, so only stems with collisions carry any."""
    taken = review.classified(listing).filter(F.col("family").isin(*families)).groupBy("folder", "stem").agg(F.collect_set("generation").alias("taken"))
    rows = stems.select("folder", "stem").distinct().join(taken, ["folder", "stem"], "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), (F.coalesce(F.size("taken"), F.lit(0)) + 1).cast("long")), F.coalesce("taken", F.expr("cast(array() as array<bigint>)"))))
    return rows.select("folder", "stem", F.when(free == 1, "").otherwise(F.concat(F.lit("_"), free.cast("string"))).alias("suffix"))


def dated_folder(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def parsed_folder(name: Column) -> Column:
    """The date of a dated folder, null for other names and impossible dates."""
    return F.when(name.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.try_to_date(name, "d.M.yyyy"))


def report_lines(counters: DataFrame) -> DataFrame:
    """Rows (doc_id, report): categories in fixed order, the others by name, one line each."""
    rank = F.array_position(F.array(*[F.lit(x) for x in (*C.LABELS, *C.NER_LABELS)]), F.col("label"))
    line = F.struct(F.when(rank > 0, rank).otherwise(999).alias("r"), F.col("label"), F.concat(F.lit("* "), F.col("label"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    return rollup.merged(counters, "doc_id").groupBy("doc_id").agg(body.alias("report"))


def manifest(items: DataFrame) -> DataFrame:
    """Rows (workspace, json): items by name, and the summary."""
    one = F.struct("output_name", "report_name", "risk_level", "status")
    rows = items.groupBy("workspace").agg(F.array_sort(F.collect_list(one)).alias("items"), F.count(F.lit(1)).alias("item_count"))
    return rows.select("workspace", F.to_json(F.struct("item_count", "items")).alias("json"))


def approved_export(items: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts of approved items, approved items without a report)."""
    ok = items.filter("status = 'approved'")
    return texts.join(ok.select("output_name"), "output_name", "left_semi"), ok.filter("report_name is null").select("workspace", "output_name")


def approved_batch(items: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to write, rows (workspace, name, content); the index of each workspace, rows (workspace, part, text)) of items (workspace,
    output_name, report_name, artefact, status, risk_level) and the files that there are (workspace, name, content).

    Of each approved item go the masked text and the report, into the folder of texts, and the companion that shows the document, if it
    is another file. The index names files and says what is missing; it holds no text and no path of a source."""
    ok = items.filter("status = 'approved'").select("workspace", "output_name", "report_name", "artefact", "risk_level").distinct()
    kinds = F.array(F.struct(F.col("output_name").alias("name"), F.lit("text").alias("kind")), F.struct(F.col("report_name").alias("name"), F.lit("report").alias("kind")), F.struct(F.when(F.col("artefact") != F.col("output_name"), F.col("artefact")).alias("name"), F.lit("companion").alias("kind")))
    wanted = ok.select("workspace", "output_name", "risk_level", F.explode(kinds).alias("f")).select("workspace", "output_name", "risk_level", "f.*").filter("name is not null")
    there = stored(wanted.join(files.select("workspace", "name").distinct(), ["workspace", "name"], "left_semi"), "approved")
    copied = files.join(there.select("workspace", "name", "kind"), ["workspace", "name"])
    place = F.when(F.col("kind") == "companion", F.col("name")).otherwise(F.concat(F.lit("txt/"), "name"))
    texts, reports_ = there.filter("kind = 'text'"), there.filter("kind = 'report'")
    missing = texts.join(reports_.select("workspace", "output_name"), ["workspace", "output_name"], "left_anti")

    counts = ok.select("workspace").distinct()
    for name, rows in (("files", texts), ("reports", reports_), ("missing", missing)):
        counts = counts.join(rows.groupBy("workspace").agg(F.count(F.lit(1)).alias(name)), "workspace", "left")
    counts = counts.fillna(0, ["files", "reports", "missing"])
    said = lambda label, n: F.concat(F.lit(f"{label}: "), F.col(n).cast("string"))
    none = lambda n: F.when(F.col(n) == 0, F.lit("* none"))
    fixed = [
        (0, F.lit("Approved files")), (1, said("Files", "files")), (2, said("Reports", "reports")), (3, said("Missing reports", "missing")), (4, F.lit("Approved by hand; no source, and nothing that was not approved, is here.")),
        (10, F.lit("Texts:")), (11, none("files")), (20, F.lit("Reports copied:")), (21, none("reports")), (30, F.lit("Without a report:")), (31, none("missing")), (40, F.lit("Texts of documents: none")), (41, F.lit("Paths of sources: none")), (42, F.lit("Terms of dictionaries: none")),
    ]
    lines = counts.select(F.col("workspace").alias("batch"), F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.lit("").alias("name"), line.alias("line")) for k, line in fixed])).alias("x")).select("batch", "x.*").filter("line is not null")
    for section, rows, line in ((11, texts, F.concat(F.lit("* "), "output_name", F.lit("\n  risk: "), F.coalesce("risk_level", F.lit("unknown")))), (21, reports_, F.concat(F.lit("* "), "name")), (31, missing, F.concat(F.lit("* "), "output_name"))):
        lines = lines.unionByName(rows.select(F.col("workspace").alias("batch"), F.lit(section).alias("section"), "name", line.alias("line")))
    index = reports.in_parts(lines, ["section", "name"]).withColumnRenamed("batch", "workspace")
    return copied.select("workspace", place.alias("name"), "content"), index


def knowledge_index(chunks: DataFrame, path: str) -> None:
    chunks.select("source_file", "chunk_id", "chunk_index", "text").write.mode("errorifexists").parquet(path)
