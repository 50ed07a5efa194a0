"""Review workflow: output catalogue, pairing, priorities, statuses, placeholder census, clean-up plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions.ranks import running
from redactica.functions.regex import java


def classified(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds family, stem, grp and generation to files that the engine wrote; others drop. The first matching family counts. A number
    beyond 64 bits is none that the engine gives, so such a file drops as well."""
    family, stem, number = (F.lit(None).cast("string"),) * 3
    for key, pattern in reversed(C.OUTPUT_FAMILIES.items()):
        hit, batch = F.col(name).rlike(pattern), key.startswith("batch_")
        family = F.when(hit, key).otherwise(family)
        stem = F.when(hit, F.lit(None) if batch else F.regexp_extract(name, pattern, 1)).otherwise(stem)
        number = F.when(hit, F.regexp_extract(name, pattern, 1 if batch else 2)).otherwise(number)
    rows = files.withColumns({"family": family, "stem": stem, "number": number}).filter("family is not null")
    return rows.withColumns({"grp": F.concat_ws("|", "stem", "family"), "generation": F.when(F.col("number") == "", 1).otherwise(F.expr("try_cast(substring(number, 2) as bigint)"))}).filter("generation is not null")


def superseded(files: DataFrame, *folder: str) -> DataFrame:
    """Adds `removable`: whether a newer generation of the same group exists in the folder."""
    w = Window.partitionBy(*folder, "grp")
    return files.withColumn("removable", F.col("generation") < F.max("generation").over(w))


def history_plan(files: DataFrame) -> DataFrame:
    """Rows (kind, files, bytes): final results and working files, each path once."""
    kind = F.when(F.col("family").isin(*C.FINAL_FAMILIES), "final").otherwise("working")
    return files.dropDuplicates(["folder", "name"]).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def size_text(size: Column) -> Column:
    mb = size / (1024 * 1024)
    return F.when(mb >= 0.1, F.format_string("%.1f MB", F.bround(mb, 1))).otherwise(F.format_string("%d KB", F.greatest(F.lit(1), F.round(size / 1024).cast("int"))))


def file_name_pii(name: Column) -> Column:
    """Kinds of personal data visible in a file name's stem, in order."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.array_compact(F.array(*[F.when(stem.rlike(java(p)), k) for k, p in C.FILE_NAME_PII.items()]))


def safe_name(value: Column) -> Column:
    """The last part of a path of either kind; 'unknown' if there is none."""
    part = F.regexp_extract(F.trim(value), r"[^/\\]*$", 0)
    return F.when(F.coalesce(part, F.lit("")) == "", "unknown").otherwise(part)


def paired_reports(outputs: DataFrame, reports: DataFrame) -> DataFrame:
    """Adds `report` to outputs (folder, name, stem, number): the one of the same number, else the plain one, else the only one."""
    r = reports.select("folder", "stem", F.col("name").alias("report"), F.col("number").alias("report_number"))
    rank = F.when(F.col("report_number") == F.col("number"), 1).when(F.col("report_number") == "", 2).when(F.count("report").over(Window.partitionBy("folder", "name")) == 1, 3)
    rows = outputs.join(r, ["folder", "stem"], "left").withColumn("rank", rank)
    best = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "report")))
    return rows.groupBy("folder", "name").agg(best["report"].alias("report"))


def preferred_artefact(outputs: DataFrame, files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Adds `artefact`: of a text output the first of visual, original-layout and review PDF of the same stem and number, then, of the
    listing (folder, name), the PDF that is named like the output itself, as older versions wrote it. Else, and for other kinds, itself."""
    place = F.array_position(F.array(*[F.lit(x) for x in ("visual", "original_redacted", "review")]), F.col("family"))
    pdf = files.filter(F.col("family").isin("visual", "original_redacted", "review")).groupBy("folder", "stem", "number").agg(F.min_by("name", place).alias("pdf"))
    rows = outputs.join(pdf, ["folder", "stem", "number"], "left")
    found = F.col("pdf")
    if listing is not None:
        like = listing.select("folder", F.col("name").alias("old")).filter(F.col("old").endswith(".pdf")).distinct()
        rows = rows.withColumn("old", F.regexp_replace("name", r"\.txt$", ".pdf")).join(like.withColumn("there", F.lit(True)), ["folder", "old"], "left")
        found = F.coalesce(found, F.when(F.col("there"), F.col("old")))
    is_text = F.col("family") == "anon_txt"
    return rows.withColumn("artefact", F.when(is_text & found.isNotNull(), found).otherwise(F.col("name"))).drop("pdf", "old", "there")



def risk_rank(risk: Column) -> Column:
    return F.when(risk == "high_risk", 0).when(risk == "warning", 1).when(risk == "ok", 2).otherwise(3)


def prioritised(items: DataFrame) -> DataFrame:
    """Adds `place`: high risk first, then warnings, ok and unknown, by lower-cased name within each workspace."""
    placed = running(items, ["workspace"], [risk_rank(F.col("risk_level")), F.lower("output_name"), "output_name"], "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))


def batch_priorities(files: DataFrame) -> DataFrame:
    """Files of a batch (batch, position, name, error, risk_level) that succeeded, with their place: by risk, then as they came in."""
    placed = running(files.filter("error is null"), ["batch"], [risk_rank(F.col("risk_level")), "position"], "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))


def with_status(items: DataFrame, statuses: DataFrame) -> DataFrame:
    """Items with their stored status; 'needs_review' where there is none or it is unknown."""
    known = statuses.filter(F.col("status").isin(*C.REVIEW_STATUSES)).select("output_name", "status")
    return items.drop("status").join(known, "output_name", "left").withColumn("status", F.coalesce("status", F.lit("needs_review")))


def workspace_summary(items: DataFrame) -> DataFrame:
    """Per workspace: items, one count per status, and whether review is complete (items, none waiting)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in C.REVIEW_STATUSES]
    return items.groupBy("workspace").agg(F.count(F.lit(1)).alias("items"), *counts).withColumn("completed", F.col("needs_review") == 0)


def restricted(items: DataFrame, fresh: DataFrame) -> DataFrame:
    """Items of a fresh batch only, their status back to the default."""
    return items.join(fresh.select("output_name"), "output_name", "left_semi").withColumn("status", F.lit("needs_review"))


_LINES = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def page_census(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (doc_id, page, label, n): placeholders on each page, numbered from 1; for texts that are split into pages."""
    pages = docs.select("doc_id", F.posexplode(F.split(text_col, C.PAGE_SEPARATOR, -1)).alias("k", "t"))
    found = pages.select("doc_id", (F.col("k") + 1).alias("page"), F.explode(F.regexp_extract_all("t", F.lit(C.PLACEHOLDER), F.lit(0))).alias("label"))
    return found.groupBy("doc_id", "page", "label").agg(F.count(F.lit(1)).alias("n"))


def placeholder_census(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (doc_id, line_no, label, n): placeholders on each line that is not blank."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_col, _LINES, -1)).alias("k", "line")).filter(~F.col("line").rlike(java(r"^\s*$")))
    found = lines.select("doc_id", (F.col("k") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(C.PLACEHOLDER), F.lit(0))).alias("label"))
    return found.groupBy("doc_id", "line_no", "label").agg(F.count(F.lit(1)).alias("n"))


def placeholder_positions(docs: DataFrame, most: int = 4, text_col: str = "text") -> DataFrame:
    """Rows (doc_id, label, line_no): the first few placeholders of each document, by position only."""
    from redactica.functions import spans as S

    text = F.col(text_col)
    first = F.slice(S.spans(text, C.PLACEHOLDER), 1, most)
    rows = docs.select("doc_id", F.posexplode(F.transform(first, lambda x: F.struct(S.value(text, x).alias("label"), (S.line_of(text, x["s"]) + 1).alias("line_no")))).alias("k", "x"))
    return rows.select("doc_id", (F.col("k") + 1).alias("example"), "x.label", "x.line_no")


def review_tasks(has: Column, audit: Column, is_pdf: Column) -> Column:
    """The tasks of a checklist: has is the array of masked labels, audit that of residual findings."""
    any_of = lambda *x: F.arrays_overlap(has, F.array(*[F.lit(v) for v in x]))
    order = F.array(*[F.lit(x) for x in ("POSTAL_CODE", "ADDRESS_LIKE", "STREET_LIKE", "ID_LIKE_NUMBER", "LONG_NUMBER_SEQUENCE")])
    warned = F.filter(order, lambda x: F.array_contains(audit, x))
    tasks = F.array_compact(F.array(F.when(any_of("EMAIL", "TELEFON"), "contacts"), F.when(any_of("NER_PERSON", "PERSON_NAME_TYPO"), "persons"), F.when(any_of("NER_ORG", "NER_LOCATION"), "organisations_locations"), F.when(F.size(warned) > 0, F.concat(F.lit("audit: "), F.array_join(warned, ", "))), F.when(is_pdf, "text_order")))
    return F.when(F.size(tasks) == 0, F.array(F.lit("output_and_report"))).otherwise(tasks)


def parsed_report(text: Column) -> tuple[Column, Column]:
    """(risk level or null, array of 'label: n' entries with n > 0) of a report's text."""
    risk = F.nullif(F.regexp_extract(text, r"(?m)^Risk level:\s*(ok|warning|high_risk)\s*$", 1), F.lit(""))
    return risk, F.regexp_extract_all(text, F.lit(r"(?m)^\* ([A-Z_]+: [1-9][0-9]*)$"), F.lit(1))


def workspace(listing: DataFrame, reports: DataFrame) -> DataFrame:
    """Items of review folders: rows (workspace, output_name, report_name, risk_level, status).

    listing has (folder, sub, name), sub being '' or 'txt'; a name in txt hides its flat twin. reports has (folder, name, text)."""
    files = classified(listing).filter(F.col("family").isin("anon_txt", "anon_docx"))
    w = Window.partitionBy("folder", "name").orderBy(F.when(F.col("sub") == "txt", 0).otherwise(1))
    outputs = files.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    known = classified(reports).filter("family = 'report'")
    paired = paired_reports(outputs, known)
    risk = parsed_report(F.col("text"))[0]
    risks = known.select("folder", F.col("name").alias("report"), risk.alias("risk_level"))
    rows = paired.join(risks, ["folder", "report"], "left")
    return rows.select(F.col("folder").alias("workspace"), F.col("name").alias("output_name"), F.col("report").alias("report_name"), "risk_level", F.lit("needs_review").alias("status"))


def newest_folder(folders: DataFrame) -> DataFrame:
    """Rows (root, folder): of dated folders (root, folder) the one with the latest calendar date."""
    day = F.try_to_date("folder", "d.M.yyyy")
    return folders.filter(F.col("folder").rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$") & day.isNotNull()).groupBy("root").agg(F.max_by("folder", day).alias("folder"))
