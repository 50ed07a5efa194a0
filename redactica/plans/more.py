"""Further queries and their twins: scopes, statuses, sidecars, pairing, keys, answers. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import spans as S
from redactica.operators import cascade, detect, geometry, model_review, ner, reports, retrieval, review, rollup, scoring
from redactica.plans.fixtures import CURRENT_YEAR, notes
from redactica.plans.queries import MASKED, _chars, _fills, _index, _items, _rects, documents, per_label, query, table
from redactica.sources import readers, writers

P = "(SELECT p_partkey AS p FROM part)"


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))


@query("merged_counters", f"SELECT label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE p % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS label, CASE WHEN p % 3 = 2 THEN 0 ELSE p % 5 END AS n FROM {P}) GROUP BY label HAVING sum(n) > 0")
def merged_counters(spark, sf_dir):
    return rollup.merged(_part(spark, sf_dir).select(F.expr("case p % 3 when 0 then 'A' when 1 then 'B' else 'C' end").alias("label"), F.expr("case when p % 3 = 2 then 0 else p % 5 end").alias("n")))


@query("status_histogram", f"SELECT v.value, count(x.value) AS n FROM (SELECT unnest(['available', 'disabled', 'model_missing', 'unavailable']) AS value) v LEFT JOIN (SELECT CASE p % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'disabled' ELSE 'unavailable' END AS value FROM {P}) x ON v.value = x.value GROUP BY 1")
def status_histogram(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.expr("case p % 4 when 0 then 'available' when 1 then 'disabled' when 2 then 'odd' end").alias("status"))
    return rollup.histogram(rows, "status", ("available", "disabled", "model_missing"), unknown="unavailable")


@query("pdf_status", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN p % 3 = 0 THEN 'completed_with_warnings' WHEN p % 2 = 0 THEN 'no_matches' ELSE 'completed' END AS status FROM {P}) GROUP BY status")
def pdf_status(spark, sf_dir):
    rows = _part(spark, sf_dir).select(geometry.redaction_status(F.col("p") % 2, F.when(F.col("p") % 3 == 0, 1).otherwise(0)).alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("page_scope", f"SELECT p % 5 + 1 AS page, count(*) AS n FROM {P} WHERE p % 5 + 1 IN (1, 2, 4) GROUP BY 1")
def page_scope(spark, sf_dir):
    rows = _part(spark, sf_dir).select((F.col("p") % 5 + 1).alias("page"))
    return geometry.in_scope(rows, detect.active_pages("1-2, 4")).groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query("ner_scope", f"SELECT scope, count(*) AS n FROM (SELECT p % 4 AS k FROM {P}) JOIN (VALUES ('safe', 0), ('strict', 0), ('strict', 1), ('strict', 2), ('strict', 3), ('visual', 0), ('visual', 1), ('visual', 2)) v(scope, l) ON k = l GROUP BY scope")
def ner_scope(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(x) for x in C.NER_LABELS]), (F.col("p") % 4 + 1).cast("int"))
    scopes = F.array(*[F.when(label.isin(*labels), F.lit(scope)) for scope, labels in C.NER_SCOPES.items()])
    return _part(spark, sf_dir).select(F.explode(F.array_compact(scopes)).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("ner_masked", f"SELECT p AS doc_id, CASE WHEN p % 2 = 0 THEN '[NER_PERSON] w [NER_ORG].' ELSE 'Jan Nowak w Acme.' END AS masked FROM {P}")
def ner_masked(spark, sf_dir):
    docs = _part(spark, sf_dir).select(F.col("p").alias("doc_id"), F.lit("Jan Nowak w Acme.").alias("text"))
    pair = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("label")) for a, b, x in ((12, 16, "NER_ORG"), (0, 9, "NER_PERSON"))])
    found = docs.filter("doc_id % 2 = 0").select("doc_id", F.explode(pair).alias("e")).select("doc_id", "e.*", F.lit(None).cast("string").alias("exclusion"))
    return ner.masked(docs, found).select("doc_id", "masked")


@query("sidecars", f"SELECT count(*) FILTER (p % 3 = 0) AS good, count(*) FILTER (p % 3 <> 0) AS malformed FROM {P}")
def sidecars(spark, sf_dir):
    text = F.expr("""case p % 3 when 0 then '{"active_labels": ["PESEL"], "page_range": "1"}' when 1 then '{"active_labels": 3' else 'x' end""")
    side = _part(spark, sf_dir).select(readers.sidecar(text, "active_labels array<string>, page_range string").alias("s"))
    ok = F.coalesce(F.col("s.page_range") == "1", F.lit(False))
    return side.agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("malformed"))


@query("report_read", f"SELECT risk, count(*) AS n, CAST(sum(CASE WHEN p % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS categories FROM (SELECT p, CASE p % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' ELSE 'high_risk' END AS risk FROM {P}) GROUP BY risk")
def report_read(spark, sf_dir):
    p = _part(spark, sf_dir).select(F.expr("case p % 3 when 0 then 'ok' when 1 then 'warning' else 'high_risk' end").alias("risk"), F.expr("map('PESEL', 1L, 'NIP', if(p % 2 = 0, 4L, 0L))").alias("c"))
    none = F.expr("cast(map() as map<string,bigint>)")
    text = reports.report(F.lit("completed"), F.lit("txt"), F.col("c"), F.col("risk"), none)
    risk, found = review.parsed_report(F.col("t"))
    return p.select(text.alias("t")).groupBy(risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(found)).cast("long").alias("categories"))


@query("manual_note", f"SELECT CASE WHEN p % 3 = 0 THEN 0 ELSE 1 END AS notes, count(*) AS n FROM {P} GROUP BY 1")
def manual_note(spark, sf_dir):
    once = reports.with_manual_note(F.lit("Report\n* PESEL: 1\n"), F.lit(2))
    rows = _part(spark, sf_dir).select(reports.with_manual_note(once, (F.col("p") % 3).cast("int")).alias("t"))
    return rows.groupBy(F.regexp_count("t", F.lit("hidden by hand: [12]")).alias("notes")).agg(F.count(F.lit(1)).alias("n"))


@query("review_tasks", f"SELECT tasks, count(*) AS n FROM (SELECT CASE p % 3 WHEN 0 THEN 'contacts;persons' WHEN 1 THEN 'organisations_locations;audit: POSTAL_CODE, STREET_LIKE;text_order' ELSE 'output_and_report' END AS tasks FROM {P}) GROUP BY tasks")
def review_tasks(spark, sf_dir):
    k = F.col("p") % 3
    labels = F.when(k == 0, F.array(F.lit("EMAIL"), F.lit("NER_PERSON"))).when(k == 1, F.array(F.lit("NER_ORG"))).otherwise(F.array(F.lit("X")))
    left = F.when(k == 1, F.array(F.lit("STREET_LIKE"), F.lit("POSTAL_CODE"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = _part(spark, sf_dir).select(F.array_join(review.review_tasks(labels, left, k == 1), ";").alias("tasks"))
    return rows.groupBy("tasks").agg(F.count(F.lit(1)).alias("n"))


@query("preferred_artefact", f"SELECT concat('a', p, '_ANON.txt') AS name, CASE p % 3 WHEN 0 THEN concat('a', p, '_ANON_VISUAL.pdf') WHEN 1 THEN concat('a', p, '_ORIGINAL_REDACTED.pdf') ELSE concat('a', p, '_ANON.txt') END AS artefact FROM {P}")
def preferred_artefact(spark, sf_dir):
    names = F.expr("""case p % 3 when 0 then array('_ANON.txt', '_ANON_VISUAL.pdf', '_ANON_REVIEW.pdf', '_ORIGINAL_REDACTED.pdf') when 1 then array('_ANON.txt', '_ANON_REVIEW.pdf', '_ORIGINAL_REDACTED.pdf', '_ANON_VISUAL_2.pdf') else array('_ANON.txt') end""")
    files = review.classified(_part(spark, sf_dir).select(F.lit("f").alias("folder"), F.explode(F.transform(names, lambda x: F.concat(F.lit("a"), F.col("p").cast("string"), x))).alias("name")))
    return review.preferred_artefact(files.filter("family = 'anon_txt'"), files).select("name", "artefact")


@query("workspace_items", f"SELECT concat('a', p, '_ANON.txt') AS output_name, CASE WHEN p % 2 = 0 THEN 'warning' END AS risk_level FROM {P}")
def workspace_items(spark, sf_dir):
    p = _part(spark, sf_dir).select("p", F.lit("f").alias("folder"))
    listing = p.select("folder", F.explode(F.array(F.lit("txt"), F.lit(""))).alias("sub"), F.concat(F.lit("a"), F.col("p").cast("string"), F.lit("_ANON.txt")).alias("name"))
    found = p.filter("p % 2 = 0").select("folder", F.concat(F.lit("a"), F.col("p").cast("string"), F.lit("_RAPORT.txt")).alias("name"), F.lit("x\nRisk level: warning\n").alias("text"))
    return review.workspace(listing, found).select("output_name", "risk_level")


@query("restricted_items", f"SELECT count(*) AS n FROM {P} WHERE p % 4 = 1")
def restricted_items(spark, sf_dir):
    items = _items(spark, sf_dir)
    fresh = _part(spark, sf_dir).filter("p % 4 = 1").select(F.concat(F.lit("Akt"), F.col("p").cast("string"), F.lit("_ANON.txt")).alias("output_name"))
    return review.restricted(items, fresh).filter("status = 'needs_review'").agg(F.count(F.lit(1)).alias("n"))


@query("approved_export", f"SELECT 'exported' AS kind, count(*) AS n FROM {P} WHERE p % 4 = 1 UNION ALL SELECT 'without report', count(*) FROM {P} WHERE p % 8 = 1")
def approved_export(spark, sf_dir):
    items = _part(spark, sf_dir).select(F.lit("w").alias("workspace"), F.col("p").cast("string").alias("output_name"), F.expr("if(p % 8 = 1, null, 'r')").alias("report_name"), F.expr("if(p % 4 = 1, 'approved', 'rejected')").alias("status"))
    kept, missing = writers.approved_export(items, items.select("output_name"))
    count = lambda d, kind: d.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(kept, "exported").unionByName(count(missing, "without report"))


@query("newest_folder", "SELECT CAST(o_custkey % 50 AS BIGINT) AS root, strftime(max(o_orderdate), '%d.%m.%Y') AS folder FROM orders GROUP BY 1")
def newest_folder(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("root"), writers.dated_folder(F.col("o_orderdate")).alias("folder"))
    return review.newest_folder(rows.distinct())


@query("input_guard", "SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'input_too_large' ELSE 'available' END AS status FROM documents")
def input_guard(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", model_review.input_status(F.col("text")).alias("status"))


@query("selected_text", f"SELECT p AS doc_id, CASE p % 3 WHEN 0 THEN 'b' WHEN 1 THEN NULL ELSE 'a' END AS text FROM {P}")
def selected_text(spark, sf_dir):
    wanted = F.expr("case p % 3 when 0 then sha2('b', 256) when 1 then 'x' end")
    rows = _part(spark, sf_dir).select(F.col("p").alias("doc_id"), wanted.alias("wanted"), F.posexplode(F.array(F.lit(" "), F.lit("a"), F.lit("b"))).alias("ord", "text"))
    return model_review.selected_text(rows)


@query("assembled_suggestions", f"SELECT 'comparison-1' AS id, count(*) AS n FROM {P} UNION ALL SELECT 'narrative-2', count(*) FILTER (p % 2 = 0) FROM {P}")
def assembled_suggestions(spark, sf_dir):
    p = _part(spark, sf_dir)
    a = p.select(F.col("p").alias("doc_id"), F.lit(1).alias("ord"), F.lit("missed_redaction").alias("finding_type"), F.lit("PERSON_LIKE").alias("category"), F.lit(3).alias("sentence_index"))
    b = p.filter("p % 2 = 0").select(F.col("p").alias("doc_id"), F.lit(2).alias("ord"), F.lit("QUASI_IDENTIFIER_COMBINATION").alias("category"), F.array(F.lit(1), F.lit(2)).alias("sentence_indices"))
    return model_review.assembled(a, b).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("answer_status", "SELECT q_id, status FROM (VALUES (1, 'completed'), (2, 'generation_unavailable'), (3, 'no_relevant_context')) v(q_id, status)")
def answer_status(spark, sf_dir):
    asked = spark.createDataFrame([(1, "the and"), (2, "die und"), (3, "zzzzzzzzzzzz")], "q_id int, question string")
    found = retrieval.top_k(_index(spark, sf_dir), asked)
    return retrieval.answers(asked, found, spark.createDataFrame([(1, "text")], "q_id int, answer string")).select("q_id", "status")


@query("policy_expectations", f"SELECT expect, count(*) AS n FROM (SELECT CASE p % 4 WHEN 0 THEN 'must' WHEN 1 THEN 'optional' WHEN 2 THEN 'keep' ELSE 'optional' END AS expect FROM {P}) GROUP BY expect")
def policy_expectations(spark, sf_dir):
    tag = F.element_at(F.array(*[F.lit(x) for x in ("pesel", "ean", "public_figure", "case_reference")]), (F.col("p") % 4 + 1).cast("int"))
    return _part(spark, sf_dir).select(scoring.expectation(tag).alias("expect")).groupBy("expect").agg(F.count(F.lit(1)).alias("n"))


@query("invalid_keys", f"SELECT reason, count(*) AS n FROM (SELECT CASE p % 5 WHEN 0 THEN 'duplicate id' WHEN 1 THEN 'no characters' WHEN 2 THEN 'page out of range' END AS reason FROM {P}) WHERE reason IS NOT NULL GROUP BY reason")
def invalid_keys(spark, sf_dir):
    p = _part(spark, sf_dir)
    spans = p.select(F.col("p").alias("doc_id"), F.explode(F.expr("if(p % 5 = 0, array('a', 'a'), array('a'))")).alias("span_id"), F.expr("if(p % 5 = 2, 9, 1)").alias("page"))
    chars = p.filter("p % 5 <> 1").select(F.col("p").alias("doc_id"), F.lit("a").alias("span_id"))
    return scoring.invalid_keys(spans, chars, p.select(F.col("p").alias("doc_id"), F.lit(3).alias("page_count"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("recall", f"SELECT CAST(count(*) AS BIGINT) AS must, CAST(count(*) FILTER (p % 5 = 4) AS BIGINT) AS covered, round(100.0 * count(*) FILTER (p % 5 = 4) / count(*), 1) AS recall FROM {P}")
def recall(spark, sf_dir):
    scores = scoring.span_scores(scoring.char_status(_chars(spark, sf_dir), _fills(spark, sf_dir))).withColumn("expect", F.lit("must"))
    return scoring.recall(scoring.doc_summary(scores))


@query("label_layers", f"SELECT layer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'regex' AS layer, n FROM ({per_label(MASKED)}) UNION ALL SELECT 'ner', 0) GROUP BY layer HAVING sum(n) > 0")
def label_layers(spark, sf_dir):
    rows = cascade.claimed(notes(spark, sf_dir), CURRENT_YEAR)
    return rows.groupBy(scoring.layer(F.col("label")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("merged_spans", f"SELECT p AS doc_id, CAST(0 AS INT) AS s, CAST(CASE WHEN p % 2 = 0 THEN 12 ELSE 5 END AS INT) AS e FROM {P} UNION ALL SELECT p, 5, 12 FROM {P} WHERE p % 2 = 1")
def merged_spans(spark, sf_dir):
    second = F.when(F.col("p") % 2 == 0, F.lit(4)).otherwise(F.lit(5))
    both = F.array(*[F.struct(a.alias("s"), F.lit(b).alias("e")) for a, b in ((F.lit(0), 5), (second, 12))])
    return _part(spark, sf_dir).select(F.col("p").alias("doc_id"), F.explode(S.merged(both)).alias("x")).select("doc_id", "x.s", "x.e")


@query("pending_overrides", f"SELECT 'removed' AS kind, count(DISTINCT p % 100) AS n FROM {P} UNION ALL SELECT 'added', count(*) FILTER (x > 0) FROM (SELECT DISTINCT p % 100 AS d, p % 3 AS x FROM {P})")
def pending_overrides(spark, sf_dir):
    auto = _rects(spark, sf_dir, "500;0;510;10").select(geometry.RECT).distinct()
    added = _rects(spark, sf_dir, "p_partkey % 3;0;10;10", "RECZNE").select(geometry.RECT).distinct()
    removed, kept = geometry.apply_pending(auto.limit(0), added, auto.unionByName(added.filter("x0 = 0")), auto)
    return removed.agg(F.lit("removed").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(kept.agg(F.lit("added").alias("kind"), F.count(F.lit(1)).alias("n")))
