"""Queries on varied letters, on real text, on dictionaries beyond ASCII and on whole batches, with their twins. Importing registers them.

Letters name six towns in two cases, patrons, streets without a number, initials, cases, long numbers, an act's date and a birth date.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions.regex import java
from redactica.operators import audit, automaton, cascade, detect, dictionary, geometry, model_review, reports, retrieval, review, rollup, scoring
from redactica.plans.fixtures import CURRENT_YEAR, dealt, notes
from redactica.plans.more import P, _part
from redactica.plans.queries import MASKED_TEXT, SQL, TOKENS, K, _chars, _fills, _index, query, table, when
from redactica.sources import readers

#: (name, another case); the stem of the fifth is too short to be inflected.
TOWNS = (("Borowiec Dolny", "Borowcu Dolnym"), ("Kamionka", "Kamionki"), ("Zalesie", "Zalesiu"), ("Jastrowo", "Jastrowie"), ("Dąbie", "Dąbiu"), ("Stary Młyn", "Starym Młynie"))
_PARTS = (
    ("k % 3 = 0", "'Szkoła Podstawowa im. Marii Dolnej', ' działa.', chr(10)"),
    ("k % 4 = 1", "'przy ', 'ul. Klonowa', ' bez numeru', chr(10)"),
    ("k % 5 = 2", "'sprawa II/77/2021 oraz konto 1234 5678 9012 3456.', chr(10)"),
    ("k % 7 = 3", "'ustawa z dnia 3 maja 1791 r. oraz urodzony ', '5 lipca 1899', ' r.', chr(10)"),
)


def _town(i: int) -> str:
    return "CASE k % 6 " + " ".join(f"WHEN {n} THEN '{t[i]}'" for n, t in enumerate(TOWNS)) + " END"


def _letter(code: str, town: str, place: str, parts: tuple = _PARTS) -> str:
    some = ", ".join(f"CASE WHEN {cond} THEN concat({text}) ELSE '' END" for cond, text in parts)
    return f"concat('Pan J. Nowak, ', {code}, ' ', {town}, chr(10), 'Mieszka w ', {place}, '.', chr(10), {some})"


CODE = "concat(lpad(cast(c % 100 as varchar(20)), 2, '0'), '-', lpad(cast(k % 1000 as varchar(20)), 3, '0'))"


def letters(spark, sf_dir):
    """Rows (doc_id, k, code, town, place, text) of orders."""
    rows = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")))
    return spark.sql(f"SELECT k AS doc_id, k, {CODE} AS code, {_town(0)} AS town, {_town(1)} AS place, {_letter(CODE, _town(0), _town(1))} AS text FROM {{rows}}", rows=rows)


def _sums(conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS label, CAST(coalesce(sum({n}), 0) AS BIGINT) AS n FROM {K}" for label, n in conditions.items())


@query("letter_label_counts", _sums(dict.fromkeys(C.DETECTORS, "0") | {"POSTAL_CODE": "1", "MIEJSCOWOSC": "1", "ULICA": when("k % 4 = 1"), "DATA": when("k % 7 = 3")}))
def letter_label_counts(spark, sf_dir):
    return detect.label_counts(letters(spark, sf_dir), F.col("text"), CURRENT_YEAR).groupBy("label").agg(F.sum("n").alias("n"))


@query("letter_audit", _sums(dict.fromkeys(C.AUDIT_LABELS, "0") | {"POSTAL_CODE": "1", "INITIAL_SURNAME": "1", "STREET_LIKE": when("k % 4 = 1"), "CASE_REFERENCE": when("k % 5 = 2"), "LONG_NUMBER_SEQUENCE": when("k % 5 = 2")}))
def letter_audit(spark, sf_dir):
    return audit.long_form(audit.findings(letters(spark, sf_dir), F.col("text"), CURRENT_YEAR, ["doc_id"]), "doc_id").groupBy("label").agg(F.sum("n").alias("n"))


MASKED_PARTS = (
    (_PARTS[0][0], "'[NAZWA_FIRMY] działa.', chr(10)"),
    (_PARTS[1][0], "'przy [ULICA] bez numeru', chr(10)"),
    _PARTS[2],
    (_PARTS[3][0], "'ustawa z dnia 3 maja 1791 r. oraz urodzony [DATA] r.', chr(10)"),
)
MASKED_LETTER = _letter("'[POSTAL_CODE]'", "'[MIEJSCOWOSC]'", "CASE WHEN k % 6 = 4 THEN 'Dąbiu' ELSE '[MIEJSCOWOSC]' END", MASKED_PARTS)


@query("letter_masked", f"SELECT k AS doc_id, {MASKED_LETTER} AS masked FROM {K}")
def letter_masked(spark, sf_dir):
    return cascade.masked(letters(spark, sf_dir), CURRENT_YEAR).select("doc_id", "masked")


@query("letter_towns", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {n})" for n, (t, _) in enumerate(TOWNS)) + f") v(town, r) JOIN (SELECT k % 6 AS r, count(*) AS docs, CAST(sum(CASE WHEN k % 6 = 4 THEN 1 ELSE 2 END) AS BIGINT) AS mentions FROM {K} GROUP BY 1) USING (r)")
def letter_towns(spark, sf_dir):
    rows = letters(spark, sf_dir).withColumn("names", detect.town_names(F.col("text")))
    found = rows.select((F.col("k") % 6).alias("r"), F.explode("names").alias("town"), F.size(detect.town_mentions(F.col("text"), detect.town_pattern(F.col("names")))).alias("n"))
    return found.groupBy("town", "r").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("mentions"))


@query("letter_patrons", f"SELECT k AS doc_id, CAST(34 AS INT) AS chars FROM {K} WHERE k % 3 = 0")
def letter_patrons(spark, sf_dir):
    return letters(spark, sf_dir).select("doc_id", F.explode(detect.organisations(F.col("text"))).alias("x")).select("doc_id", (F.col("x.e") - F.col("x.s")).alias("chars"))


@query("engine_recall", "SELECT label, count(*) AS must, count(*) FILTER (hit) AS covered FROM (" + " UNION ALL ".join(f"SELECT '{label}' AS label, {hit} AS hit FROM {K} WHERE {cond}" for label, cond, hit in (("POSTAL_CODE", "true", "true"), ("MIEJSCOWOSC", "true", "true"), ("MIEJSCOWOSC", "true", "k % 6 <> 4"), ("NAZWA_FIRMY", "k % 3 = 0", "true"), ("ULICA", "k % 4 = 1", "true"), ("DATA", "k % 7 = 3", "true"))) + ") GROUP BY label")
def engine_recall(spark, sf_dir):
    """What the engine claims, held against the answer key of the letters: a value counts as covered if one claim covers all of it."""
    rows = letters(spark, sf_dir)
    k = F.col("k")
    values = (("POSTAL_CODE", F.col("code"), F.lit(True)), ("MIEJSCOWOSC", F.col("town"), F.lit(True)), ("MIEJSCOWOSC", F.col("place"), F.lit(True)), ("NAZWA_FIRMY", F.lit("Szkoła Podstawowa im. Marii Dolnej"), k % 3 == 0), ("ULICA", F.lit("ul. Klonowa"), k % 4 == 1), ("DATA", F.lit("5 lipca 1899"), k % 7 == 3))
    key = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(label).alias("label"), (F.position(value, F.col("text")) - 1).alias("s"), F.length(value).alias("n"))) for label, value, on in values]))
    keys = rows.select("doc_id", F.explode(key).alias("x")).select("doc_id", "x.label", "x.s", (F.col("x.s") + F.col("x.n")).alias("e"))
    claims = cascade.claimed(rows, CURRENT_YEAR).select("doc_id", "start", "end")
    hits = keys.join(claims, "doc_id", "left").groupBy("doc_id", "label", "s").agg(F.max(F.coalesce((F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e")), F.lit(False))).alias("hit"))
    return hits.groupBy("label").agg(F.count(F.lit(1)).alias("must"), F.count_if("hit").alias("covered"))


@query("mask_function", MASKED_TEXT)
def mask_function(spark, sf_dir):
    cascade.register(spark, CURRENT_YEAR, "mask_text")
    return spark.sql("SELECT doc_id, mask_text(text) AS masked FROM {notes}", notes=notes(spark, sf_dir))


@query("mask_counted", f"SELECT doc_id, masked, CAST(len(regexp_extract_all(masked, '[[][A-Z_]+[]]')) AS BIGINT) AS n FROM ({MASKED_TEXT})")
def mask_counted(spark, sf_dir):
    cascade.register_counted(spark, CURRENT_YEAR, "mask_counted")
    return spark.sql("SELECT doc_id, m.text AS masked, aggregate(map_values(m.counters), 0L, (a, x) -> a + x) AS n FROM (SELECT doc_id, mask_counted(text) AS m FROM {notes})", notes=notes(spark, sf_dir))


# --- real text: the catalogue's patterns without lookaround, which the other engine lacks -------------------------------------------


def _re2(pattern: str, fold: bool = False, groups: bool = False) -> str:
    """A pattern that takes its neighbours along instead of looking at them; with `groups` these are groups."""
    group = "(" if groups else "(?:"
    p = java(pattern, fold).replace("(?iu", "(?i").replace(java(r"(?:(?<=-)\n[A-Za-z0-9.-]*)*"), "").replace("++", "+")
    p = p.replace(java(r"(?!\s+\d)(?!\w)"), group + java(r"$|[^\w\s]|\s+(?:$|[^\d\s])") + ")")
    p = re.sub(r"\(\?<!\[([^\]]*)\]\)", lambda m: f"{group}^|[^{m[1]}])", p)
    p = re.sub(r"\(\?!\[([^\]]*)\]\)", lambda m: f"{group}$|[^{m[1]}])", p)
    return re.sub(r"\(\?<=(.*?\])\)", lambda m: f"{group}{m[1]})", p).replace("'", "''")


SQL["label_counts_documents"] = " UNION ALL ".join(f"SELECT lang, '{label}' AS label, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{_re2(*of)}'))) AS BIGINT) AS n FROM documents GROUP BY lang" for label, of in C.DETECTORS.items())
_COUNTS = {label: f"len(regexp_extract_all(coalesce(text, ''), '{_re2(p)}'))" for label, p in C.AUDIT.items()} | {"SENSITIVE_DICTIONARY_TERM": "0"}
_COUNTS["LONG_NUMBER_SEQUENCE"] = f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{_re2(C.AUDIT['LONG_NUMBER_SEQUENCE'])}'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= {C.LONG_NUMBER_DIGITS}))"
SQL["audit_documents"] = f"""WITH a AS (SELECT doc_id, {', '.join(f'CAST({_COUNTS[x]} AS BIGINT) AS {x}' for x in C.AUDIT_LABELS)} FROM documents), b AS (SELECT *, {' + '.join(C.AUDIT_LABELS)} AS total, {' + '.join(C.HIGH_RISK_LABELS)} AS high FROM a)
SELECT * EXCLUDE (high), CASE WHEN total > 0 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN total = 0 THEN 'ok' WHEN high > 0 OR total >= {C.HIGH_RISK_TOTAL} THEN 'high_risk' ELSE 'warning' END AS risk_level FROM b"""


def _masked_sql() -> str:
    """The stateless rules in order; documents hold no quoted names, bare labels, towns or weak phones."""
    out = "text"
    for label, of in [("NAZWA_FIRMY", (C.PATRON_FACILITY, False)), *C.DETECTORS.items()]:
        p = _re2(*of, groups=True)
        behind = r"\2" if p.count("($|") else ""
        for _ in range(2):  # a neighbour that two matches share is taken along by the first
            out = rf"regexp_replace({out}, '{p}', '\1[{label}]{behind}', 'g')"
    return out


SQL["cascade_documents"] = f"""SELECT doc_id, sha256(masked) AS masked_sha256, CAST(len(regexp_extract_all(masked, '{"|".join(rf"[[]{x}[]]" for x in C.DETECTORS)}')) AS BIGINT) AS replaced FROM (SELECT doc_id, {_masked_sql()} AS masked FROM documents)"""
SQL["chunks"] = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
c AS (
  SELECT doc_id, t, 0 AS s, 0 AS e, 0 AS i, '' AS piece FROM t
  UNION ALL
  SELECT doc_id, t, e, e2, i + CASE WHEN piece2 <> '' THEN 1 ELSE 0 END, piece2 FROM (
    SELECT *, regexp_replace(substr(t, s2 + 1, e2 - s2), '^\s+|\s+$', '', 'g') AS piece2 FROM (
      SELECT *, CASE WHEN s2 + {C.CHUNK_CHARS} >= length(t) THEN length(t) WHEN last > {C.CHUNK_CHARS // 2} THEN s2 + last + 1 ELSE s2 + {C.CHUNK_CHARS} END AS e2 FROM (
        SELECT *, length(regexp_extract(substr(t, s2 + 1, {C.CHUNK_CHARS}), '(?s)^(.*)[ \n]', 1)) AS last FROM (
          SELECT *, CASE WHEN e = 0 THEN 0 ELSE e - {C.CHUNK_OVERLAP} END AS s2 FROM c WHERE e < length(t)))))
)
SELECT CAST(doc_id AS VARCHAR) AS source_file, CAST(i AS INTEGER) AS chunk_index, sha256(piece) AS text_sha256 FROM c WHERE piece <> ''"""


# --- dictionaries ---------------------------------------------------------------------------------------------------------------------

FOREIGN = "Straße = [ULICA]\nKis | Kowalski-Nowak = [OSOBA]\nsklep = [MIEJSCE]\nz o.o. = [FORMA]\nŚwiątek | raz dwa trzy cztery pięć sześć siedem osiem dziewięć = [KLIENT]\n"
_FOREIGN_TEXT = "concat('Straße STRASSE straßen, nr ', cast(p as varchar(20)), chr(10), 'Kis Kıs Kisowa \u017fklep SKLEPY, KOWALSKI-NOWAK, Firma z  o.o. ŚWIĄTEK, raz dwa trzy cztery pięć sześć siedem osiem dziewięć, raz dwa', chr(10), 'trzy')"
_FOREIGN_MASKED = "concat('[ULICA] STRASSE straßen, nr ', p, chr(10), '[OSOBA] [OSOBA] Kisowa [MIEJSCE] SKLEPY, [OSOBA], Firma [FORMA] [KLIENT], [KLIENT], raz dwa', chr(10), 'trzy')"


def _foreign(spark, sf_dir):
    return _part(spark, sf_dir).select(F.col("p").alias("doc_id"), F.expr(_FOREIGN_TEXT).alias("text"))


@query("dictionary_foreign", f"SELECT p AS doc_id, {_FOREIGN_MASKED} AS masked FROM {P}")
def dictionary_foreign(spark, sf_dir):
    return _foreign(spark, sf_dir).select("doc_id", dictionary.masked(F.col("text"), dictionary.parse(FOREIGN)).alias("masked"))


@query("dictionary_joined", f"SELECT label, CAST(count(*) * m AS BIGINT) AS n FROM {P}, (VALUES ('ULICA', 1), ('OSOBA', 3), ('MIEJSCE', 1), ('FORMA', 1), ('KLIENT', 2)) v(label, m) GROUP BY label, m")
def dictionary_joined(spark, sf_dir):
    terms = spark.createDataFrame([(t.term, t.label) for t in dictionary.parse(FOREIGN)], "term string, label string")
    return automaton.spans(_foreign(spark, sf_dir), terms).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- batches --------------------------------------------------------------------------------------------------------------------------

_FILES = f"(SELECT p % 7 AS batch, p AS position, concat('a', p, '.txt') AS name, CASE WHEN p % 11 = 0 THEN 'file processing failed' END AS error, CASE WHEN p % 11 = 0 THEN NULL WHEN p % 3 = 0 THEN 'ok' WHEN p % 3 = 1 THEN 'warning' ELSE 'high_risk' END AS risk_level, p % 5 AS masked, CASE p % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'disabled' ELSE 'odd' END AS ner_status, p FROM {P})"
_RANK = "CASE risk_level WHEN 'high_risk' THEN 0 WHEN 'warning' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END"


def _files(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_FILES.replace(P, '{rows}')}", rows=_part(spark, sf_dir)).withColumn("doc_id", F.col("p"))


@query("batch_priorities", f"SELECT batch, name, CAST(row_number() OVER (PARTITION BY batch ORDER BY {_RANK}, position) AS INTEGER) AS place FROM {_FILES} WHERE error IS NULL")
def batch_priorities(spark, sf_dir):
    return review.batch_priorities(_files(spark, sf_dir)).select("batch", "name", "place")


#: Few enough characters for several parts of a batch.
_PART = 2048


def _parted(lines: str) -> str:
    """SQL of the parts of lines (batch, first, rank, position, line)."""
    return f"""WITH f AS {_FILES}, l AS ({lines}), a AS (SELECT batch, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY batch ORDER BY first, rank, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l)
SELECT batch, CAST(dense_rank() OVER (PARTITION BY batch ORDER BY bin) - 1 AS INT) AS part, text FROM (SELECT batch, pos // {_PART} AS bin, string_agg(line, chr(10) ORDER BY pos) AS text FROM a GROUP BY 1, 2)"""


@query("batch_checklist", _parted(f"SELECT batch, 0 AS first, 0 AS rank, 0 AS position, concat('Review: ', count(*) FILTER (error IS NULL), ', failed: ', count(*) FILTER (error IS NOT NULL)) AS line FROM f GROUP BY batch UNION ALL SELECT batch, 1, {_RANK}, position, concat('[ ] ', name, ' (risk: ', risk_level, ')') FROM f WHERE error IS NULL"))
def batch_checklist(spark, sf_dir):
    return reports.batch_checklist(_files(spark, sf_dir), _PART)


@query("batch_report", _parted("SELECT batch, 0 AS first, 0 AS rank, 0 AS position, concat('Files: ', count(*), chr(10), 'Done: ', count(*) FILTER (error IS NULL), chr(10), 'Failed: ', count(*) FILTER (error IS NOT NULL)) AS line FROM f GROUP BY batch UNION ALL SELECT batch, 1, 0, position, concat('* ', name, CASE WHEN error IS NULL THEN concat(': ok, risk ', risk_level, ', masked ', masked) ELSE concat(': error, ', error) END) FROM f"))
def batch_report(spark, sf_dir):
    return reports.batch_report(_files(spark, sf_dir), _PART)


@query("batch_files", f"SELECT batch, name, row_number() OVER (PARTITION BY batch ORDER BY position) AS place FROM {_FILES}")
def batch_files(spark, sf_dir):
    return rollup.batch_files(_files(spark, sf_dir)).select("batch", "name", "place")


_NER = ("available", "disabled", "model_missing")


@query("batch_result", f"""WITH f AS {_FILES}, z AS (SELECT DISTINCT batch FROM f)
SELECT batch, 'counter' AS kind, 'PESEL' AS "key", CAST(sum(masked) AS BIGINT) AS n FROM f GROUP BY batch HAVING sum(masked) > 0
UNION ALL SELECT batch, 'finding', 'EMAIL', count(*) FROM f WHERE p % 2 = 0 GROUP BY batch
UNION ALL SELECT batch, 'error', error, count(*) FROM f WHERE error IS NOT NULL GROUP BY batch, error
UNION ALL SELECT z.batch, 'risk', v.k, count(f.p) FROM z CROSS JOIN (SELECT unnest(['ok', 'warning', 'high_risk']) AS k) v LEFT JOIN f ON f.batch = z.batch AND f.risk_level = v.k GROUP BY z.batch, v.k
UNION ALL SELECT z.batch, 'ner', v.k, count(f.p) FROM z CROSS JOIN (SELECT unnest(['available', 'disabled', 'model_missing', 'unavailable']) AS k) v LEFT JOIN f ON f.batch = z.batch AND f.error IS NULL AND CASE f.ner_status WHEN 'odd' THEN 'unavailable' ELSE f.ner_status END = v.k GROUP BY z.batch, v.k
UNION ALL SELECT batch, 'total', 'input', count(*) FROM f GROUP BY batch UNION ALL SELECT batch, 'total', 'success', count(*) FILTER (error IS NULL) FROM f GROUP BY batch
UNION ALL SELECT batch, 'total', 'error', count(*) FILTER (error IS NOT NULL) FROM f GROUP BY batch UNION ALL SELECT batch, 'total', 'masked', CAST(sum(masked) AS BIGINT) FROM f GROUP BY batch UNION ALL SELECT batch, 'total', 'files', count(*) FROM f GROUP BY batch""")
def batch_result(spark, sf_dir):
    files = _files(spark, sf_dir)
    counters = files.select("batch", F.lit("PESEL").alias("label"), F.col("masked").cast("long").alias("n"))
    findings = files.select("batch", F.lit("EMAIL").alias("label"), F.when(F.col("p") % 2 == 0, 1).otherwise(0).cast("long").alias("n"))
    done = rollup.batch_result(files, counters, findings, _NER)
    totals = F.map_from_arrays(F.array(*[F.lit(x) for x in ("input", "success", "error", "masked", "files")]), F.array("input_count", "success_count", "error_count", F.col("total_masked").cast("long"), "input_count"))
    maps = (("counter", F.col("counters")), ("finding", F.col("findings")), ("error", F.col("errors")), ("risk", F.col("risks")), ("ner", F.col("ner")), ("total", totals))
    out = None
    for kind, m in maps:
        rows = done.select("batch", F.lit(kind).alias("kind"), F.explode(m).alias("key", "n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("page_census", f"SELECT p AS doc_id, page, label, CAST(n AS BIGINT) AS n FROM {P}, (VALUES (1, '[A]', 1), (3, '[A]', 2), (3, '[B b]', 1)) v(page, label, n)")
def page_census(spark, sf_dir):
    pages = C.PAGE_SEPARATOR.join(("x [A]", "nothing", "[A] [B b]\n[A] [", "[]"))
    return review.page_census(_part(spark, sf_dir).select(F.col("p").alias("doc_id"), F.lit(pages).alias("text")))


@query("suggestion_rects", f"SELECT p AS doc_id, 'comparison-1' AS id, 2 AS page, x0, y0, x1, y1 FROM {P}, (VALUES (150.0::DOUBLE, 0.0::DOUBLE, 195.0::DOUBLE, 10.0::DOUBLE), (0.0, 12.0, 145.0, 22.0)) v(x0, y0, x1, y1) WHERE p % 2 = 0")
def suggestion_rects(spark, sf_dir):
    """Two pages of twelve words in lines of four; the sentence is the second page's fourth to seventh word."""
    p = _part(spark, sf_dir).select(F.col("p").alias("doc_id"))
    word = lambda page, i: F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("_"), page.cast("string"), F.lit("_"), i.cast("string"))
    at = p.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page")).select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    i = F.col("i")
    words = at.select("doc_id", "page", F.lit(0).alias("block_no"), F.floor(i / 4).cast("int").alias("line_no"), (i % 4).alias("word_no"), word(F.col("page"), i).alias("text"), (i % 4 * 50).cast("double").alias("x0"), (F.floor(i / 4) * 12).cast("double").alias("y0"), (i % 4 * 50 + 45).cast("double").alias("x1"), (F.floor(i / 4) * 12 + 10).cast("double").alias("y1"))
    sentence = F.concat_ws(" ", *[word(F.lit(2), F.lit(n)) for n in range(3, 7)])
    asked = p.select("doc_id", F.lit("comparison-1").alias("id"), F.when(F.col("doc_id") % 2 == 0, "missed_redaction").otherwise("unnecessary_redaction").alias("kind"), sentence.alias("sentence"))
    return model_review.suggestion_rects(asked, geometry.word_pages(words))


_ASKED = "SELECT item_id AS q_id, CASE WHEN item_id % 5 = 4 THEN 'zzzqx' ELSE array_to_string(string_split(text, ' ')[1:4], ' ') END AS question FROM benchmark"


@query("answer_outcomes", f"""WITH {TOKENS}, a AS ({_ASKED}), q AS (SELECT q_id, token, count(*) AS asked FROM (SELECT q_id, unnest(list_transform(list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2), lambda x: lower(x))) AS token FROM a) GROUP BY ALL),
s AS (SELECT q_id, CAST(doc_id AS VARCHAR) AS name, sum((1 + ln(tf)) * asked) / (1 + ln(n)) AS score FROM i JOIN q USING (token) GROUP BY q_id, doc_id, n),
r AS (SELECT q_id, name, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, name) AS rank FROM s),
l AS (SELECT q_id, string_agg(concat('* ', name, '#1'), chr(10) ORDER BY rank) AS sources FROM r WHERE rank <= 3 GROUP BY q_id)
SELECT q_id, CASE WHEN sources IS NULL THEN 'No answer: no_relevant_context' ELSE concat(CASE q_id % 5 WHEN 0 THEN concat('Yes, ', q_id, '.') WHEN 1 THEN 'No answer: timeout' WHEN 2 THEN 'No answer: processing_error' ELSE 'No answer: generation_unavailable' END, chr(10), 'Sources:', chr(10), sources) END AS text FROM a LEFT JOIN l USING (q_id)""")
def answer_outcomes(spark, sf_dir):
    """Questions of the benchmark's first words on all documents, with answers, errors and silence by their number."""
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    n = F.col("q_id") % 5
    asked = item.select("q_id", F.when(n == 4, "zzzqx").otherwise(F.array_join(F.slice(F.split("text", " "), 1, 4), " ")).alias("question"))
    said = item.filter(n < 4).select("q_id", F.when(n == 0, F.concat(F.lit("Yes, "), F.col("q_id").cast("string"), F.lit("."))).when(n == 2, "half").alias("answer"), F.when(n == 1, "timeout").when(n == 2, "refused").alias("error"))
    return retrieval.formatted(retrieval.answers(asked, retrieval.top_k(_index(spark, sf_dir), asked), said.filter("answer is not null or error is not null")))


LABELS_JSON = """concat('{"active_labels": ', case p % 6 when 0 then '["PESEL", "NIP"]' when 1 then '["PESEL", 3]' when 2 then '[]' when 3 then '"PESEL"' when 4 then 'null' else '["NIP", "NIP"]' end,
  ', "active_pages": ', case p % 5 when 0 then '[3, 1]' when 1 then '[1, true]' when 2 then '[0, 2]' when 3 then '[1.5]' else '[2, 2]' end,
  ', "strip_signatures": ', case p % 4 when 0 then 'true' when 1 then '1' when 2 then '"true"' else 'false' end, case when p % 7 = 6 then '' else '}' end)"""


@query("typed_sidecars", f"SELECT p AS doc_id, CASE WHEN p % 7 < 6 AND p % 6 = 0 THEN 'NIP,PESEL' WHEN p % 7 < 6 AND p % 6 = 5 THEN 'NIP' END AS labels, CASE WHEN p % 7 < 6 AND p % 5 = 0 THEN '1,3' WHEN p % 7 < 6 AND p % 5 = 4 THEN '2' END AS pages, p % 7 < 6 AND p % 4 = 0 AS strip FROM {P}")
def typed_sidecars(spark, sf_dir):
    s = _part(spark, sf_dir).select("p", readers.selection(F.expr(LABELS_JSON)).alias("s"))
    return s.select(F.col("p").alias("doc_id"), F.array_join("s.labels", ",").alias("labels"), F.array_join(F.col("s.pages").cast("array<string>"), ",").alias("pages"), F.col("s.strip_signatures").alias("strip"))


EDITS_JSON = """concat('{"removed": [[', p, ', "PESEL", 1, 2.5, 3, 4], [1, "x", 0, 0, 1], [2, "y", null, 0, 1, 1]', case when p % 3 = 0 then '' else ', 7' end,
  '], "added": ', case when p % 4 = 3 then '"none"' else concat('[{"page": ', p % 5, ', "x0": 0, "y0": 0, "x1": 5, "y1": 5, "label": ', case p % 4 when 0 then '"AI_SUGESTIA"' when 1 then 'null' else '"PESEL"' end, '}, {"page": 1}, 3]') end, '}')"""


@query("manual_edits_read", f"SELECT p AS doc_id, CAST(p AS BIGINT) AS removed_page, CAST(2.5 AS DOUBLE) AS removed_y0, CASE WHEN p % 4 <> 3 THEN CAST(p % 5 AS BIGINT) END AS added_page, CASE WHEN p % 4 <> 3 THEN CASE p % 4 WHEN 0 THEN 'AI_SUGESTIA' ELSE 'RECZNE' END END AS added_label, CASE WHEN p % 4 = 3 THEN 1 ELSE 2 END AS n FROM {P}")
def manual_edits_read(spark, sf_dir):
    e = _part(spark, sf_dir).select(F.col("p").alias("doc_id"), readers.manual_edits(F.expr(EDITS_JSON)).alias("e"))
    first = lambda name, field: F.try_element_at(f"e.{name}", F.lit(1))[field]
    return e.select("doc_id", first("removed", "page").alias("removed_page"), first("removed", "y0").alias("removed_y0"), first("added", "page").alias("added_page"), first("added", "label").alias("added_label"), (F.size("e.removed") + F.size("e.added")).alias("n"))


@query("stored_suggestions", f"SELECT p AS doc_id, p % 3 = 0 AS compared, CASE WHEN p % 2 = 0 THEN concat('f', p) END AS fingerprint, CAST(CASE p % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS resolved FROM {P}")
def stored_suggestions(spark, sf_dir):
    text = F.expr("""concat('{"comparison_result": ', case p % 3 when 0 then '{"status": "completed"}' when 1 then '[1]' else 'null' end, ', "original_text_sha256": ', case when p % 2 = 0 then concat('"f', p, '"') else '12' end,
      ', "resolved": ', case p % 4 when 0 then '{"comparison-1": "accepted", "narrative-1": "rejected", "narrative-2": "open"}' when 1 then '{"comparison-1": "accepted", "x": 1}' when 2 then '[1]' else 'null' end, '}')""")
    s = _part(spark, sf_dir).select(F.col("p").alias("doc_id"), readers.stored_suggestions(text).alias("s"))
    return s.select("doc_id", F.col("s.comparison").isNotNull().alias("compared"), "s.fingerprint", F.size("s.resolved").alias("resolved"))


@query("artefact_of_any_kind", f"SELECT concat('a', p, CASE WHEN p % 4 = 3 THEN '_ANON.docx' ELSE '_ANON.txt' END) AS name, concat('a', p, CASE p % 4 WHEN 0 THEN '_ANON.pdf' WHEN 1 THEN '_ANON_REVIEW.pdf' WHEN 2 THEN '_ANON.txt' ELSE '_ANON.docx' END) AS artefact FROM {P}")
def artefact_of_any_kind(spark, sf_dir):
    names = F.expr("case p % 4 when 0 then array('_ANON.txt', '_ANON.pdf') when 1 then array('_ANON.txt', '_ANON.pdf', '_ANON_REVIEW.pdf') when 2 then array('_ANON.txt', '_ANON_2.pdf') else array('_ANON.docx', '_ANON_VISUAL.pdf') end")
    listing = _part(spark, sf_dir).select(F.lit("f").alias("folder"), F.explode(F.transform(names, lambda x: F.concat(F.lit("a"), F.col("p").cast("string"), x))).alias("name"))
    files = review.classified(listing)
    return review.preferred_artefact(files.filter("family in ('anon_txt', 'anon_docx')"), files, listing).select("name", "artefact")


@query("words_under_boxes", "SELECT p_partkey AS page, concat('w', p_partkey) AS word FROM part WHERE p_partkey % 7 = 0")
def words_under_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").alias("page"))
    word = lambda text, x: p.select("doc_id", "page", F.concat(F.lit(text), F.col("page").cast("string")).alias("word"), F.lit(x).alias("x0"), F.lit(2.0).alias("y0"), F.lit(x + 6).alias("x1"), F.lit(8.0).alias("y1"))
    words = word("w", 502.0).unionByName(word("v", 540.0)).unionByName(word("u", 1.0))
    return scoring.words_under(scoring.over_redaction(_fills(spark, sf_dir), _chars(spark, sf_dir)), words).select("page", "word")


@query("doc_details", """WITH s AS (SELECT p_partkey AS p, p_partkey % 50 AS doc_id, p_partkey % 5 AS n, CASE WHEN p_partkey % 3 = 0 THEN 'keep' ELSE 'must' END AS expect FROM part)
SELECT doc_id, count(*) FILTER (expect = 'must') AS must, count(*) FILTER (expect = 'must' AND n = 4) AS covered,
  coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FILTER (expect = 'must' AND n IN (1, 2, 3)), '') AS "partial", coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FILTER (expect = 'must' AND n = 0), '') AS "full",
  coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FILTER (expect = 'keep' AND n > 0), '') AS keep_redacted, '' AS residue, count(*) FILTER (p % 7 = 0) AS over_rects,
  count(*) FILTER (expect = 'must' AND n = 4 AND p % 4 < 2) AS regex, count(*) FILTER (expect = 'must' AND n = 4 AND p % 4 IN (1, 2)) AS ner, count(*) FILTER (expect = 'must' AND n = 4 AND p % 4 = 3) AS unknown FROM s GROUP BY doc_id""")
def doc_details(spark, sf_dir):
    chars, fills = _chars(spark, sf_dir), _fills(spark, sf_dir)
    scores = scoring.span_scores(scoring.char_status(chars, fills))
    scores = scores.withColumn("expect", scoring.expectation(F.when(F.col("span_id") % 3 == 0, "public_figure").otherwise("pesel")))
    label = F.explode(F.expr("case span_id % 4 when 0 then array('PESEL') when 1 then array('PESEL', 'NER_PERSON', 'NER_ORG') when 2 then array('NER_ORG') else cast(array() as array<string>) end"))
    layers = scores.select("doc_id", "span_id", label.alias("label")).withColumn("layer", scoring.layer(F.col("label")))
    out = scoring.doc_details(scores, layers, scoring.over_redaction(fills, chars))
    listed = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("partial", "full", "keep_redacted", "residue")]
    named = [F.coalesce(F.try_element_at("layers", F.lit(k)), F.lit(0)).alias(n) for k, n in (("regex", "regex"), ("ner", "ner"), ("?", "unknown"))]
    return out.select("doc_id", "must", "covered", *listed, "over_rects", *named)
