"""Secret scans with an incremental ledger of blobs, in column expressions alone.

A row is a version of the text at a path (an id). Its text is content-addressed: the SHA-256 of its UTF-8 bytes names a blob. The ledger,
a Parquet table that outlives the run, has a row (blob, rules, findings) for what was scanned: the blob, the rule versions it was
scanned with, and what they found there, as places and never as values. A run

1. names the blob of every row, which moves no text,
2. leaves of each blob the rule versions that the ledger does not hold yet; a blob without any is not scanned again, and of the copies
   of a blob one row alone is,
3. scans those rows with those rules and appends the outcome to the ledger in one commit: a run that fails adds nothing,
4. joins the findings of the ledger back to all rows, paths with old blobs among them.

A text moves only to meet the list of what is to be scanned, and not even then when few rows are new: then the list is broadcast
(`FEW`, and a checked size, `BROADCAST_ROWS`). Copies under different ids are dealt by blob and id, so that a hot blob
is in no single task.

A match is the leftmost one that does not overlap the match before of its rule; matches whose value is too short are dropped after
that. Offsets are code points. Rules are written so that the JVM's matcher neither recurses nor goes back far in long texts.

Defined results: a null text is an empty one and has no spans. A very long text is scanned whole. Repeated rows give a row each; rows of
one id with different texts are versions of their own. A null id is a path like others. Equal starts are ordered by rule. An empty table
gives no rows and leaves the ledger as it is. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions.spans import spans
from redactica.llm.common import documents, exists, scratch, stored

#: Rows (blob, path) of 40 bytes that are broadcast at most.
BROADCAST_ROWS = 100_000
#: The share of all rows that the list may be to be broadcast, as one in so many.
FEW = 8
FINDINGS = "array<struct<rule:string,start:int,end:int>>"


class Rule(NamedTuple):
    pattern: str
    sign: str  #: what a text with a match must hold, as a cheap pattern
    version: int = 1
    group: int = 0  #: the group whose length counts,
    least: int = 0  #: and how long it must be


#: The three base rules, then two more.
RULES = {
    "assign": Rule(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "(?i:passw|secret|token|api_?key)", group=1, least=8),
    "access": Rule(r"AKIA[A-Z0-9]{12,}", "AKIA"),
    "hex": Rule(r"[0-9a-f]{32,}", "[0-9a-f]{32}"),
    "private_key": Rule(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    "login": Rule(r"[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/@]{1,200}@", "://"),
}
BASE = ("assign", "access", "hex")


def named(rules: dict[str, Rule]) -> list[str]:
    """The rule versions, in their order."""
    return [f"{name}@{r.version}" for name, r in rules.items()]


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def found_by(name: str, rule: Rule, text: Column) -> Column:
    """The findings of one rule."""
    places = spans(text, rule.pattern)
    if rule.least:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
        places = F.filter(F.zip_with(places, sizes, lambda p, n: F.named_struct(F.lit("s"), p["s"], F.lit("e"), p["e"], F.lit("n"), n)), lambda x: x["n"] >= rule.least)
    return F.transform(places, lambda p: F.named_struct(F.lit("rule"), F.lit(name), F.lit("start"), p["s"], F.lit("end"), p["e"])).cast(FINDINGS)


def _none() -> Column:
    return F.expr(f"cast(array() as {FINDINGS})")


def pending(rows: DataFrame, ledger: str, rules: dict[str, Rule]) -> DataFrame:
    """Rows (blob, own, missing): one row of each blob that lacks rule versions in the ledger, and which."""
    spark = rows.sparkSession
    one = rows.groupBy("blob").agg(F.min("own").alias("own"))
    wanted = F.array(*[F.lit(r) for r in named(rules)])
    if not exists(spark, ledger):
        return one.withColumn("missing", wanted)
    known = spark.read.parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("known"))
    missing = F.array_except(wanted, F.coalesce("known", F.expr("cast(array() as array<string>)")))
    return one.join(known, "blob", "left").select("blob", "own", missing.alias("missing")).filter(F.size("missing") > 0)


def extend(docs: DataFrame, ledger: str, rules: dict[str, Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what the ledger lacks and appends it; rows (path, own, blob) of all versions, as a table."""
    text = F.col(f"`{text_col}`")
    # a hash stands for the path: rows with equal ones are scanned twice at worst
    marks = [F.xxhash64(F.col(f"`{id_col}`")).alias("own"), blob(text).alias("blob")]
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("path"), *marks), "versions")
    todo = stored(pending(rows, ledger, rules), "pending")
    if n := todo.count():
        way = "broadcast" if n <= min(BROADCAST_ROWS, rows.count() // FEW) else "shuffle_hash"
        picked = docs.select(*marks, F.coalesce(text, F.lit("")).alias("text")).join(todo.hint(way), ["blob", "own"])
        each = [F.when(F.array_contains("missing", key) & F.col("text").rlike(r.sign), found_by(name, r, F.col("text"))).otherwise(_none()) for key, (name, r) in zip(named(rules), rules.items(), strict=True)]
        scanned = picked.select("blob", F.col("missing").alias("rules"), F.concat(*each).alias("findings"))
        scanned.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return rows


def findings(ledger: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Rows (blob, spans): the findings of the present rule versions, for blobs that have any."""
    wanted = F.array(*[F.lit(r) for r in named(rules)])
    version = F.create_map(*[F.lit(x) for name, key in zip(rules, named(rules), strict=True) for x in (name, key)])
    order = F.create_map(*[F.lit(x) for k, name in enumerate(rules) for x in (name, k)])
    now = F.filter("findings", lambda f: F.array_contains(F.array_intersect("rules", wanted), version[f["rule"]]))
    some = ledger.filter(F.size("findings") > 0).select("blob", now.alias("spans")).filter(F.size("spans") > 0)
    keyed = F.transform(F.array_distinct(F.flatten(F.collect_list("spans"))), lambda f: F.struct(f["start"].alias("start"), order[f["rule"]].alias("k"), f["end"].alias("end"), f["rule"].alias("rule")))
    return some.groupBy("blob").agg(F.transform(F.array_sort(keyed), lambda f: F.struct(f["rule"], f["start"], f["end"])).cast(FINDINGS).alias("spans"))


def scan(docs: DataFrame, ledger: str, rules: dict[str, Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (path, blob, spans) of all versions, spans being structs (rule, start, end) in order; the ledger at this path grows."""
    spark = docs.sparkSession
    rows = extend(docs, ledger, rules, id_col, text_col).drop("own")
    if not exists(spark, ledger):
        return rows.withColumn("spans", _none())
    known = stored(findings(spark.read.parquet(ledger), rules), "findings")
    return rows.join(known, "blob", "left").select("path", F.hex("blob").alias("blob"), F.coalesce("spans", _none()).alias("spans"))


def _of(rule: str):
    return lambda f: f["rule"] == rule


def shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir), scratch(spark, "ledger"))
    base = F.filter("spans", lambda f: f["rule"].isin(*BASE))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select(F.col("path").alias("doc_id"), *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _twin() -> str:
    """Pieces between the matches and the matches add up to the places."""
    words = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    parts = []
    for k, (name, rule) in enumerate(RULES.items()):
        pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{words})").replace("'", "''")
        value = f"regexp_extract_all(t, '{pattern}', {rule.group})"
        parts.append(
            f"SELECT doc_id, r, {k} AS k, '{name}' AS rule, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n "
            f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, r, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, {value} AS v FROM d)) WHERE length(v[i]) >= {rule.least}"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    string_agg(rule || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(rule || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans
  FROM hits GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


SQL = _twin()
