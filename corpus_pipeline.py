"""The corpus pipeline: five stages, each on what its predecessor kept.

All but the last return the columns of documents; n_chars follows the text. Other columns of the input, whatever their names, go; a
column of documents that the input lacks is null. Rows are judged one by one: rows that share an id but not their text have results of
their own, and repeated rows share one. No stage drops a null or empty text, and an empty table stays empty. Toxicity and
decontamination move no text; the stages that compare documents shuffle only the texts that change or go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactica.llm import decontaminate, packing, simhash, substring, toxicity
from redactica.llm.common import parted, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = COLUMNS[2:]


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. Null and empty texts are scored as texts without any hit, very long ones whole; a
    row without an id is scored like any other. Without toxic labels nothing goes."""
    docs = _columns(docs)
    lexicon, weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon, weights, carry=CARRIED).filter("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one document stays: that with the smallest id, and of the texts with that id the one with the
    smallest hash; its repeated rows stay with it. A row without an id goes if its group has a document with one, else it stays.
    Wordless texts are near-duplicates of each other. Only texts that may go are shuffled."""
    docs = _columns(docs)
    gone = stored(simhash.duplicates(simhash.near_duplicates(docs)), "duplicates")
    keys = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    marked = docs.select("*", *keys, simhash.text_hash(F.col("text")).alias("text_hash"))
    picked, rest = parted(marked, found := gone.select(*keys, "text_hash"), on := ["id", "none", "text_hash"])
    return picked.join(found, on, "left_anti").unionByName(rest).select(COLUMNS)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts, whose other words are then joined by single blanks; a text that loses nothing stays as it
    is, and one that loses all its words becomes empty. A row without an id comes after all others, so it loses what they have too."""
    return substring.deduplicated(_columns(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go: those with hit words, at least one in twenty of all. Wordless texts stay."""
    found = decontaminate.decontaminate(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=CARRIED)
    return found.filter("not contaminated").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed: rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A null or empty text is
    one piece with the end id alone; repeated rows, and rows without an id, are packed each."""
    return packing.best_fit_sequences(_columns(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_substrings),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity scores and token ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
