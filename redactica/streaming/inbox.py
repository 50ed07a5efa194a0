"""An inbox folder as a stream: new text files are masked and counted as they come. An extension; the batch path is the same code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactica.operators import cascade


def texts(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return rows.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def masked(stream: DataFrame, current_year: int) -> DataFrame:
    """Rows (doc_id, masked, counters); stateless, so it scales with the files of a trigger."""
    return cascade.masked(stream, current_year)


def label_totals(stream: DataFrame, current_year: int) -> DataFrame:
    """Running sums by label."""
    return masked(stream, current_year).select(F.explode("counters").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, late ones within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))
