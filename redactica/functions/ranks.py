"""Sums along an order within groups, however large a group is.

Rows are sorted by range into partitions, so a large group lies in several; each partition's sum of each group gives the later ones
what to begin with. No group is in one task, and the rows that meet for the beginnings are one for each group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactica.sources.scratch import stored


def running(rows: DataFrame, group: list[str], order: list[str | Column], name: str, measure: Column | None = None) -> DataFrame:
    """Adds `name`: the sum of `measure` (of ones, if none) over the rows before a row in its group. Rows that are equal in the order
    come in any order. Null groups are groups."""
    own = [F.col(f"`{c}`") for c in group]
    keyed = rows.select("*", (F.lit(1) if measure is None else measure).cast("long").alias("_m"), F.struct(*own or [F.lit(0)]).alias("_g"), F.monotonically_increasing_id().alias("_row"))
    along = [*[F.col(c) if isinstance(c, str) else c for c in order], F.col("_row")]
    ranged = keyed.repartitionByRange("_g", *along).withColumn("_part", F.spark_partition_id())
    parts = stored(ranged, "ranges")
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.groupBy("_g", "_part").agg(F.sum("_m").alias("_s")).select("_g", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy("_g", "_part").orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(begins, ["_g", "_part"]).withColumn(name, F.col("_begin") + F.coalesce(F.sum("_m").over(within), F.lit(0)))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], name)
