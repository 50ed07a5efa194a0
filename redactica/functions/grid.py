"""Joins of intervals and of boxes through bins: no row meets one that is not near it.

Boxes lie in the cells of grids, the cells of each grid being twice as large as those of the one before. A box belongs to the grid of its
own size, where it touches four cells at most; two boxes meet in the coarser of their grids. However large a box or crowded a page is,
each is written out a few times for every grid in use, of which there are some sixty at most.

The optimizer takes what is written out to be as small as the table it comes from, and would send it whole through the driver; `apart`
keeps it where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a page that the finest cells are wide.
CELL = 16.0
#: Characters of a bin of offsets.
BIN = 64
SIDES = ("x0", "y0", "x1", "y1")


def apart(rows: DataFrame) -> DataFrame:
    """Rows to join by a shuffle of both sides, whatever size the optimizer takes them for."""
    return rows.hint("merge")


def _grid(side: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(CELL)) / CELL))).cast("int")


def _celled(rows: DataFrame, box: tuple[Column, Column, Column, Column], name: str, grids: list[int]) -> DataFrame:
    """Rows with their grid, once for each cell in each grid that is no finer."""
    x0, y0, x1, y1 = box
    placed = rows.withColumn(f"_{name}", _grid(F.greatest(x1 - x0, y1 - y0)))
    placed = placed.withColumn("_grid", F.explode(F.filter(F.lit(grids).cast("array<int>"), lambda g: g >= F.col(f"_{name}"))))
    size = F.lit(CELL) * F.pow(F.lit(2.0), F.col("_grid"))
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(F.greatest(a, b) / size)))
    return placed.withColumn("_cx", cell(x0, x1)).withColumn("_cy", cell(y0, y1))


def meeting(a: DataFrame, b: DataFrame, on: list[str], cond: Column | str, a_box: tuple[str, ...] = SIDES, b_box: tuple[str, ...] = SIDES, tolerance: float = 0.0) -> DataFrame:
    """Pairs of rows of a and b that agree in `on` and whose boxes, b's being widened by the tolerance, share a cell where they meet, and
    for which the condition holds; a pair comes once. Other columns must differ in their names. Boxes with nulls meet none."""
    box = lambda names, by: tuple(F.col(n) + F.lit(s * by) for n, s in zip(names, (-1.0, -1.0, 1.0, 1.0), strict=True))
    left, right = box(a_box, 0.0), box(b_box, tolerance)
    own = lambda rows, c: rows.select(_grid(F.greatest(c[2] - c[0], c[3] - c[1])).alias("g")).distinct()
    grids = sorted(r.g for r in own(a, left).unionByName(own(b, right)).distinct().collect() if r.g is not None)
    keys = [*on, "_grid", "_cx", "_cy"]
    rows = apart(_celled(a, left, "ga", grids)).join(apart(_celled(b, right, "gb", grids)), keys)
    size = F.lit(CELL) * F.pow(F.lit(2.0), F.col("_grid"))
    first = (F.col("_cx") == F.greatest(F.floor(left[0] / size), F.floor(right[0] / size))) & (F.col("_cy") == F.greatest(F.floor(left[1] / size), F.floor(right[1] / size)))
    met = rows.filter((F.col("_grid") == F.greatest("_ga", "_gb")) & first & (F.expr(cond) if isinstance(cond, str) else cond))
    return met.drop("_grid", "_cx", "_cy", "_ga", "_gb")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str]) -> DataFrame:
    """Pairs of rows whose half-open intervals of offsets overlap; a pair comes once, in the first bin that both touch."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / BIN), F.floor(F.greatest(F.col(s), F.col(e) - 1) / BIN)))
    (s, e), (start, end) = a_ends, b_ends
    rows = apart(a.withColumn("_bin", bins(s, e))).join(apart(b.withColumn("_bin", bins(start, end))), [*on, "_bin"])
    return rows.filter((F.col(end) > F.col(s)) & (F.col(start) < F.col(e)) & (F.col("_bin") == F.floor(F.greatest(s, start) / BIN))).drop("_bin")
