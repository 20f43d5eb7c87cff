"""Numbers and running sums over a whole table in its order, without a task that holds all of it.

Rows are dealt into cells that follow the order, cells are summed map-side, one
task sums over the cells (of which there is a bounded number), and each cell is
then numbered on its own. A row's cell depends on the row alone, so both reads of
the table deal it alike, whatever was lost and computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.functions.columns import HASH_PRIME

#: Cells of an octave of numbers, and the octaves (powers of two) that are told apart.
PER_OCTAVE = 1024
OCTAVES = (-30, 63)
#: Cells of a 31-bit hash.
HASH_CELLS = 4096
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp", "decimal")


def clock_cell(t: Column) -> Column:
    """A whole number that never falls as ``t`` rises; numbers share one if they agree to about a 1024th.

    Fewer than 200,000 cells exist, two for each 1024th of the octaves. NaN counts
    as the largest number, null has a cell before all others.
    """
    low, high = OCTAVES
    size = F.least(F.abs(t.cast("double")), F.lit(2.0**high))
    octave = F.least(F.greatest(F.coalesce(F.floor(F.log2(size)), F.lit(low)), F.lit(low)), F.lit(high - 1))
    cell = (octave - low + 1) * PER_OCTAVE + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * PER_OCTAVE)
    return F.coalesce(F.when(t.cast("double") < 0, -cell).otherwise(F.when(t.isNotNull(), cell)), F.lit(-(1 << 62))).cast("long")


def hash_cell(h: Column) -> Column:
    """The cell of a :func:`hash31`, in its order; they are even."""
    return F.floor(h / F.lit(HASH_PRIME // HASH_CELLS + 1)).cast("long")


def value_cell(df: DataFrame, column: str) -> tuple[Column, bool]:
    """The cell of a column's values, and whether it follows their order; other than numbers are dealt by a hash."""
    kind = dict(df.dtypes)[column]
    if kind.startswith(_NUMERIC):
        return clock_cell(F.col(column)), True
    return F.shiftright(F.xxhash64(column), 52).cast("long"), False


def _offsets(marked: DataFrame, summed: Column) -> DataFrame:
    """``_cell, _before``: the sum over the cells before."""
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = marked.groupBy("_cell").agg(summed.alias("_sum"))
    return cells.select("_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, name: str, order: list, cell: Column) -> DataFrame:
    """Adds ``name``, the row's number from 0 in ``order``, which ``cell`` must follow."""
    marked = rows.withColumn("_cell", cell)
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    offsets = F.broadcast(_offsets(marked, F.count("*")))  # a row a cell
    return marked.withColumn("_place", place).join(offsets, "_cell").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_cell", "_before", "_place")


def running_sum(rows: DataFrame, name: str, value: str, clock: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` up to the row in the order of ``clock``, which must not repeat."""
    marked = rows.withColumn("_cell", clock_cell(F.col(clock)))
    w = Window.partitionBy("_cell").orderBy(clock).rowsBetween(Window.unboundedPreceding, 0)
    offsets = F.broadcast(_offsets(marked, F.sum(value)))  # a row a cell
    return marked.withColumn("_upto", F.sum(value).over(w)).join(offsets, "_cell").withColumn(name, F.col("_before") + F.col("_upto")).drop("_cell", "_before", "_upto")
