"""Row numbers and running totals over a whole table without one task that sees all rows.

Rows are dealt out by ranges of the sort key; each range is numbered by itself and then
moved by what the ranges before it hold, which is one small row for each partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch


def _ranged(rows: DataFrame, order: list[str], total: Column) -> tuple[DataFrame, Column]:
    # Written, so that both passes see the same ranges.
    ranged = scratch(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = sorted((r["__part"], r["t"]) for r in ranged.groupBy("__part").agg(total.alias("t")).collect())
    before = [0, *accumulate(t for _, t in sums)]
    pairs = [x for (part, _), b in zip(sums, before) for x in (F.lit(part), F.lit(int(b)).cast("long"))]
    return ranged, F.element_at(F.create_map(*pairs), F.col("__part")) if pairs else F.lit(0).cast("long")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their place in the order, from 0. Ties are placed arbitrarily."""
    ranged, base = _ranged(rows, order, F.count(F.lit(1)))
    own = Window.partitionBy("__part").orderBy(*order)
    return ranged.withColumn(name, F.row_number().over(own).cast("long") - 1 + base).drop("__part")


def running_total(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them."""
    ranged, base = _ranged(rows.withColumn("__v", value.cast("long")), order, F.sum("__v"))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, F.coalesce(F.sum("__v").over(own), F.lit(0)).cast("long") + base).drop("__part", "__v")
