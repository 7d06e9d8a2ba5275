"""Rows by position: dense row numbers without a window over the table, and the join of two tables row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionloom.functions.binding import column
from opinionloom.session import written

#: ``monotonically_increasing_id`` holds the partition above these bits and the place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str], number: str = "position", partitions: int | None = None) -> DataFrame:
    """JOIN7: add the place of each row in the order of some columns, from 0 on.

    The rows are sorted by ranges, numbered within their range and written. The ranges' sizes then give where each of them
    begins; only these sizes, a row per range, are summed up in one task. Rows equal in all order columns get
    their places in any order; add columns that tell them apart where that matters.
    """
    keys = [column(c) for c in order]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    place = F.monotonically_increasing_id()
    settled = written(dealt.sortWithinPartitions(*keys).withColumn("_place", place), "numbered")
    part = F.shiftright("_place", PLACE_BITS)
    sizes = settled.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    rows = settled.withColumn("_part", part).join(starts, "_part")
    own = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.withColumn(number, F.col("_start") + own).drop("_part", "_place", "_start")


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], how: str = "inner") -> DataFrame:
    """JOIN7: the tables side by side, the first row of one with the first of the other; ``how`` says what becomes of the
    rows the other table has no place for."""
    return numbered(left, left_order).join(numbered(right, right_order), "position", how)
