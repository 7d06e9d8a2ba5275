"""Confidences that say how often a label is right: isotonic regression over cells of the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells a score between 0 and 1 falls into; they bound what comes to the driver.
CELLS = 100


def score_cell(score: Column, cells: int = CELLS) -> Column:
    """The cell of a score from 0 to 1; 1 itself is in the last, null in none."""
    cell = F.floor(score.cast("decimal(9,4)") * cells)
    return F.when(cell.isNotNull(), F.least(cell, F.lit(cells - 1))).cast("int")


def pool_adjacent_violators(cells: list[tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """For rows ``(cell, right, n)`` in ascending order the least-squares rising fit: per cell the ``(right, n)`` of its pool.

    Neighbouring pools merge while the earlier has the larger share; shares are compared in whole numbers.
    """
    pools: list[list] = []
    for cell, right, n in cells:
        pools.append([right, n, [cell]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            later = pools.pop()
            pools[-1] = [pools[-1][0] + later[0], pools[-1][1] + later[1], pools[-1][2] + later[2]]
    return {cell: (right, n) for right, n, own in pools for cell in own}


def fit_calibration(df: DataFrame, score: Column, right: Column, cells: int = CELLS) -> list[float | None]:
    """The calibrated score of every cell, from rows with a score and whether the label was right; rows where either is null
    don't count. A cell without rows has the value of the next lower one, else of the next higher one; without any
    rows all are null."""
    rows = df.select(score_cell(score, cells).alias("cell"), right.cast("long").alias("right")).dropna()
    counted = rows.groupBy("cell").agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    fitted = pool_adjacent_violators([(r["cell"], r["right"], r["n"]) for r in counted])
    values: list[float | None] = [fitted[c][0] / fitted[c][1] if c in fitted else None for c in range(cells)]
    for c in [*range(1, cells), *range(cells - 2, -1, -1)]:
        if values[c] is None:
            near = values[c - 1] if c and values[c - 1] is not None else values[c + 1] if c + 1 < cells else None
            values[c] = near
    return values


def calibrated(score: Column, values: list[float | None]) -> Column:
    """The calibrated score as a column expression; null for a null score."""
    return F.get(F.array(*map(F.lit, values)).cast("array<double>"), score_cell(score, len(values)))


def calibration_error(df: DataFrame, score: Column, right: Column, cells: int = CELLS) -> float:
    """The mean distance between score and share of right labels over the cells, weighted by their rows."""
    rows = df.select(score_cell(score, cells).alias("cell"), score.alias("score"), right.cast("double").alias("right")).dropna()
    per_cell = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum("score") - F.sum("right")).alias("off"))
    return per_cell.agg(F.sum("off") / F.sum("n")).first()[0]
