"""Exact, repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionloom.functions.lookups import lookup_join
from opinionloom.session import written

SAMPLE_ROWS = 50_000
SEED = 42
BUCKET_DIGITS = 3


def draw_key(id_col: str, seed: int = SEED) -> Column:
    """A pseudo-random sort key that depends on the row id and the seed alone, not on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def simple_sample(df: DataFrame, n: int, seed: int = SEED, id_col: str = "review_id") -> DataFrame:
    """SMP2: ``n`` rows in draw order."""
    return df.orderBy(draw_key(id_col, seed), id_col).limit(n)


def head(df: DataFrame, n: int, id_col: str = "review_id") -> DataFrame:
    """LIM2: the first ``n`` rows by id."""
    return df.orderBy(id_col).limit(n)


def sample_quota(cap: int, stratum_rows: Column, total_rows: int) -> Column:
    """Rows to draw from a stratum: its share of ``cap``, at least one."""
    return F.greatest(F.lit(1), F.floor(F.lit(cap) * stratum_rows / F.lit(total_rows))).cast("long")


def stratified_sample(
    df: DataFrame, cap: int = SAMPLE_ROWS, stratum: str = "rating", seed: int = SEED, id_col: str = "review_id"
) -> DataFrame:
    """SMP1: an exact share of every stratum, or all rows that have one when these are no more than ``cap``.

    Two passes, and no stratum is ever sorted in one place. The first counts rows per stratum and key bucket (the
    leading hex digits of the draw key); that gives the bucket in which each stratum's quota ends. In the second, rows
    of earlier buckets pass, and only those of the last bucket are ranked: about one in ``16 ** BUCKET_DIGITS``.
    Rows without a stratum are not drawn. Rows that share key and id are drawn in any order among themselves.
    """
    known = df.filter(F.col(stratum).isNotNull())
    keyed = known.withColumn("_key", draw_key(id_col, seed)).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    buckets = written(keyed.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "draw-buckets")
    total = buckets.agg(F.sum("_n")).first()[0] or 0
    if total <= cap:
        return known
    upto = F.sum("_n").over(Window.partitionBy(stratum).orderBy("_bucket"))  # a few thousand rows per stratum
    rows = F.sum("_n").over(Window.partitionBy(stratum))
    marks = (
        buckets.select(stratum, "_bucket", (upto - F.col("_n")).alias("_before"), sample_quota(cap, rows, total).alias("_quota"))
        .filter(F.col("_before") < F.col("_quota"))
        .groupBy(stratum)
        .agg(F.max(F.struct("_bucket", (F.col("_quota") - F.col("_before")).alias("_left"))).alias("_last"))
    )
    placed = lookup_join(keyed, marks, stratum)
    passed = placed.filter(F.col("_bucket") < F.col("_last._bucket")).select(*df.columns)
    order = Window.partitionBy(stratum).orderBy("_key", id_col)
    edge = placed.filter(F.col("_bucket") == F.col("_last._bucket")).withColumn("_rank", F.row_number().over(order))
    return passed.unionByName(edge.filter(F.col("_rank") <= F.col("_last._left")).select(*df.columns))
