"""Stage snapshots."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from opinionloom.schemas import schema_differences, stage_schema


def read_snapshot(spark: SparkSession, path: str, stage: str | None = None, optional: Iterable[str] = ()) -> DataFrame:
    """SRC4: a Parquet snapshot; fails if it is not there.

    With a stage, its columns; a missing column that is not ``optional`` or one of another type is refused.
    """
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no snapshot at {path}") from error
    if stage is None:
        return found
    wrong = schema_differences(found, stage, optional)
    if wrong:
        raise ValueError(f"{path} doesn't fit stage {stage}: {'; '.join(wrong)}")
    return found.select(*(f.name for f in stage_schema(stage).fields if f.name in found.columns))


def read_first_snapshot(spark: SparkSession, *paths: str) -> DataFrame:
    """SRC5: the first of several snapshots that exists."""
    for path in paths:
        try:
            return read_snapshot(spark, path)
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"none of {list(paths)} exists")
