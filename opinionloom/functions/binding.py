"""Keep an expensive value from being computed more than once.

Long expressions are written as SQL text: one call into the JVM instead of hundreds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: str, name: str, body: str | Callable[[str], str]) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, which is evaluated once per row."""
    text = body(name) if callable(body) else body
    return f"get(transform(array({value}), {name} -> {text}), 0)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> str:
    """SQL text of a column, whatever characters its name has."""
    return "`" + name.replace("`", "``") + "`"


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read instead of recomputing.

    A filter on a ``withColumn`` result is pushed below the projection, expression and all, so the text would be
    cleaned once for the filter and once more for the output. Filters are not pushed through a generator.
    """
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
