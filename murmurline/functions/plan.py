"""Small helpers that shape a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, keep: list[str], computed: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``computed`` columns, evaluated once and here.

    A filter above a projection is pushed below it with every alias replaced by its expression, which
    multiplies long expressions.  Filters don't pass a generator's own output, so the computed columns
    come out of ``inline`` over an array of one struct; the stage stays in generated code.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in computed.items()]))))
