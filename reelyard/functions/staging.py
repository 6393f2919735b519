"""Evaluate shared expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections may read many times.

    Adjacent projections are merged by the optimizer, so a ladder of ``CASE`` expressions
    that feeds another ladder is copied into it step by step until the generated code no
    longer compiles. A one-row ``inline`` keeps each value an attribute, and filters on other
    columns still move below it. It is compiled with its stage unless a higher-order
    function stands in the expressions, as in probe documents.
    """
    values = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(values)))
