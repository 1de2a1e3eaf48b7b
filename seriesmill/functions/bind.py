"""Computing a column once inside an expression that uses it often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value as the variable of a lambda, so that its expression is in the plan once."""
    return F.get(F.transform(F.array(value), then), 0)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as its last column `name`, computed once for each row.

    The value comes out of a generator, which the optimizer neither copies into later expressions nor moves
    a predicate on it through.
    """
    return df.select(*(f"`{c}`" for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
