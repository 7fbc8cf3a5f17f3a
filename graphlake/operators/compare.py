"""Comparison of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidError


def differences(left: DataFrame, right: DataFrame, side: str = "side") -> DataFrame:
    """Rows, repeats counted, that only one of two tables of the same columns has, and which: 'left' or 'right'."""
    if sorted(left.columns) != sorted(right.columns):
        raise InvalidError("tables to compare have unlike columns")
    right = right.select(*(f"`{c}`" for c in left.columns))
    only = [a.exceptAll(b).withColumn(side, F.lit(name)) for a, b, name in ((left, right, "left"), (right, left, "right"))]
    return only[0].unionByName(only[1])
