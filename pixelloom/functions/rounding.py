"""Rounding of the exact binary value, ties to even, as Python's ``round`` does.

Spark's ``round`` works on the shortest decimal of a double: 2.675 becomes 2.68, though the
double is less than that. Reports round as Python does; the tables of stages, which SQL
compares, keep Spark's.
"""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _rounded(digits: int):
    @F.pandas_udf("double")
    def f(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else round(v, digits) for v in values.tolist()], dtype="float64")

    return f


def exact_round(x: Column, digits: int) -> Column:
    """``x`` to so many decimals; null stays null, and so does what is no number."""
    return _rounded(digits)(x.cast("double"))
