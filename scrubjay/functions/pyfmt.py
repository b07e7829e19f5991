"""Python number formatting for report text.

Spark's ``round``/``format_string`` round half-up on the shortest decimal form
(``round(2.675, 2)`` gives 2.68, ``'%.1f' % 0.25`` gives ``0.3``); Python rounds the exact
binary value half-to-even (2.67, ``0.2``).  The reports quote Python's numbers, so the
few report cells that need it go through these Arrow-batched helpers.  They run on
report-sized frames (one row per run or per group), never per observation row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.DoubleType())
def _py_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits)],
                     dtype="object")


@F.pandas_udf(T.StringType())
def _py_fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else format(float(v), f".{int(d)}f")
                      for v, d in zip(x, digits)], dtype="object")


def py_round(c: Column, digits: int) -> Column:
    return _py_round(c.cast("double"), F.lit(digits))


def py_fixed(c: Column, digits: int) -> Column:
    return _py_fixed(c.cast("double"), F.lit(digits))


def py_str(c: Column) -> Column:
    """``str(x)`` of a float that is already rounded to a few decimals (e.g. ``20.14``,
    ``5.0``): Java's shortest representation agrees with Python's in that range."""
    return c.cast("double").cast("string")


def thousands(c: Column) -> Column:
    """``f"{n:,}"`` for integers."""
    return F.format_number(c.cast("long"), 0)
