"""Functions of columns: vectors and printed numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` at length one; a zero vector as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def fixed(x: Column, digits: int) -> Column:
    """``x`` with so many digits as C and Python print it: by its exact binary value, ties to even. The JVM's formatter rounds the decimal it would print, half up."""

    def show(v: pd.Series) -> pd.Series:
        return v.map(lambda t: f"{t:.{digits}f}", na_action="ignore").astype(object)

    return F.pandas_udf(show, "string")(x.cast("double"))
