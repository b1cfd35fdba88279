"""Column expressions that others are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(f: Callable[..., Column], *columns: Column) -> Column:
    """``f`` of columns that are computed once a row. Within a function of an array, Spark would compute what a column stands for again for each element."""
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return F.get(F.transform(F.array(row), lambda r: f(*[r[f"c{i}"] for i in range(len(columns))])), F.lit(0))
