"""Arrow UDFs that are made at their first use, so modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return call

    return decorate
