"""Arrow functions that are made when first used: a return type in DDL needs a session, an import must not."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        made: list[Callable[..., Column]] = []

        @wraps(f)
        def call(*columns) -> Column:
            if not made:
                made.append(F.pandas_udf(f, returns))
            return made[0](*columns)

        return call

    return wrap
