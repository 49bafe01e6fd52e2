"""Pandas functions on columns that can be defined before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorates fn(series, ..) -> series; the column function is made when it is used.

    It is marked so that the optimiser doesn't move it into a lambda, where
    Python functions can't run.
    """

    def put(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*cols) -> Column:
            return F.pandas_udf(fn, schema).asNondeterministic()(*cols)

        return call

    return put
