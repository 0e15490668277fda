"""Arrow functions that are made where they are called: workers import their modules without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(return_type: str, once: bool = False) -> Callable:
    """A Python function over batches as a Column. With ``once`` the planner never evaluates it a second time for a filter or another column."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            made = F.pandas_udf(f, return_type)
            return (made.asNondeterministic() if once else made)(*columns)

        return call

    return decorate
