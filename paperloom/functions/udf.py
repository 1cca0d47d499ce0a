"""Arrow UDFs that are made on first use, so that modules import without a session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def arrow_udf(kind: str):
    """Like pandas_udf with a DDL type."""

    def wrap(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
