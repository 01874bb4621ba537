"""Errors raised by the engine, and checks that raise them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EngineError(ValueError):
    """Input or parameters that the engine cannot work with."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no row."""
    if df.isEmpty():
        raise EngineError(f"no {what} left")
    return df


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, or an error that names a repeated key."""
    twice = df.groupBy(*key).count().filter("count > 1").first()
    if twice is not None:
        raise EngineError(f"repeated {', '.join(key)}: {', '.join(str(twice[k]) for k in key)}")
    return df
