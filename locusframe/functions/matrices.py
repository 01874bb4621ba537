"""Positive-definite helpers for 2 x 2 matrices [[a, b], [c, d]] as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_symmetric(b: Column, c: Column, tolerance: float = 1e-8) -> Column:
    return F.abs(b - c) <= tolerance


def is_positive_definite(a: Column, b: Column, c: Column, d: Column, tolerance: float = 1e-8) -> Column:
    """Symmetric, and both leading minors are positive."""
    return is_symmetric(b, c, tolerance) & (a > 0) & (a * d - b * c > 0)


def make_positive_definite(a: Column, b: Column, c: Column, d: Column, floor: float = 1e-6) -> dict[str, Column]:
    """The symmetric part (a, b, d) with eigenvalues that are not positive lifted to floor."""
    b = (b + c) / 2
    middle, half = (a + d) / 2, F.sqrt((a - d) * (a - d) / 4 + b * b)
    high, low = middle + half, middle - half
    lifted = [F.when(x > 0, x).otherwise(floor) for x in (high, low)]
    # (m - low) / (high - low) is the projection on the higher eigenvector
    share = F.when(half > 0, (lifted[0] - lifted[1]) / (2 * half)).otherwise(0.0)
    return {"a": share * (a - low) + lifted[1], "b": share * b, "d": share * (d - low) + lifted[1]}
