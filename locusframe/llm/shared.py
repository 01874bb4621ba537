"""What several corpus operators need: shared storage, row identity and free column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise as materialise
from ..storage import shared_dir as shared_dir


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not use yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """With the document id, the identity of a row: rows equal in both are one document."""
    return F.xxhash64(text)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; lower() is the same and quicker where all characters are ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def hashed_sample(rows: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """At most `most` of the n rows, those with the smallest key, a 64-bit hash.

    As keys are even, twice the rows wanted lie below a cut that n tells beforehand, so a task passes on few
    rows, and the smallest are taken from those.
    """
    (name,) = fresh(rows, "sample_key")
    keyed = rows.withColumn(name, key)
    if n > 2 * most:
        keyed = keyed.filter(F.col(name) <= -(1 << 63) + int((1 << 64) * (2 * most / n)))
    return keyed.orderBy(name).limit(most).drop(name)
