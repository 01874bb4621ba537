"""Small corpora with the cases that every operator has to bear."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import DataFrame, SparkSession

#: Extra columns with names that operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, th long, h long, n long, slot int, keep boolean, fp long, host string"


def frame(spark: SparkSession, rows: list[tuple], lang: str | None = "en") -> DataFrame:
    """rows: (doc_id, text); with all the clashing columns."""
    full = [(i, t, lang, "src0", None, 0.5, 7, 7, 7, 7, 7, True, 7, "x") for i, t in rows]
    return spark.createDataFrame(full, CLASHING)


def words(seed: int, n: int, alphabet: str = "abcdefghij") -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices(alphabet, k=rnd.randint(2, 6))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null ids and texts, empty and blank texts, repeated rows, ties, a long text."""
    long = words(99, 20_000)
    return [(None, None), (None, "a null id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "twice here"), (5, "twice here"), (6, "same\nthree\nlines"), (7, "same\nthree\nlines"), (8, long), (9, long), (9, "ünï 漢字 \x00 🙂"), (10, "x" * 50_000)]


def fold(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5
