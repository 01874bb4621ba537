"""Line dedup over overlapping windows of consecutive lines.

A window is `window` (three) consecutive lines of a text split at \\n. Windows are compared across the
whole corpus by a 128-bit hash; the first occurrence, by document id and then position, stays, and the
lines that any later occurrence covers go. Each removed line is still present where it occurred first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, text_key

SALTS = 64


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row (id, th, salt, pos, h1, h2) for each window."""
    lines = F.split(F.col(text_col), "\n")
    base = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), lines.alias("ls"))

    def hashes(i: Column) -> Column:
        part = [F.get(F.col("ls"), i + k) for k in range(window)]
        return F.struct(F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit("second"), *part).alias("h2"))

    n = F.size("ls")
    found = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), hashes))
    # the outer form keeps Catalyst from evaluating the array a second time for a size filter
    rows = base.select("id", "th", F.posexplode_outer(found).alias("pos", "h"))
    return rows.filter("h is not null").select(
        "id", "th", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int").alias("salt"), "pos", "h.h1", "h.h2"
    )


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Every window occurrence after the first: (id, th, pos).

    Null and empty texts and those of fewer lines than a window have none; null ids come first, and of one id the
    smaller text hash. Rows equal in id and text are one document, whose occurrences all count as the first.
    Counts are taken per (window, salt) and only then per window; the repeated windows go back to the salts
    that hold them, so a window that a third of the corpus shares spreads over up to 64 tasks.
    """
    rows = _windows(docs, id_col, text_col, window)
    salted = rows.groupBy("h1", "h2", "salt").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "th", "pos")).alias("first")
    )
    keys = salted.groupBy("h1", "h2").agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.collect_set("salt").alias("salts"),
    )
    repeated = keys.filter("n > 1").select("h1", "h2", "first", F.explode("salts").alias("salt"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))
    return rows.join(repeated, ["h1", "h2", "salt"]).filter(~same).select("id", "th", "pos")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, report: bool = False
) -> DataFrame:
    """docs with the later occurrences of repeated windows cut from text_col.

    Null text stays null and an empty text empty; texts of fewer lines than a window are left as they are.
    A text all of whose lines go becomes empty; no row is dropped. Rows equal in id and text are one
    document and get the same result; null ids come first in the order. Other columns pass through.
    report=True adds n_lines and n_removed; columns of docs so named are replaced.
    """
    i, t, starts, cut, ls = fresh(docs, "dedup_id", "dedup_th", "dedup_starts", "dedup_cut", "dedup_lines")
    later = (
        later_windows(docs, id_col, text_col, window)
        .groupBy("id", "th")
        .agg(F.collect_set("pos").alias(starts))
        .select(F.col("id").alias(i), F.col("th").alias(t), starts)
    )
    joined = docs.join(later, docs[id_col].eqNullSafe(F.col(i)) & (text_key(docs[text_col]) == F.col(t)), "left")
    lines = F.split(F.col(text_col), "\n")
    covered = F.array_distinct(F.flatten(F.transform(F.col(starts), lambda s: F.sequence(s, s + window - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(cut))
    out = joined.withColumns({cut: covered, ls: lines})
    if report:
        out = out.withColumns(
            {
                "n_lines": F.when(F.col(ls).isNull(), 0).otherwise(F.size(ls)).cast("long"),
                "n_removed": F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long"),
            }
        )
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda k: F.get(F.col(ls), k)), "\n")
    )
    return out.withColumn(text_col, text).drop(i, t, starts, cut, ls)
