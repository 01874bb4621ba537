"""Quality rules on the frequency of lines across the documents of a host.

A line is normalised to its lower-cased words, one space between them. It counts once for each different
text of a host, and is boilerplate if it stands in more than a share `MAX_SHARE` of the host's different texts, and in
more than `FLOOR`. So the limit grows with the host, and copies of a text do not make its lines boilerplate. A
fixed limit of rows, `max_docs`, can be given instead. A document that is left with too few of its words once
they are removed is rejected, and so is one that fails the base rules of length and repetition.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import fresh, materialise, text_key

SALTS = 32
#: A line in more than this share of a host's different texts is boilerplate, and never one in FLOOR texts or fewer.
MAX_SHARE, FLOOR = 0.05, 5
_SYMBOLS = "#*$%&|<>"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,n:int>>"


def line_hash(line: bytes) -> int:
    """Hash of a line in its normal form, as a signed 64-bit integer."""
    return xxhash.xxh64_intdigest(b" ".join(line.translate(_LOWER).split()), 0) - (1 << 63)


def repeat_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            hit += at + 3 - max(at, end)
            end = at + 3
    return hit


def text_stats(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and each different line's hash and words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines: dict[bytes, int] = {}
    normal: dict[int, int] = {}
    dup = 0
    for line in raw.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        if line in lines:
            dup += 1
        lines[line] = lines.get(line, 0) + n
    for line, n in lines.items():
        h = line_hash(line)
        normal[h] = normal.get(h, 0) + n
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(map(text.count, _SYMBOLS))
    return len(words), len(text) - blanks, symbols, dup, repeat_words(words), [{"h": h, "n": n} for h, n in normal.items()]


def with_stats(docs: DataFrame, host_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, the host, and the statistics of each row's text, with its hash th in place of the text."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(_STATS)
    def run(texts: pd.Series) -> pd.DataFrame:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
        return pd.DataFrame([text_stats(t) for t in texts], columns=names)

    return docs.select(*keep, F.col(host_col).alias("host"), text_key(F.col(text_col)).alias("th"), run(F.col(text_col)).alias("s")).select(*keep, "host", "th", "s.*")


def host_limits(rows: DataFrame) -> DataFrame:
    """(host, most): in how many different texts of a host a line may stand; rows: (host, salt), one a text, counted by salt first."""
    texts = rows.groupBy("host", "salt").agg(F.count("*").alias("n"))
    return texts.groupBy("host").agg(F.greatest(F.floor(F.sum("n") * F.lit(MAX_SHARE)), F.lit(FLOOR)).alias("most"))


def frequent_lines(rows: DataFrame, max_docs: int | None = None, limits: DataFrame | None = None) -> DataFrame:
    """(host, h, salt): each line in more than max_docs rows of a host, or its limit, once for each salt that holds it.

    Counted by salt first, so that a line or host with a third of all rows is never gathered in one task.
    """
    salted = rows.groupBy("host", "h", "salt").agg(F.count("*").alias("n"))
    counted = salted.groupBy("host", "h").agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    if max_docs is not None:
        over = counted.filter(F.col("n") > max_docs)
    else:
        # no line that is in FLOOR texts or fewer passes, so that few rows meet the limits
        over = counted.filter(F.col("n") > FLOOR).join(limits, "host").filter(F.col("n") > F.col("most"))
    return over.select("host", "h", F.explode("salts").alias("salt"))


def _host_key(host: Column) -> Column:
    """A hash of the host, in which the null host differs from every text."""
    return F.xxhash64(F.coalesce(host.cast("string"), F.lit("")), host.isNull())


def _salt(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int").alias("salt")


def boilerplate(rows: DataFrame, max_docs: int | None) -> DataFrame:
    """(host, h, salt), for every salt, of the boilerplate lines; rows: (host, th, rid, hs).

    With max_docs each row counts, else each different text of a host.
    """
    texts = rows.groupBy("host", "th").agg(F.first("hs").alias("hs")) if max_docs is None else rows
    texts = texts.withColumn("salt", _salt("th" if max_docs is None else "rid"))
    lines = texts.select("host", "salt", F.explode("hs").alias("h"))
    found = frequent_lines(lines, max_docs, None if max_docs is not None else host_limits(texts)).select("host", "h").distinct()
    return found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def judge(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    max_docs: int | None = None,
    min_words: int = 50,
    min_share: float = 0.5,
) -> DataFrame:
    """The columns `keep` with the statistics, base_failed, removed_words and kept, one row for each row of docs.

    Every row is a document of its own, repeated rows and null ids included. Null texts count as empty, have
    no lines and fail the base rules; rows without host share the host null. max_docs: a fixed limit instead of the
    share, in rows, repeated texts included. kept: not base_failed, and
    without the frequent lines at least min_words words and min_share of all words remain.
    """
    rid, *names = fresh(docs, "rid", *[f"kept_{k}" for k in range(len(keep))])
    chosen = docs.withColumnsRenamed(dict(zip(keep, names, strict=True)))
    stats = with_stats(chosen, host_col if host_col not in keep else names[keep.index(host_col)], text_col, names)
    # written, so that the row numbers hold from here on
    stats = materialise(stats.withColumn(rid, F.monotonically_increasing_id()), "quality-stats")
    rows = stats.select(_host_key(F.col("host")).alias("host"), "th", F.col(rid).alias("rid"), "lines")
    frequent = boilerplate(rows.select("host", "th", "rid", F.col("lines.h").alias("hs")), max_docs)
    lines = rows.select("host", "rid", _salt("rid"), F.explode("lines").alias("l")).select("host", "rid", "salt", "l.h", "l.n")
    removed = lines.join(frequent, ["host", "h", "salt"]).groupBy(F.col("rid").alias(rid)).agg(F.sum("n").alias("removed_words"))
    out = stats.drop("lines", "host", "th").join(removed, rid, "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~failed & (left >= min_words) & (left >= min_share * F.col("n_words")))
    return out.drop(rid).withColumnsRenamed(dict(zip(names, keep, strict=True)))


def clean_text(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_docs: int | None = None) -> DataFrame:
    """docs with the frequent lines of each host cut from text_col; null texts stay null."""
    rid, h, cut = fresh(docs, "rid", "line_hashes", "line_cut")
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [line_hash(x) if x.split() else None for x in (t or "").encode().split(b"\n")])

    rows = materialise(docs.withColumns({rid: F.monotonically_increasing_id(), h: hashes(F.col(text_col))}), "quality-lines")
    lines = rows.select(_host_key(F.col(host_col)).alias("host"), text_key(F.col(text_col)).alias("th"), F.col(rid).alias("rid"), F.array_compact(F.array_distinct(h)).alias("hs"))
    frequent = boilerplate(lines, max_docs)
    held = lines.select("host", "rid", _salt("rid"), F.explode("hs").alias("h"))
    gone = held.join(frequent, ["host", "h", "salt"]).groupBy(F.col("rid").alias(rid)).agg(F.collect_set("h").alias(cut))
    out = rows.join(gone, rid, "left")
    parts = F.filter(F.arrays_zip(F.split(text_col, "\n").alias("line"), F.col(h).alias("h")), lambda x: x["h"].isNull() | ~F.array_contains(F.col(cut), x["h"]))
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"))
    return out.withColumn(text_col, text).drop(rid, h, cut)
