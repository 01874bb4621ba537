"""Benchmark decontamination by a prefix-filtered set join.

An item contributes windows of `width` (13) consecutive words, or all its words if it has fewer. A window
occurs in a document only if all its words do, so a prefix of one word is enough to find it: its rarest
word in the whole corpus. Document words join these prefixes; the word's place in the window and the
document's length bound where the window can lie, and the slice there is compared word by word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, lower_ascii, materialise, text_key

#: Most windows (and distinct benchmark words) that are broadcast at once; more are taken in blocks.
BROADCAST_WINDOWS = 50_000
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of letters a-z, digits and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(text), _DELIMITERS), "")


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(w1, w2, item, window): each window of each item; w1 and w2 are its 128-bit key. Items without id are left out."""
    ws = benchmark.filter(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("ws")
    )
    n = F.size("ws")
    size = F.least(F.lit(width), n)
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.slice("ws", i, size)))
    rows = ws.select("item", F.explode_outer(cut).alias("window")).filter("window is not null")
    return rows.select(
        F.xxhash64("window").alias("w1"), F.xxhash64(F.lit("second"), "window").alias("w2"), "item", "window"
    ).distinct()


def _word_counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word of the benchmark stands in the corpus: (word, df)."""
    if vocabulary.count() <= BROADCAST_WINDOWS:
        return words.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    return words.groupBy("word").agg(F.count("*").alias("df")).join(vocabulary, "word", "left_semi")


def find_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of windows in docs: (id, th, start, n, w1, w2).

    Null and empty texts and an empty set of windows have none; rows equal in id and text give the same rows, once for each.
    """
    base = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), words_of(F.col(text_col)).alias("ws"))
    spoken = base.select(F.explode_outer("ws").alias("word"))
    distinct = windows.select("w1", "w2", "window").distinct()
    each = distinct.select("w1", "w2", "window", F.posexplode("window").alias("at", "word"))
    counts = _word_counts(spoken, materialise(each.select("word").distinct(), "benchmark-words"))
    # a word that the corpus lacks has no row here, and a window that holds one cannot occur
    rated = each.join(counts, "word", "left").groupBy("w1", "w2").agg(
        F.min_by(F.struct("word", "at", "window"), F.struct(F.coalesce("df", F.lit(0)), F.col("word"), F.col("at"))).alias("p"),
        F.min(F.coalesce("df", F.lit(0))).alias("df"),
    )
    prefixes = materialise(rated.filter("df > 0").select("w1", "w2", "p.word", "p.at", "p.window"), "benchmark-prefixes")
    blocks = math.ceil(prefixes.count() / BROADCAST_WINDOWS) or 1
    out = None
    for block in range(blocks):
        part = prefixes.filter(F.pmod("w1", F.lit(blocks)) == block)
        rows = base.select("id", "th", "ws", F.posexplode_outer("ws").alias("pos", "word"))
        start, n = F.col("pos") - F.col("at"), F.size("window")
        fits = (start >= 0) & (start + n <= F.size("ws"))
        hit = (
            rows.join(F.broadcast(part), "word")
            .filter(fits)
            .filter(F.slice("ws", F.greatest(start, F.lit(0)) + 1, n) == F.col("window"))
            .select("id", "th", start.alias("start"), n.alias("n"), "w1", "w2")
        )
        out = hit if out is None else out.unionAll(hit)
    return out


def with_items(found: DataFrame, windows: DataFrame) -> DataFrame:
    """found (id, th, w1, w2) with items, the items of each window: they are gathered by window, a row each, and broadcast in
    blocks, so that a window that a third of the corpus shares is not dealt to one task."""
    per_window = materialise(windows.groupBy("w1", "w2").agg(F.collect_set("item").alias("items")), "window-items")
    blocks = math.ceil(per_window.count() / BROADCAST_WINDOWS) or 1
    own = [F.broadcast(per_window.filter(F.pmod("w1", F.lit(blocks)) == k)) for k in range(blocks)]
    return reduce(DataFrame.unionAll, [found.join(part, ["w1", "w2"]) for part in own])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    width: int = 13,
    share: int = 20,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    Contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have no words and are clean;
    an empty benchmark hits nothing; items repeated under one id count once; items without words have no
    windows. Rows equal in id and text are one document, null ids included. Other columns pass through
    (a column of docs named like a result is replaced).
    """
    results = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    docs = docs.drop(*results)
    windows = materialise(item_windows(benchmark, item_col, "text", width), "benchmark-windows")
    found = materialise(find_windows(docs, windows, id_col, text_col).distinct(), "benchmark-hits")
    run = Window.partitionBy("id", "th").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("id", "th", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    covered = spans.select(
        "id", "th", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(run), F.lit(0)))).alias("new")
    ).groupBy("id", "th").agg(F.sum("new").alias("n_hit"))
    items = (
        with_items(found.select("id", "th", "w1", "w2").distinct(), windows)
        .groupBy("id", "th")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    )
    hits = covered.join(items.withColumnsRenamed({"id": "id_", "th": "th_"}), F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")))
    key, i, t, hit, names = fresh(docs, "row_th", "hit_id", "hit_th", "hit_words", "hit_items")
    hits = hits.select(F.col("id").alias(i), F.col("th").alias(t), F.col("n_hit").alias(hit), F.col("item_ids").alias(names))
    # counted before the join, so that a caller who drops the text does not shuffle it
    ws = F.size(words_of(F.col(text_col)))
    counted = docs.withColumns(
        {key: text_key(F.col(text_col)), "n_words": F.when(F.col(text_col).isNull(), 0).otherwise(ws).cast("long")}
    )
    out = counted.join(hits, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(key) == F.col(t)), "left")
    out = out.withColumns(
        {"n_hit": F.coalesce(hit, F.lit(0)).cast("long"), "item_ids": F.coalesce(names, F.array().cast("array<string>"))}
    ).drop(key, i, t, hit, names)
    return out.withColumns(
        {
            "n_items": F.size("item_ids").cast("long"),
            "contaminated": (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")),
        }
    )
