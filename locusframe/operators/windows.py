"""Window and ordered-scan operators.

Greedy scans whose next step depends on the one before: tumbling windows compose what each bin of positions does with a
window that reaches into it; binning follows pointers that double each round; pruning runs in pandas, one connected component of
links at a time, as each of its steps depends on those before in the whole component. All else is a window expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EngineError
from ..storage import materialise
from .filters import reindex, running_sum


def window_info(variants: DataFrame, width: int) -> DataFrame:
    """for each variant (chrom, pos, idx) the first index, last index and size of the run with
    |distance| < width // 2 on its chromosome.

    Chromosomes are cut at bins of positions, each with those of its neighbours that its own may reach, so no
    task holds a chromosome and a row is in two bins at most.
    """
    reach = width // 2 - 1
    if reach < 0:
        raise EngineError(f"a window of {width} reaches nothing")
    size = max(1000, 4 * reach)
    own = F.floor(F.col("pos") / size)
    bins = F.sequence(F.floor((F.col("pos") - reach) / size), F.floor((F.col("pos") + reach) / size))
    near = Window.partitionBy("chrom", "__bin").orderBy("pos").rangeBetween(-reach, reach)
    spread = variants.withColumn("__bin", F.explode(bins)).select(
        "*", F.min("idx").over(near).alias("window_start"), F.count("*").over(near).alias("window_size"), F.max("idx").over(near).alias("window_end")
    )
    return spread.filter(F.col("__bin") == own).drop("__bin")


#: Bins, or groups of them, that one task composes.
_GROUP = 64


def _first_above(entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the first entry above each number; the length where there is none."""
    return np.searchsorted(entries, at, side="right")


def _through(children: list[tuple[np.ndarray, np.ndarray]], reach: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """How far the last window reaches before each child, and behind the last one. A child is (entries, exits): its first
    window starts at the first entry out of reach, and its last one at the exit beside; without such an entry it has no start."""
    for entries, exits in children:
        yield reach
        k = _first_above(entries, reach)
        reach = np.where(k < len(entries), exits[np.minimum(k, len(entries) - 1)] + width, reach)
    yield reach


def tumbling_windows(variants: DataFrame, width: int) -> DataFrame:
    """adds window, numbered from 0 over all chromosomes; a variant farther than width from the window's first
    variant, or on the next chromosome, opens the next.

    Where a window starts depends on all before it, so the chain is composed: a bin of positions, wider than a window, says
    for each of the few positions at which its first window may start where its last one does. Runs of bins are
    composed to one such map, and those again, until a chromosome is one; going down, each bin gets its first start and
    finds its others. A task holds the positions of one bin or the maps of _GROUP, never a chromosome.
    """
    size = max(4 * width, 1_000_000)
    places = variants.select(F.col("chrom").cast("int").alias("chrom"), F.col("pos").cast("long").alias("pos")).distinct()
    binned = materialise(places.withColumn("bin", F.floor(F.col("pos") / size)), "places")

    def describe(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(rows["pos"].to_numpy())
        jump = np.minimum(_first_above(pos, pos + width), len(pos))
        last = np.append(np.where(jump < len(pos), jump, np.arange(len(pos))), len(pos))
        while (further := last[last]).tobytes() != last.tobytes():
            last = further
        # a window that began before the bin ends before its start plus width
        n = _first_above(pos, key[1] * size + width) + 1
        return pd.DataFrame({"chrom": [key[0]], "at": [key[1]], "entries": [pos[:n]], "exits": [pos[last[:-1]][:n]]})

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        children = list(zip(rows["entries"], rows["exits"], strict=True))
        # of the second child only the first position can be the group's first start
        entries = np.concatenate([children[0][0], *[c[0][:1] for c in children[1:2]]])
        *_, reach = _through(children, entries - 1, width)
        return pd.DataFrame({"chrom": [key[0]], "at": [key[1]], "entries": [entries], "exits": [reach - width]})

    maps, shape = "chrom int, at long, entries array<long>, exits array<long>", "chrom int, at long, reach long"
    levels = [materialise(binned.groupBy("chrom", "bin").applyInPandas(describe, maps), "bins")]
    spread = levels[0].agg(F.min("at"), F.max("at")).first()
    low, high = spread[0] or 0, spread[1] or 0
    while low != high:
        up = levels[-1].withColumn("group", F.floor(F.col("at") / _GROUP)).groupBy("chrom", "group").applyInPandas(compose, maps)
        levels.append(materialise(up, "bins"))
        low, high = low // _GROUP, high // _GROUP

    def enter(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        *reach, _ = _through(list(zip(rows["entries"], rows["exits"], strict=True)), above["reach"].to_numpy(), width)
        return pd.DataFrame({"chrom": key[0], "at": rows["at"], "reach": [int(x[0]) for x in reach]})

    known = levels[-1].select("chrom", "at", F.lit(-(1 << 62)).alias("reach"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("group", F.floor(F.col("at") / _GROUP)).groupBy("chrom", "group")
        known = materialise(below.cogroup(known.groupBy("chrom", "at")).applyInPandas(enter, shape), "bins")

    def scan(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pos, starts = np.sort(rows["pos"].to_numpy()), []
        at = int(_first_above(pos, above["reach"].to_numpy())[0])
        while at < len(pos):
            starts.append(pos[at])
            at = int(_first_above(pos, pos[at] + width))
        return pd.DataFrame({"chrom": key[0], "start": np.array(starts, np.int64)})

    starts = binned.groupBy("chrom", "bin").cogroup(known.groupBy("chrom", "at")).applyInPandas(scan, "chrom int, start long")
    # no window reaches beyond its width, so that its end needs no position
    spans = reindex(starts, "chrom", "start", name="window").withColumn("window", F.col("window").cast("int"))
    spans = spans.withColumn("end", F.col("start") + width)
    from .joins import interval_join

    # spans of neighbours do not meet, as the next start is beyond the width
    return interval_join(variants, spans).drop("start", "end")


def running_offsets(rows: DataFrame, size: str, order: str) -> DataFrame:
    """adds offset, the sum of size over the rows before."""
    return running_sum(rows, (order,), F.col(size), "offset")


def connected(links: DataFrame) -> DataFrame:
    """(idx, root) of every end of links (i, j): root is the least idx that it is linked to, over any number of links.

    Labels pass to neighbours and then jump to their label's label, so a chain takes few rounds; rounds are written.
    """
    both = materialise(links.select("i", "j").unionAll(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("i").alias("idx")).agg(F.least(F.min("j"), F.first("i")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"idx": "j", "root": "near"}), "j").groupBy(F.col("i").alias("idx")).agg(F.min("near").alias("near"))
        step = labels.join(near, "idx").select("idx", F.least("root", "near").alias("to"), F.col("root").alias("old"))
        jump = step.join(labels.withColumnsRenamed({"idx": "to", "root": "further"}), "to", "left")
        new = materialise(jump.select("idx", F.least("to", F.coalesce("further", "to")).alias("root"), "old"), "labels")
        labels = new.select("idx", "root")
        if new.filter("root <> old").isEmpty():
            return labels


def eigen_shares(values: DataFrame) -> DataFrame:
    """(region, lambda) with the share of the positive sum that this and all larger values have."""
    down = Window.partitionBy("region").orderBy(F.desc("lambda")).rowsBetween(Window.unboundedPreceding, 0)
    positive = values.filter(F.col("lambda") > 1e-10)
    return positive.withColumn("share", F.sum("lambda").over(down) / F.sum("lambda").over(Window.partitionBy("region")))


def _strong(ld: DataFrame, threshold: float) -> DataFrame:
    """Links (i, j), i < j, with r squared above the threshold, each once."""
    ends = ld.filter((F.col("r") * F.col("r") > threshold) & (F.col("i") != F.col("j")))
    return materialise(ends.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct(), "strong-links")


def prune_by_r2(variants: DataFrame, ld: DataFrame, threshold: float) -> DataFrame:
    """variants left by the greedy scan. variants: idx, p; ld: i, j, r, one side of the diagonal or both.

    For each i in order that still stands when its turn comes, and each j that still stands, on either side and with
    r^2 above the threshold: the one with the larger p goes, i on a tie; i ends its row even once it has gone. The
    dense branch of the rule; a component of links is one task, and a variant without a link stays.
    """
    links = _strong(ld, threshold)
    roots = connected(links)
    members = roots.join(variants.select("idx", F.col("p").cast("double").alias("p")), "idx")
    pairs = links.join(roots.select(F.col("idx").alias("i"), F.col("root").alias("of_root")), "i")

    def scan(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        p = dict(zip(rows["idx"], rows["p"], strict=True))
        near: dict[int, list[int]] = {}
        for i, j in zip(pairs["i"], pairs["j"], strict=True):
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
        gone = set()
        for i in sorted(p):
            if i in gone:
                continue
            for j in sorted(near.get(i, ())):
                if j in p and j not in gone:
                    gone.add(j if p[i] < p[j] else i)
        return pd.DataFrame({"idx": sorted(gone)}, dtype="int64")

    gone = members.groupBy("root").cogroup(pairs.groupBy("of_root")).applyInPandas(scan, "idx long")
    return variants.join(gone, "idx", "left_anti")


def bin_by_r2(variants: DataFrame, ld: DataFrame, threshold: float) -> DataFrame:
    """F8: (idx, bin): in index order every j, smaller ones too, with r^2(i, j) above the threshold takes i's label of
    that moment; labels are then numbered densely from 1.

    At its own turn i has the label that its largest smaller neighbour had at its turn, or its own if there is none: a chain
    of pointers, followed in rounds that double their reach. In the end j has the label that its largest neighbour had. So no component of
    links is gathered, and a chain of n links takes log n rounds.
    """
    links = _strong(ld, threshold)
    near = materialise(links.unionAll(links.select(F.col("j").alias("i"), F.col("i").alias("j"))), "links")
    ends = near.groupBy(F.col("i").alias("idx")).agg(F.max("j").alias("last"), F.max(F.when(F.col("j") < F.col("i"), F.col("j"))).alias("before"))
    ends = materialise(ends.select("idx", "last", F.coalesce("before", "idx").alias("to")), "last-links")
    turn = ends.select("idx", "to")
    while True:
        jump = turn.join(turn.select(F.col("idx").alias("to"), F.col("to").alias("further")), "to")
        new = materialise(jump.select("idx", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "turns")
        turn = new.select("idx", "to")
        if new.filter("moved").isEmpty():
            break
    labels = ends.select("idx", "last").join(turn.withColumnsRenamed({"idx": "last", "to": "label"}), "last").select("idx", "label")
    rows = variants.select("idx").join(labels, "idx", "left").withColumn("label", F.coalesce("label", "idx"))
    return dense_codes(rows, "label", "bin").select("idx", (F.col("bin") + 1).alias("bin"))


def window_bins(rows: DataFrame, key: str = "window") -> DataFrame:
    """(code, size, first): window ids coded densely from 0, with their sizes and least member."""
    return dense_codes(rows, key).groupBy("code").agg(F.count("*").alias("size"), F.min("snp").alias("first"))


def dense_codes(rows: DataFrame, key: str, name: str = "code") -> DataFrame:
    """adds the 0-based rank of key among its different values; they are ranked over all partitions and
    joined back, so no task ranks all rows or values."""
    return rows.join(reindex(rows.select(key).distinct(), key, name=name), key)


def first_seen_codes(rows: DataFrame, key: str, order: str, name: str = "code") -> DataFrame:
    """codes from 1 in the order in which keys are first seen."""
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    codes = reindex(first, "__first", key, name=name).drop("__first")
    return rows.join(codes.withColumn(name, F.col(name) + 1), key)


def first_rows(rows: DataFrame, count: int, order: str = "ord") -> DataFrame:
    """The first rows in file order."""
    return rows.orderBy(order).limit(count)


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows in a seeded random order, that of a hash of seed and row: the same however the rows are dealt out."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)
