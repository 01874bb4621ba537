"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def biased_correlation(x: Column, y: Column) -> Column:
    """Covariance over n, variances over n-1, so (n-1)/n of the usual correlation."""
    return F.covar_pop(x, y) / F.sqrt(F.var_samp(x) * F.var_samp(y))


def biased_slope(x: Column, y: Column) -> Column:
    """Covariance over n, variance of x over n-1."""
    return F.covar_pop(x, y) / F.var_samp(x)


def upper_median(column: str) -> Column:
    """Element floor(n/2) of a group's sorted values, nulls left out: the discrete median counted from above.
    Aggregation keeps one counter for each different value of a group, not its rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


#: Values that selection takes to the driver at most, and how far around a rank, as a share, it looks first.
SELECT_ROWS, _AROUND = 20_000, 1 / 500


def select_ranks(rows: DataFrame, column: str, ranks: list[int], n: int) -> list[float]:
    """The values of these 0-based ranks among the n known values of a column, ascending.

    Selection, not a sort: a pass finds two approximate quantiles around the ranks, another counts what lies below and between
    them, and what lies between is all that further passes look at, until it is few enough to be taken. All passes
    aggregate map-side. Where many values are equal, so that a pass gains little, one value parts the rest into lower, equal and higher.
    """
    values = rows.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    x, below, inside, part = F.col("x"), 0, n, F.lit(True)
    low, high = min(ranks), max(ranks)
    around = _AROUND
    while inside > SELECT_ROWS:
        shares = [min(1.0, max(0.0, s)) for s in ((low - below) / inside - around, (high - below + 1) / inside + around)]
        a, z = values.filter(part).agg(F.percentile_approx("x", shares, 10_000)).first()[0]
        less, between = values.agg(F.count_if(part & (x < a)), F.count_if(part & (x >= a) & (x <= z))).first()
        if below + less > low or below + less + between <= high:
            around *= 8
        elif a == z:
            return [float(a)] * len(ranks)
        elif between <= inside / 2:
            below, inside, part = below + less, between, part & (x >= a) & (x <= z)
        else:
            found = {r: _parted(values.filter(part), r - below, inside) for r in set(ranks)}
            return [found[r] for r in ranks]
    few = sorted((r.x for r in values.filter(part).collect()), key=lambda v: (v != v, v))
    return [float(few[r - below]) for r in ranks]


def _parted(values: DataFrame, rank: int, n: int) -> float:
    """The value of a rank by quickselect around approximate quantiles; the one that a pass looks at never comes back."""
    x, part = F.col("x"), F.lit(True)
    while True:
        pivot = values.filter(part).agg(F.percentile_approx("x", min(1.0, (rank + 0.5) / n), 10_000)).first()[0]
        less, equal = values.agg(F.count_if(part & (x < pivot)), F.count_if(part & (x == pivot))).first()
        if less <= rank < less + equal:
            return float(pivot)
        part, rank, n = (part & (x < pivot), rank, less) if rank < less else (part & (x > pivot), rank - less - equal, n - less - equal)


def exact_median(rows: DataFrame, column: str, upper: bool = False) -> float | None:
    """The median of a whole column, or the element floor(n/2) of its sorted values; null if there is none."""
    return exact_medians(rows, column, upper=upper)[0]


def exact_medians(rows: DataFrame, *columns: str, upper: bool = False) -> list[float | None]:
    """exact_median of several columns; rows are read a few times, so they should be a written table if they are dear."""
    counts = rows.agg(*[F.count(c).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    out: list[float | None] = []
    for column, n in zip(columns, counts, strict=True):
        ranks = [n // 2] if upper else sorted({(n - 1) // 2, n // 2})
        found = select_ranks(rows, column, ranks, n) if n else []
        out.append(sum(found) / len(found) if found else None)
    return out


def weighted_frequency(af: Column, n: Column) -> Column:
    """E5: sum(af n) / sum(n)."""
    return F.sum(af * n) / F.sum(n)


def sample_size_stats(pairs: DataFrame, group: str = "gene_id", n: str = "n") -> DataFrame:
    """Mean of n cut to a whole number, and the population deviation around that.

    From sums alone, so that one pass with partial aggregation is enough.
    """
    x = F.col(n).cast("double")
    sums = pairs.groupBy(group).agg(F.count(n).alias("k"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    mean = F.floor(F.col("s") / F.col("k"))
    square = F.col("q") / F.col("k") - 2 * mean * F.col("s") / F.col("k") + mean * mean
    return sums.select(group, mean.cast("long").alias("n_mean"), F.sqrt(F.greatest(F.lit(0.0), square)).alias("n_sd"))


def chromosome_ranges(variants: DataFrame) -> DataFrame:
    """Count and first and last index, position and id of each chromosome, in the order of ord."""
    return variants.groupBy("chrom").agg(
        F.count("*").alias("size"), F.min("ord").alias("first_idx"), F.max("ord").alias("last_idx"),
        F.min_by("pos", "ord").alias("first_pos"), F.max_by("pos", "ord").alias("last_pos"),
        F.min_by("snp", "ord").alias("first_snp"), F.max_by("snp", "ord").alias("last_snp"),
    )


def ld_row_stats(ld: DataFrame, n: int) -> DataFrame:
    """For each row i of the whole matrix (i, j, r): sum of r, of r squared, and the sampling variance.

    ld holds both sides of the diagonal; mirrored() of operators/ld.py makes them from i <= j.
    """
    r2 = F.col("r") * F.col("r")
    return ld.groupBy("i").agg(F.sum("r").alias("ld_sum"), F.sum(r2).alias("ldsc"), F.sum((1 - r2) * (1 - r2) / n).alias("sampling_var"))


def window_size_summary(windows: DataFrame, size: str = "size") -> DataFrame:
    """Mean and deviation of window sizes."""
    return windows.agg(F.avg(size).alias("mean_size"), F.stddev_samp(size).alias("sd_size"))


def variance_parts(var_y: Column, h2: Column | float, random_share: Column | float) -> dict[str, Column]:
    """Genetic, residual and random variance."""
    genetic = var_y * h2
    return {"v_genetic": genetic, "v_residual": var_y - genetic, "v_random": var_y * random_share}


def regressed_sample_size(beta: Column, se: Column) -> Column:
    """-1 / slope of se^2 on beta^2 - se^2, cut to a whole number."""
    return (-1 / F.regr_slope(se * se, beta * beta - se * se)).cast("long")


def input_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, sd) of each column, in one pass."""
    stats = [F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")) for c in columns]
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def cross_products(rows: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(left, right, value): the sum of products of every pair of columns."""
    sums = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.sum(F.col(a) * F.col(b)).alias("value")) for a in left for b in right]
    return rows.agg(F.array(*sums).alias("s")).select(F.inline("s"))
