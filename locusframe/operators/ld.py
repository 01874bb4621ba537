"""Correlation (LD) matrices, their decompositions and what is computed through them.

Genotypes are rows (snp, idx, dosage array); a matrix is (i, j, r) with i <= j unless said otherwise, and mirrored()
gives both sides. Products are computed in tiles of variants, of bounded size. Decompositions and solutions need the
whole matrix of a region in one task: regions are LD blocks or cis windows, some thousands of variants at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..storage import materialise
from .aggregates import exact_medians

TILE = 512
#: Of a full matrix: bytes of standardised genotypes of a run of variants, how many runs there are at least, products that are formed at
#: once, and entries of one Arrow batch.
RUN_BYTES, RUNS, _PRODUCTS, _ENTRIES = 16 << 20, 12, 1 << 20, 200_000


def standardised(dosages: list) -> np.ndarray:
    """Rows (g - mean) / sqrt(var n) with the sample variance; missing values at the mean; constant rows are zero."""
    g = np.array([np.asarray(d, float) for d in dosages])
    g = np.where(np.isnan(g), np.nanmean(g, axis=1, keepdims=True), g) if np.isnan(g).any() else g
    g = g - g.mean(axis=1, keepdims=True)
    var = g.var(axis=1, ddof=1, keepdims=True)
    return np.divide(g, np.sqrt(var * g.shape[1]), out=np.zeros_like(g), where=var > 0)


def correlation(dosages: list) -> np.ndarray:
    """(n-1)/n times the correlation, diagonal included; one variant gives [1]."""
    if len(dosages) == 1:
        return np.ones((1, 1))
    z = standardised(dosages)
    return z @ z.T


def _products(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index arrays and r of every pair of two tiles."""
    za, zb = standardised(list(a["dosage"])), standardised(list(b["dosage"]))
    return a["idx"].to_numpy()[:, None], b["idx"].to_numpy()[None, :], za @ zb.T


def near_tiles(rows: DataFrame, along: str, reach: float) -> DataFrame:
    """(lo, hi), lo <= hi: pairs of tiles t with variants of one chromosome less than reach apart in along.

    One row a tile and chromosome is joined, by bins of positions, so tiles of different ends of a chromosome never meet.
    """
    spans = rows.groupBy("t", "chrom").agg(F.min(along).alias("low"), F.max(along).alias("high"))
    spans = materialise(spans, "ld-tiles")
    extent, tiles = spans.agg(F.max("high") - F.min("low"), F.count("*")).first()
    width = max(reach, float(extent or 0) / (4 * tiles + 1), 1e-9)
    first, last = (F.floor((F.col(c) + sign * reach / 2) / width) for c, sign in (("low", -1), ("high", 1)))
    cut = spans.withColumn("bin", F.explode(F.sequence(first, last)))
    a, b = (cut.select("chrom", "bin", *[F.col(c).alias(c + k) for c in ("t", "low", "high")]) for k in "12")
    close = (F.col("t1") <= F.col("t2")) & (F.col("low1") - F.col("high2") < reach) & (F.col("low2") - F.col("high1") < reach)
    return a.join(b, ["chrom", "bin"]).filter(close).select(F.col("t1").alias("lo"), F.col("t2").alias("hi")).distinct()


def run_length(variants: int, people: int, tile: int = TILE) -> int:
    """Variants of a run of a full matrix: as many as RUN_BYTES hold and as leave RUNS runs, a tile at least."""
    return max(tile, min(RUN_BYTES // (8 * max(1, people)), -(-variants // RUNS)))


def ld_pairs(
    genotypes: DataFrame, tile: int = TILE, least_r2: float = 0.0, band: int | None = None, *, reach: float | None = None, along: str = "pos", jackknife: bool = False
) -> DataFrame:
    """(i, j, r) for i <= j, by tiles of variants: each tile pair is one group of 2 * tile rows.

    least_r2 drops small values inside the task, before they are shuffled, but for the diagonal and for pairs with a
    variant whose skeleton is true, where genotypes have that column. band keeps |i - j| <= band, reach keeps variants of
    one chromosome less than reach apart in the column along; tile pairs out of these are never formed. Without any the
    result has n^2 / 2 rows, as a full matrix has; its groups are pairs of runs of many tiles, of up to RUN_BYTES each, so that a variant is
    shuffled once a run and not once a tile. A group's products are formed and given out some tiles at a time. jackknife adds
    jackknife_var, each r's leave-one-out variance.
    """
    marked = "skeleton" in genotypes.columns
    places = ["chrom", along] if reach is not None else []
    rows, side = genotypes.select("idx", "dosage", *places, *(["skeleton"] if marked else [])), tile
    if band is None and reach is None:
        top, people = rows.agg(F.max("idx"), F.max(F.size("dosage"))).first()
        side = run_length((top or 0) + 1, people or 1, tile)
    rows = rows.withColumn("t", F.floor(F.col("idx") / side).cast("long"))
    if reach is not None:
        tiles = near_tiles(rows, along, reach)
        ends = tiles.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("t"))
        dealt = rows.join(ends, "t")
    else:
        last = rows.agg(F.max("t")).first()[0] or 0
        span = last if band is None else -(-band // side)
        # the pairs of tiles that tile t is in, as the lower or as the upper one
        mates = F.transform(F.sequence(F.greatest(F.lit(0), F.col("t") - span), F.least(F.lit(last), F.col("t") + span)), lambda u: F.struct(F.least(F.col("t"), u).alias("lo"), F.greatest(F.col("t"), u).alias("hi")))
        dealt = rows.withColumn("m", F.explode(mates)).select(*rows.columns, "m.lo", "m.hi")
    names = ["i", "j", "r", *(["jackknife_var"] if jackknife else [])]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        about = held.drop_columns(["dosage"]).to_pandas().sort_values("idx", kind="stable")
        flat = np.concatenate([c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in held.column("dosage").chunks])
        z = standardised(flat.reshape(len(held), -1))[about.index]
        idx, t, n = about["idx"].to_numpy(np.int64), about["t"].to_numpy(), z.shape[1]
        # rows are in order, so those of a tile or run lie together
        a, b = (slice(*np.searchsorted(t, [about[end].iloc[0], about[end].iloc[0] + 1])) for end in ("lo", "hi"))
        out, size, wide = [], 0, max(tile, _PRODUCTS // tile)
        for x in (slice(k, min(k + tile, a.stop)) for k in range(a.start, a.stop, tile)):
            for y in (slice(k, min(k + wide, b.stop)) for k in range(b.start, b.stop, wide)):
                if idx[y.stop - 1] < idx[x.start]:
                    continue
                i, j = idx[x, None], idx[None, y]
                r = z[x] @ z[y].T
                keep = r * r >= least_r2
                if marked:
                    keep |= about["skeleton"].to_numpy(bool)[x, None] | about["skeleton"].to_numpy(bool)[None, y]
                if idx[x.stop - 1] >= idx[y.start]:
                    keep = (i <= j) & (keep | (i == j))
                if band is not None:
                    keep &= j - i <= band
                if reach is not None:
                    chrom, at = about["chrom"].to_numpy(), about[along].to_numpy(float)
                    keep &= (chrom[x, None] == chrom[None, y]) & (np.abs(at[x, None] - at[None, y]) < reach)
                found = np.nonzero(keep)
                block = [i[found[0], 0], j[0, found[1]], r[found]]
                if jackknife:
                    # leaving out person k turns r into n/(n-1) (r - z_ik z_jk), so the variance over k needs but the product of squares
                    block.append((n / (n - 1) * ((z[x] * z[x]) @ (z[y] * z[y]).T - r * r / n))[found])
                out.append(block)
                size += len(found[0])
                if size >= _ENTRIES:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return dealt.groupBy("lo", "hi").applyInArrow(product, "i long, j long, r double" + (", jackknife_var double" if jackknife else ""))


def region_ld(genotypes: DataFrame, region: str = "region", tile: int = TILE) -> DataFrame:
    """(region, i, j, r) of the pairs of each region, i <= j, by tiles of its variants; a variant alone has r = 1.

    Variants are dealt to a region's tiles by hash, so no task holds more than two tiles, whatever the region's size.
    """
    kind = genotypes.schema[region].dataType.simpleString()
    rows = genotypes.select(region, "idx", "dosage")
    sizes = rows.groupBy(region).agg(F.count("*").alias("size"), F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = rows.join(sizes, region).withColumn("t", F.pmod(F.xxhash64("idx"), F.col("tiles")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least("t", u).alias("lo"), F.greatest("t", u).alias("hi")))
    dealt = dealt.withColumn("m", F.explode(mates)).select(region, "idx", "dosage", "size", "t", "m.lo", "m.hi")

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["t"] == key[1]], rows[rows["t"] == key[2]]
        if not len(a) or not len(b):
            return pd.DataFrame({region: [], "i": [], "j": [], "r": []})
        i, j, r = _products(a, b)
        if rows["size"].iloc[0] == 1:
            r = np.ones((1, 1))
        keep = np.nonzero((i <= j) if key[1] == key[2] else np.ones(r.shape, bool))
        x, y = i[keep[0], 0], j[0, keep[1]]
        return pd.DataFrame({region: key[0], "i": np.minimum(x, y), "j": np.maximum(x, y), "r": r[keep]})

    return dealt.groupBy(region, "lo", "hi").applyInPandas(product, f"{region} {kind}, i long, j long, r double")


def mirrored(ld: DataFrame) -> DataFrame:
    """Both sides of the diagonal from i <= j, each entry once."""
    other = [F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in ld.columns if c not in ("i", "j")]]
    return ld.select("i", "j", *[c for c in ld.columns if c not in ("i", "j")]).unionAll(ld.filter("i <> j").select(*other))


def matrix_rows(ld: DataFrame) -> DataFrame:
    """(i, js, rs): each row of a mirrored matrix as arrays in column order, one row of the matrix a row."""
    cells = F.sort_array(F.collect_list(F.struct("j", "r")))
    return ld.groupBy("i").agg(cells.alias("c")).select("i", F.col("c.j").alias("js"), F.col("c.r").alias("rs"))


def dense_rows(ld: DataFrame) -> DataFrame:
    """(i, first, values): each row of a mirrored matrix from its first to its last column, zero where it has none."""
    rows = matrix_rows(ld).select("i", F.element_at("js", 1).alias("first"), F.element_at("js", -1).alias("last"), F.map_from_arrays("js", "rs").alias("m"))
    filled = F.transform(F.sequence("first", "last"), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return rows.select("i", "first", filled.alias("values"))


def sparse(ld: DataFrame, n: int, least_r: float | None = None, chi2: float = 10.0, strict: bool = False, skeleton: DataFrame | None = None) -> DataFrame:
    """The diagonal and entries with |r| >= least_r, or r^2 n >= chi2 (> with strict). With skeleton (idx),
    the columns of its variants stay too, so that a mirrored matrix need not be symmetric."""
    score = F.abs(F.col("r")) if least_r is not None else F.col("r") * F.col("r") * n
    bound = least_r if least_r is not None else chi2
    keep = (F.col("i") == F.col("j")) | ((score > bound) if strict else (score >= bound))
    if skeleton is None:
        return ld.filter(keep)
    marks = skeleton.select(F.col("idx").alias("j")).distinct().withColumn("__kept", F.lit(True))
    return ld.join(marks, "j", "left").filter(keep | F.coalesce("__kept", F.lit(False))).select(ld.columns)


def band_by_r(ld: DataFrame, least_r: float | None = None, *, n: int | None = None, chi2: float = 10.0) -> DataFrame:
    """In each row i of a mirrored matrix all entries between its outermost |r| > least_r, or r^2 n > chi2, on
    either side, the diagonal at least."""
    far = F.abs("r") > least_r if least_r is not None else F.col("r") * F.col("r") * n > chi2
    ends = ld.filter(far).groupBy("i").agg(F.min("j").alias("__low"), F.max("j").alias("__high"))
    inside = F.col("j").between(F.least(F.coalesce("__low", "i"), "i"), F.greatest(F.coalesce("__high", "i"), "i"))
    return ld.join(ends, "i", "left").filter(inside).drop("__low", "__high")


def band_by_distance(ld: DataFrame, variants: DataFrame, width: int) -> DataFrame:
    """Entries of one chromosome less than width // 2 apart."""
    a = variants.select(F.col("idx").alias("i"), F.col("chrom").alias("c1"), F.col("pos").alias("p1"))
    b = variants.select(F.col("idx").alias("j"), F.col("chrom").alias("c2"), F.col("pos").alias("p2"))
    near = (F.col("c1") == F.col("c2")) & (F.abs(F.col("p1") - F.col("p2")) < width // 2)
    return ld.join(a, "i").join(b, "j").filter(near).drop("c1", "p1", "c2", "p2")


def shrink_constants(map_n: float = 183.0) -> tuple[float, float]:
    """(theta, 2m) from the map's sample size m; the harmonic sum is its asymptotic series."""
    n = 2 * map_n - 1
    h = math.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)
    return (1 / h) / (2 * map_n + 1 / h), 2 * map_n


def shrink_reach(ne: float = 11_490.672741, cut: float = 1e-5, map_n: float = 183.0) -> float:
    """From how many cM on every entry is cut to zero."""
    return -math.log(cut) * shrink_constants(map_n)[1] * 100 / (4 * ne)


def shrink(ld: DataFrame, variants: DataFrame, ne: float = 11_490.672741, cut: float = 1e-5, map_n: float = 183.0) -> DataFrame:
    """Shrunk (i, j, r). variants: idx, gen_pos in cM, twopq as each variant's variance.

    The covariance is scaled by exp(-4 ne |dcM| / 100 / 2m), 0 at or below cut, and by (1 - theta)^2, the diagonal
    gets theta/2 (1 - theta/2), and the result becomes a correlation again.
    """
    theta, two_m = shrink_constants(map_n)
    a = variants.select(F.col("idx").alias("i"), F.col("gen_pos").alias("g1"), F.col("twopq").alias("v1"))
    b = variants.select(F.col("idx").alias("j"), F.col("gen_pos").alias("g2"), F.col("twopq").alias("v2"))
    rows = ld.join(a, "i").join(b, "j")
    s = F.exp(-4 * ne * F.abs(F.col("g1") - F.col("g2")) / 100 / two_m)
    s = F.when(s <= cut, 0.0).otherwise(s)
    extra = 0.5 * theta * (1 - 0.5 * theta)

    def spread(v: Column) -> Column:
        return v * (1 - theta) ** 2 + extra

    cov = F.col("r") * F.sqrt(F.col("v1") * F.col("v2")) * s * (1 - theta) ** 2 + F.when(F.col("i") == F.col("j"), extra).otherwise(0.0)
    return rows.select("i", "j", (cov / F.sqrt(spread(F.col("v1")) * spread(F.col("v2")))).alias("r")).filter((F.col("r") != 0) | (F.col("i") == F.col("j")))


def truncate(values: np.ndarray, total: float, cutoff: float) -> int:
    """How many of the ascending values to keep, from the largest: the fewest whose share exceeds cutoff."""
    top = np.cumsum(values[::-1]) / total
    over = np.flatnonzero(top > cutoff)
    positive = int((values > 1e-10).sum())
    return max(1, min(positive or 1, int(over[0]) + 1 if len(over) else positive))


def decompose(r: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(values ascending, vectors, sum of positive values) of a symmetric matrix, cut at a share of that sum."""
    values, vectors = np.linalg.eigh(np.asarray(r, np.float64))
    total = float(values[values > 1e-10].sum())
    k = truncate(values, total, cutoff)
    return values[-k:], vectors[:, -k:], total


_EIGEN = "m int, k int, sum_pos double, cutoff double, snps array<string>, values array<double>, vectors array<double>"


def decompose_genotypes(dosages: list, cutoff: float) -> tuple[np.ndarray, np.ndarray, float]:
    """As decompose of the variants' correlation. Of more variants than people n, the n x n matrix Z' Z of the
    standardised genotypes Z is decomposed instead, which has the same values above 0: it is summed over tiles of variants, and a
    vector v of it gives Z v / value^1/2, tile by tile. No matrix of variants by variants is formed."""
    m, n = len(dosages), len(dosages[0])
    if m <= n or m == 1:
        return decompose(correlation(dosages), cutoff)
    tiles = range(0, m, TILE)
    gram = np.zeros((n, n))
    for at in tiles:
        z = standardised(dosages[at : at + TILE])
        gram += z.T @ z
    values, v = np.linalg.eigh(gram)
    total = float(values[values > 1e-10].sum())
    k = truncate(values, total, cutoff)
    back = v[:, -k:] / np.sqrt(values[-k:])
    return values[-k:], np.concatenate([standardised(dosages[at : at + TILE]) @ back for at in tiles]), total


def region_eigen(genotypes: DataFrame, cutoff: float = 0.9999, region: str = "region") -> DataFrame:
    """One row a region: its variants in order, kept eigenvalues (ascending) and vectors (column by column). A task holds a
    region's genotypes and vectors, and a matrix of the fewer of its variants and people."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        values, vectors, total = decompose_genotypes(list(rows["dosage"]), cutoff)
        out = {region: key[0], "m": len(rows), "k": len(values), "sum_pos": total, "cutoff": cutoff}
        return pd.DataFrame([out | {"snps": list(rows["snp"]), "values": values.tolist(), "vectors": vectors.T.ravel().tolist()}])

    kind = genotypes.schema[region].dataType.simpleString()
    return genotypes.select(region, "idx", "snp", "dosage").groupBy(region).applyInPandas(one, f"{region} {kind}, {_EIGEN}")


def retruncate(eigen: DataFrame, cutoff: float) -> DataFrame:
    """Regions cut again at a lower share; those stored at a lower one stay. One row a region, in place."""
    schema = eigen.schema

    def cut(batches):
        for rows in batches:
            out = rows.to_dict("records")
            for row in out:
                if cutoff < row["cutoff"]:
                    values = np.asarray(row["values"])
                    k = truncate(values, row["sum_pos"], cutoff)
                    row |= {"values": values[-k:], "vectors": np.asarray(row["vectors"])[-k * row["m"] :], "k": k, "cutoff": cutoff}
            yield pd.DataFrame(out, columns=schema.names)

    return eigen.mapInPandas(cut, schema)


def impute_region(rows: pd.DataFrame, a: np.ndarray, delta: float = 0.1) -> pd.DataFrame:
    """Fills beta, se, n and p of rows that are not typed, from a (components by rows), where R = a' a is their correlation.

    z_i = R_it (R_tt + delta I)^-1 z_t = a_i' (a_t a_t' + delta I)^-1 a_t z_t, so that a system of as many unknowns as
    there are components, or typed rows if they are fewer, is solved and no R is formed. Variance and n are the upper medians of
    the typed rows.
    """
    typed = rows["typed"].to_numpy(bool)
    if typed.all() or not typed.any():
        return rows.assign(imputed=False)
    b, se, n, af = (rows[c].to_numpy(float) for c in ("beta", "se", "n", "af"))
    twopq = 2 * af * (1 - af)
    z = b[typed] / se[typed]
    at = a[:, typed]
    if len(a) <= at.shape[1]:
        w = np.linalg.solve(at @ at.T + delta * np.eye(len(a)), at @ z)
    else:
        w = at @ np.linalg.solve(at.T @ at + delta * np.eye(at.shape[1]), z)
    zi = a[:, ~typed].T @ w
    spread = twopq[typed] * (n[typed] * se[typed] ** 2 + b[typed] ** 2)
    v, m = np.sort(spread)[len(spread) // 2], np.sort(n[typed])[typed.sum() // 2]
    base = np.sqrt(twopq[~typed] * (m + zi**2))
    out = rows.copy()
    out.loc[~typed, "beta"], out.loc[~typed, "se"], out.loc[~typed, "n"] = zi * np.sqrt(v) / base, np.sqrt(v) / base, m
    out["p"] = [math.erfc(abs(x) / math.sqrt(2)) for x in out["beta"] / out["se"]]
    return out.assign(imputed=~typed)


def _in_region(rows: pd.DataFrame, e: pd.Series) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows whose variants an eigen row has, by name, and their factor: values^1/2 U', components by rows."""
    at = {s: k for k, s in enumerate(e["snps"])}
    rows = rows[rows["snp"].isin(at)].sort_values("snp").reset_index(drop=True)
    u = np.asarray(e["vectors"]).reshape(e["k"], e["m"])[:, [at[s] for s in rows["snp"]]]
    return rows, np.sqrt(np.maximum(np.asarray(e["values"]), 0))[:, None] * u


def impute_summary(stats: DataFrame, eigen: DataFrame, delta: float = 0.1, region: str = "region") -> DataFrame:
    """Stats (region, snp, af, beta, se, n; beta null where not typed) filled through each region's eigen row."""
    kind = stats.schema[region].dataType.simpleString()
    out = f"{region} {kind}, snp string, af double, beta double, se double, n double, p double, imputed boolean"

    def one(key: tuple, rows: pd.DataFrame, low: pd.DataFrame) -> pd.DataFrame:
        cols = [region, "snp", "af", "beta", "se", "n", "p", "imputed"]
        if not len(rows) or not len(low):
            return pd.DataFrame(columns=cols)
        rows, a = _in_region(rows, low.iloc[0])
        rows = rows.assign(typed=rows["beta"].notna(), p=np.nan)
        filled = impute_region(rows, a, delta)
        own = filled["p"].isna() & filled["beta"].notna()
        filled.loc[own, "p"] = [math.erfc(abs(x) / math.sqrt(2)) for x in filled.loc[own, "beta"] / filled.loc[own, "se"]]
        return filled[cols]

    wanted = stats.select(region, "snp", "af", "beta", "se", F.col("n").cast("double").alias("n"))
    return wanted.groupBy(region).cogroup(eigen.groupBy(region)).applyInPandas(one, out)


def align_and_impute(reference: DataFrame, pairs: DataFrame, eigen: DataFrame, max_missing: float = 0.3, delta: float = 0.1) -> DataFrame:
    """A43, A45, D9 with J9: the reference's pairs (gene_id, snp, af), the effects of those that are typed and imputed ones
    for the rest, through each gene's eigen row (region is the gene). Genes without an eigen row go."""
    from .joins import align_to_reference_genes

    rows = align_to_reference_genes(reference, pairs, max_missing)
    return impute_summary(rows.withColumnRenamed("gene_id", "region"), eigen, delta).withColumnRenamed("region", "gene_id")


def project_effects(effects: DataFrame, eigen: DataFrame, region: str = "region") -> DataFrame:
    """w = values^-1/2 U' b of each region: (region, component, w)."""
    kind = effects.schema[region].dataType.simpleString()

    def one(key: tuple, rows: pd.DataFrame, low: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(low):
            return pd.DataFrame({region: [], "component": [], "w": []})
        e = low.iloc[0]
        b = rows.set_index("snp")["b"].reindex(e["snps"]).fillna(0.0).to_numpy()
        w = np.asarray(e["vectors"]).reshape(e["k"], e["m"]) @ b / np.sqrt(np.asarray(e["values"]))
        return pd.DataFrame({region: key[0], "component": range(len(w)), "w": w})

    return effects.select(region, "snp", "b").groupBy(region).cogroup(eigen.groupBy(region)).applyInPandas(one, f"{region} {kind}, component int, w double")


def projection_matrix(eigen: DataFrame, variances: DataFrame | None = None, region: str = "region") -> DataFrame:
    """Q = values^1/2 U' of each region as (region, component, snp, q), zero entries included; with variances
    (snp, twopq), of unscaled genotypes, its columns are multiplied by sqrt(2pq)."""
    kind = eigen.schema[region].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            for e in batch.to_dict("records"):
                q = np.sqrt(np.asarray(e["values"]))[:, None] * np.asarray(e["vectors"]).reshape(e["k"], e["m"])
                yield pd.DataFrame({region: e[region], "component": np.repeat(np.arange(e["k"]), e["m"]), "snp": list(e["snps"]) * e["k"], "q": q.ravel()})

    out = eigen.mapInPandas(rows, f"{region} {kind}, component int, snp string, q double")
    if variances is None:
        return out
    return out.join(variances.select("snp", "twopq"), "snp").select(region, "component", "snp", (F.col("q") * F.sqrt("twopq")).alias("q"))


def pseudo_summary(effects: DataFrame, eigen: DataFrame, n: int, train_share: float = 0.9, seed: int = 2023, region: str = "region") -> DataFrame:
    """Training and validation effects of each variant: train = b + sqrt(1/n_t - 1/n) U values^1/2 e."""
    kind = effects.schema[region].dataType.simpleString()
    nt = train_share * n

    def one(key: tuple, rows: pd.DataFrame, low: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(low):
            return pd.DataFrame({region: [], "snp": [], "train": [], "valid": []})
        e = low.iloc[0]
        rng = np.random.default_rng([seed, *str(key[0]).encode()])
        b = rows.set_index("snp")["b"].reindex(e["snps"]).fillna(0.0).to_numpy()
        u = np.asarray(e["vectors"]).reshape(e["k"], e["m"])
        train = b + math.sqrt(1 / nt - 1 / n) * (np.sqrt(np.asarray(e["values"])) * rng.standard_normal(e["k"])) @ u
        return pd.DataFrame({region: key[0], "snp": e["snps"], "train": train, "valid": (n * b - nt * train) / (n - nt)})

    out = f"{region} {kind}, snp string, train double, valid double"
    return effects.select(region, "snp", "b").groupBy(region).cogroup(eigen.groupBy(region)).applyInPandas(one, out)


def impute_sample_size(stats: DataFrame, tolerance: float = 0.01, outlier_sd: float = 3.0, most: int = 50, settle: bool = True) -> DataFrame:
    """Per-variant n = (v - 2pq b^2) / (2pq se^2) with v = median(2pq n (n se^2 + b^2)) / median(n). Rows farther than
    outlier_sd deviations of the new n from the median of the old n go, and the round repeats with the new n until the
    deviation changes by tolerance at most.

    Rounds that end unsettled are an error, unless settle is false. Medians are exact, by selection; some numbers a round reach
    the driver, and each round's rows are written.
    """
    names = stats.columns
    stats = materialise(stats, "sample-size-given")
    rows = stats.withColumn("__tpq", 2 * F.col("af") * (1 - F.col("af"))).withColumn("n", F.col("n").cast("double"))
    before = 0.0
    for _ in range(most):
        b2, var = F.col("b") * F.col("b"), F.col("se") * F.col("se")
        ypy, size = exact_medians(rows.select((F.col("__tpq") * F.col("n") * (F.col("n") * var + b2)).alias("y"), "n"), "y", "n")
        if ypy is None or not size:
            return rows.select(names)
        new = (F.lit(ypy / size) - F.col("__tpq") * b2) / (F.col("__tpq") * var)
        rows = materialise(rows.withColumn("n", new), "sample-size")
        sd = rows.agg(F.stddev_samp("n")).first()[0] or 0.0
        rows = rows.filter(F.col("n").between(size - outlier_sd * sd, size + outlier_sd * sd))
        if abs(sd - before) <= tolerance:
            return rows.select(names)
        before = sd
    if settle:
        raise EngineError(f"the sample sizes have not settled after {most} rounds")
    return rows.select(names)


def mixed_model_equations(stats: DataFrame, ld: DataFrame, n_ref: int, overlap: bool = False, noscale: bool = True) -> dict[str, DataFrame]:
    """The parts of the mixed-model equations. stats: idx, n, af, b, se; ld: a mirrored matrix (i, j, r).

    var_p is the upper median of 2pq (n se^2 + b^2) from the given frequencies. Then d = var_p / (se^2 + b^2 / n),
    twopq = d / n, tss = d (n se^2 + b^2), and d becomes n where genotypes are scaled (noscale false).
    `variants`: idx, d, twopq, tss, zz_diag, zy, chisq, ld_score, sampling_var and zx, the row sum of zz; `zz`: (i, j, zz) with
    zz = r sqrt(d_i d_j); `totals`: one row (var_p, ypy, n_median, xx, xy). sampling_var is (n + n_ref) / m of the row's
    sampling variance, none with overlap, and the share of the m variants that the row has no entry for.
    """
    n, b2, var = F.col("n").cast("double"), F.col("b") * F.col("b"), F.col("se") * F.col("se")
    given = stats.select("idx", n.alias("n"), "b", "se", (2 * F.col("af") * (1 - F.col("af")) * (n * var + b2)).alias("__v"))
    given = materialise(given, "mme-stats")
    var_p, n_median, ypy = exact_medians(given.withColumn("__y", F.col("__v") * F.col("n")), "__v", "n", "__y", upper=True)
    m = given.count()
    d = F.lit(var_p) / (var + b2 / F.col("n"))
    rows = given.withColumn("d", d).withColumn("twopq", F.col("d") / F.col("n")).withColumn("tss", F.col("d") * (F.col("n") * var + b2))
    rows = rows if noscale else rows.withColumn("d", F.col("n"))
    rows = rows.drop("__v", "se")
    of_i, of_j = (rows.select(F.col("idx").alias(x), F.col("d").alias(f"__d{x}")) for x in ("i", "j"))
    zz = materialise(ld.join(of_i, "i").join(of_j, "j").select("i", "j", "r", (F.col("r") * F.sqrt(F.col("__di") * F.col("__dj"))).alias("zz")), "mme-zz")
    r2 = F.col("r") * F.col("r")
    about = zz.groupBy(F.col("i").alias("idx")).agg(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("zz"))).alias("zz_diag"), F.sum("zz").alias("zx"), F.sum(r2).alias("ld_score"),
        F.sum((1 - r2) * (1 - r2) / n_ref).alias("__sampling"), F.count("*").alias("__entries"),
    )
    rows = rows.join(about, "idx", "left").withColumn("zy", F.col("zz_diag") * F.col("b") * (F.lit(1.0) if noscale else F.sqrt("twopq")))
    own = F.lit(0.0) if overlap else (F.col("n") + n_ref) / F.lit(m) * F.col("__sampling")
    rows = rows.withColumn("chisq", F.col("zy") * F.col("b")).withColumn("sampling_var", own + (F.lit(m) - F.col("__entries")) / F.lit(m))
    rows = materialise(rows.drop("__sampling", "__entries", "n", "b"), "mme-variants")
    totals = rows.agg(F.lit(var_p).alias("var_p"), F.lit(ypy).alias("ypy"), F.lit(n_median).alias("n_median"), F.sum("zx").alias("xx"), F.sum("zy").alias("xy"))
    return {"variants": rows, "zz": zz.select("i", "j", "zz"), "totals": totals}


def jackknife_variance(genotypes: DataFrame, **kept: object) -> DataFrame:
    """(i, jackknife_var): the leave-one-out variance of each kept pair's r, the diagonal's too, summed over row i of the
    whole matrix. kept: least_r2, band, reach and the like of ld_pairs, in whose tiles the variances are computed.

    The standardisation is held fixed while a person is left out, as the method has it; nothing is standardised anew.
    """
    return mirrored(ld_pairs(genotypes, jackknife=True, **kept)).groupBy("i").agg(F.sum("jackknife_var").alias("jackknife_var"))


def resample_region(rows: pd.DataFrame, a: np.ndarray, aim_n: float, delta: float = 0.1) -> pd.DataFrame:
    """Each variant's z from all others (leave one out), and beta and se at sample size aim_n; the variance is the
    upper median of the others'. Where there is no other variant both are null. a: as in impute_region.

    Only (R + delta I)^-1 z and that inverse's diagonal are needed; both follow from the k x k matrix a a' + delta I.
    """
    m = len(rows)
    if m < 2:
        return rows.assign(beta_new=np.nan, se_new=np.nan)
    z = (rows["beta"] / rows["se"]).to_numpy(float)
    n, twopq = rows["n"].to_numpy(float), (2 * rows["af"] * (1 - rows["af"])).to_numpy(float)
    x = np.linalg.solve(a @ a.T + delta * np.eye(len(a)), a)
    # (R + delta I)^-1 = (I - a' x) / delta; the left-out prediction follows from it
    fitted = z - (z - a.T @ (x @ z)) / (1 - (a * x).sum(axis=0))
    spread = twopq * (n * rows["se"].to_numpy(float) ** 2 + rows["beta"].to_numpy(float) ** 2)
    order = np.argsort(spread, kind="stable")
    rank, ranked, at = np.argsort(order), spread[order], (m - 1) // 2
    v = np.where(at < rank, ranked[at], ranked[min(at + 1, m - 1)])
    base = np.sqrt(twopq * (aim_n + fitted**2))
    return rows.assign(beta_new=fitted * np.sqrt(v) / base, se_new=np.sqrt(v) / base)


def rescale_region(rows: pd.DataFrame, a: np.ndarray, aim_n: float, delta: float = 0.1) -> pd.DataFrame:
    """Beta and se at sample size aim_n by the expected product of both studies' z, from the LD score and the overlap
    of the two samples, over the known z; null where that is 0."""
    z = (rows["beta"] / rows["se"]).to_numpy(float)
    n, twopq = rows["n"].to_numpy(float), (2 * rows["af"] * (1 - rows["af"])).to_numpy(float)
    both = np.sqrt(n * aim_n)
    product = both * (a.T @ a.sum(axis=1) + delta) / len(rows) + np.minimum(n, aim_n) / both
    z2 = np.divide(product, z, out=np.full(len(z), np.nan), where=z != 0)
    base = np.sqrt(twopq * (aim_n + z2**2))
    return rows.assign(beta_new=z2 / base, se_new=1 / base)


def resample_effects(stats: DataFrame, eigen: DataFrame, aim_n: float, *, by_score: bool = False, delta: float = 0.1, region: str = "region") -> DataFrame:
    """Stats (region, snp, af, beta, se, n) with beta_new and se_new at sample size aim_n, through each region's eigen
    row: by leave-one-out imputation, or by_score. Variants that the eigen row lacks go."""
    kind = stats.schema[region].dataType.simpleString()
    cols = [region, "snp", "af", "beta", "se", "n"]
    method = rescale_region if by_score else resample_region

    def one(key: tuple, rows: pd.DataFrame, low: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(low):
            return pd.DataFrame(columns=[*cols, "beta_new", "se_new"])
        rows, a = _in_region(rows, low.iloc[0])
        return method(rows, a, aim_n, delta)[[*cols, "beta_new", "se_new"]]

    out = f"{region} {kind}, snp string, af double, beta double, se double, n double, beta_new double, se_new double"
    wanted = stats.select(region, "snp", "af", "beta", "se", F.col("n").cast("double").alias("n"))
    return wanted.groupBy(region).cogroup(eigen.groupBy(region)).applyInPandas(one, out)
