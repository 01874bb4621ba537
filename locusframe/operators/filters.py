"""Filters, predicates and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EngineError, require_rows
from ..functions.scalar import chi2_cut, minor_frequency
from ..storage import materialise


def include_ids(rows: DataFrame, listed: DataFrame, key: str = "snp") -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(listed.select(key).distinct(), key, "left_semi")


def exclude_ids(rows: DataFrame, listed: DataFrame, key: str = "snp") -> DataFrame:
    """Rows whose key is not listed; null keys stay."""
    return rows.join(listed.select(key).distinct(), key, "left_anti")


def include_chromosome(rows: DataFrame, chrom: int) -> DataFrame:
    """C4: one chromosome; 0 keeps all."""
    return rows if chrom == 0 else rows.filter(F.col("chrom") == chrom)


def include_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of one id; an error if there is none."""
    return require_rows(rows.filter(F.col(key) == value), f"{key} {value}")


def include_block(variants: DataFrame, blocks: DataFrame, number: int) -> DataFrame:
    """Variants of the block of a 1-based number: those that name it, where variants have block_id and some do,
    else those within it by position, both ends included."""
    block = blocks.filter(F.col("ord") == number - 1).limit(1)
    if "block_id" in variants.columns:
        named = variants.join(F.broadcast(block.select("block_id")), "block_id", "left_semi")
        if not named.isEmpty():
            return named
    spans = block.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    inside = (F.col("chrom") == F.col("b_chrom")) & F.col("pos").between(F.col("b_start"), F.col("b_end"))
    return variants.join(F.broadcast(spans), inside, "left_semi")


def include_matched_blocks(variants: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants with a known block_id, and the blocks that have one, with start_idx, end_idx and n_snps by idx."""
    mine = variants.join(blocks.select("block_id"), "block_id", "left_semi")
    about = mine.groupBy("block_id").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("n_snps"))
    return mine, blocks.join(about, "block_id")


def tag_skeleton(variants: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds skeleton, true for listed variants."""
    flags = listed.select("snp").distinct().withColumn("skeleton", F.lit(True))
    return variants.join(flags, "snp", "left").withColumn("skeleton", F.coalesce("skeleton", F.lit(False)))


def exclude_mhc(variants: DataFrame, chrom: int = 6, start: int = 28_000_000, end: int = 34_000_000) -> DataFrame:
    """Variants strictly inside the region go."""
    return variants.filter(~((F.col("chrom") == chrom) & (F.col("pos") > start) & (F.col("pos") < end)))


def is_ambiguous(a1: Column, a2: Column) -> Column:
    """A/T and C/G pairs, in either order."""
    return F.concat(a1, a2).isin("AT", "TA", "CG", "GC")


def exclude_ambiguous(variants: DataFrame) -> DataFrame:
    """C9."""
    return variants.filter(~F.coalesce(is_ambiguous(F.col("a1"), F.col("a2")), F.lit(False)))


def within_maf(variants: DataFrame, least: float = 0.0, most: float = 0.0, af: str = "af") -> DataFrame:
    """Minor allele frequency in [least, most]; a bound of 0 does not bind."""
    maf = minor_frequency(F.col(af))
    kept = variants.filter(maf >= least) if least else variants
    return kept.filter(maf <= most) if most else kept


def exclude_regions(variants: DataFrame, regions: DataFrame, bin_width: int = 1_000_000) -> DataFrame:
    """Variants strictly inside any region go.

    Regions are cut at bins of positions, so the join is an equi-join on (chrom, bin) with a bound on each row.
    """
    cut = regions.select(
        F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"),
        F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width))).alias("r_bin"),
    )
    inside = (
        (F.col("chrom") == F.col("r_chrom")) & (F.floor(F.col("pos") / bin_width) == F.col("r_bin"))
        & (F.col("pos") > F.col("r_start")) & (F.col("pos") < F.col("r_end"))
    )
    return variants.join(cut, inside, "left_anti")


def filter_pairs_by_p(pairs: DataFrame, p: float, least: int = 2) -> DataFrame:
    """Pairs with a chi-squared p-value below p, of genes that keep at least `least` of them.

    The threshold is turned into a chi-squared cut once, so no row needs a p-value.
    """
    passed = pairs.filter((F.col("beta") / F.col("se")) * (F.col("beta") / F.col("se")) > chi2_cut(p))
    genes = passed.groupBy("gene_id").count().filter(F.col("count") >= least).select("gene_id")
    return passed.join(genes, "gene_id", "left_semi")


def keep_individuals(people: DataFrame, *needed: DataFrame, keep: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """People who stand in every needed table and in keep, at most `most` of them in file order."""
    for table in [*needed, *([keep] if keep is not None else [])]:
        people = people.join(table.select("fid", "iid").distinct(), ["fid", "iid"], "left_semi")
    return people if most is None else people.orderBy("ord").limit(most)


def gwas_qc(
    gwas: DataFrame, reference: DataFrame, max_af_diff: float = 0.2, min_maf: float = 0.0, max_maf: float = 0.0,
    max_p: float = 1.0, outlier_sd: float | None = None,
) -> DataFrame:
    """C17: gwas with reason: the first rule that a row breaks, else null.

    In order: allele, af_diff, fixed, maf, p, n_outlier, no_effect. A missing frequency is the reference's, turned
    round where the alleles are swapped. The sample-size rule holds only with outlier_sd; it compares with the
    median and deviation of the known sizes of rows that broke none of the rules before it, and passes unknown ones.
    """
    from .aggregates import exact_median
    from .joins import align_alleles

    ref = reference.select("snp", F.col("a1").alias("ref_a1"), F.col("a2").alias("ref_a2"), F.col("af").alias("ref_af"))
    rows = align_alleles(gwas.join(ref, "snp"), keep_inconsistent=True)
    rows = rows.withColumn("af", F.coalesce("af", F.when(F.col("orient") == -1, 1 - F.col("ref_af")).otherwise(F.col("ref_af"))))
    mafs = [minor_frequency(F.col(c)) for c in ("af", "ref_af")]
    few = [m < min_maf for m in mafs] if min_maf else []
    many = [m > max_maf for m in mafs] if max_maf else []
    off = F.lit(False)
    for bound in few + many:
        off = off | bound
    reason = (
        F.when(F.col("orient").isNull(), "allele").when(F.abs(F.col("ref_af") - F.col("af")) > max_af_diff, "af_diff")
        .when(F.col("af").isin(0.0, 1.0), "fixed").when(off, "maf").when(F.col("p") > max_p, "p")
    )
    rows = rows.withColumn("reason", reason)
    outlier = F.lit(False)
    if outlier_sd is not None:
        # written once: the median, the deviation and the result read it
        rows = materialise(rows, "gwas")
        sound = rows.filter("reason is null and n is not null").select(F.col("n").cast("double").alias("n"))
        median, sd = exact_median(sound, "n"), sound.agg(F.stddev_samp("n")).first()[0]
        if sd is not None:
            outlier = F.abs(F.col("n") - median) > outlier_sd * sd
    reason = F.coalesce("reason", F.when(outlier, "n_outlier").when(F.col("b").isNull(), "no_effect"))
    return rows.withColumn("reason", reason)


def running_sum(rows: DataFrame, order: tuple[str, ...], measure: Column | None, name: str) -> DataFrame:
    """Adds name: the sum of measure (1 where None) over the rows before, in the order given over all rows.

    The rows are sorted over all partitions and written once, each with its place, so that the sums of whole
    partitions and the rows they are added to come from the same files. A task sees its own range only, and
    one number a partition is broadcast.
    """
    sized = rows.withColumn("__size", F.lit(1).cast("long") if measure is None else measure)
    placed = materialise(sized.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__part", F.shiftright("__mid", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    sums = placed.groupBy("__part").agg(F.sum("__size").alias("__sum"))
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    if measure is None:
        own = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        within = Window.partitionBy("__part").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
        own = F.coalesce(F.sum("__size").over(within), F.lit(0))
    out = placed.withColumn("__own", own).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__own"))
    return out.drop("__size", "__mid", "__part", "__own", "__start")


def reindex(rows: DataFrame, *order: str, name: str = "idx", group: tuple[str, ...] = ()) -> DataFrame:
    """Dense 0-based index in the order given, within each group or over all rows; ties in any order."""
    if group:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    if not order:
        raise EngineError("an order is needed")
    return running_sum(rows, order, None, name)


def is_proximal(chrom: Column, at: Column, other_chrom: Column, other_at: Column, window: float) -> Column:
    """Same chromosome and strictly less than window apart, in bp or cM."""
    return (chrom == other_chrom) & (F.abs(at - other_at) < window)


def drop_constant(genotypes: DataFrame, dosage: str = "dosage", least: float = 1e-6) -> DataFrame:
    """Variants whose dosages differ by `least` or more; missing ones do not count."""
    return genotypes.filter(F.array_max(dosage) - F.array_min(dosage) >= least)


def require_polymorphic(genotypes: DataFrame, dosage: str = "dosage") -> DataFrame:
    """Genotypes, or an error that names a variant of one dosage only."""
    known = F.array_compact(dosage)
    flat = genotypes.filter((F.size(known) == 0) | (F.array_max(known) == F.array_min(known))).select("snp").first()
    if flat is not None:
        raise EngineError(f"variant {flat.snp} has no variation")
    return genotypes


def annotation_members(members: DataFrame, variants: DataFrame) -> DataFrame:
    """Members (label, snp) of annotations that are in variants (snp, af), with twopq, and with the share of all
    variants that each label has."""
    kept = members.join(variants.select("snp", (2 * F.col("af") * (1 - F.col("af"))).alias("twopq")), "snp")
    share = kept.groupBy("label").agg((F.count("*") / F.lit(variants.count())).alias("fraction"))
    return kept.join(share, "label")
