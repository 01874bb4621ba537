"""Joins by id, alleles and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EngineError, require_rows


def align_alleles(rows: DataFrame, beta: str = "b", af: str = "af", keep_inconsistent: bool = False) -> DataFrame:
    """Rows hold a1, a2 and ref_a1, ref_a2. orient is 1 where they agree and -1 where they are swapped; then
    beta changes sign and af becomes 1 - af. Others go, or stay with orient null. No strand is complemented."""
    same = (F.col("a1") == F.col("ref_a1")) & (F.col("a2") == F.col("ref_a2"))
    swapped = (F.col("a1") == F.col("ref_a2")) & (F.col("a2") == F.col("ref_a1"))
    out = rows.withColumn("orient", F.when(same, 1).when(swapped, -1))
    out = out if keep_inconsistent else out.filter("orient is not null")
    flips = {c: F.when(F.col("orient") == -1, x).otherwise(F.col(c)) for c, x in ((beta, -F.col(beta)), (af, 1 - F.col(af))) if c in out.columns}
    return out.withColumns(flips).withColumn("flipped", F.col("orient") == -1)


def interval_join(points: DataFrame, spans: DataFrame, margin: float = 0, bin_width: int = 1_000_000) -> DataFrame:
    """Points (chrom, pos) within spans (chrom, start, end), ends and margin included; all pairs.

    Spans are cut at position bins: an equi-join on (chrom, bin) that shuffles on many keys and bounds each row.
    """
    first = F.floor((F.col("start") - margin) / bin_width)
    last = F.floor((F.col("end") + margin) / bin_width)
    cut = spans.withColumnRenamed("chrom", "span_chrom").withColumn("span_bin", F.explode(F.sequence(first, last)))
    on = (
        (F.col("chrom") == F.col("span_chrom")) & (F.floor(F.col("pos") / bin_width) == F.col("span_bin"))
        & (F.col("pos") >= F.col("start") - margin) & (F.col("pos") <= F.col("end") + margin)
    )
    return points.join(cut, on).drop("span_chrom", "span_bin")


def map_to_blocks(variants: DataFrame, blocks: DataFrame, margin: int = 0, least: int = 2) -> DataFrame:
    """Each variant with its block. Blocks have ord, block_id, chrom, start and end.

    A variant on a shared border belongs to the block that comes first; blocks with fewer than `least`
    variants go; none mapped is an error where the caller asks for rows. The positions are joined once.
    """
    spans = blocks.select(F.col("ord").alias("block_ord"), "block_id", "chrom", "start", "end")
    hits = interval_join(variants, spans, margin)
    rest = [c for c in hits.columns if c != "snp"]
    mine = hits.groupBy("snp").agg(F.min_by(F.struct(*rest), "block_ord").alias("__row")).select("snp", "__row.*")
    of_block = Window.partitionBy("block_id")
    return mine.withColumn("__n", F.count("*").over(of_block)).filter(F.col("__n") >= least).drop("__n")


def map_to_genes(variants: DataFrame, genes: DataFrame, window_mb: float = 0.1, least: int = 2) -> DataFrame:
    """Variants within window of a gene's midpoint, both ends included; genes with too few of them go."""
    half = int(window_mb * 1e6)
    spans = genes.select("gene_id", "chrom", (F.col("mid") - half).alias("start"), (F.col("mid") + half).alias("end"))
    hits = interval_join(variants, spans)
    enough = hits.groupBy("gene_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("gene_id")
    return hits.join(enough, "gene_id", "left_semi")


def gene_windows(genes: DataFrame, variants: DataFrame, window_mb: float = 0.1) -> DataFrame:
    """C14: genes with start and end, window bp to both sides of the midpoint but not beyond the chromosome's first and last
    variant, and window. Genes of chromosomes without a variant are not clipped."""
    half = int(window_mb * 1e6)
    # one row a chromosome
    ends = variants.groupBy("chrom").agg(F.min("pos").alias("__first"), F.max("pos").alias("__last"))
    rows = genes.drop("start", "end", "window").join(F.broadcast(ends), "chrom", "left")
    start, end = F.greatest(F.col("mid") - half, F.col("__first")), F.least(F.col("mid") + half, F.col("__last"))
    return rows.withColumns({"start": start, "end": end, "window": F.lit(half)}).drop("__first", "__last")


def filter_pairs_by_window(pairs: DataFrame, variants: DataFrame, genes: DataFrame, window_mb: float = 0.1) -> DataFrame:
    """C14: pairs whose variant lies in the gene's window."""
    return pairs.join(map_to_genes(variants, genes, window_mb).select("gene_id", "snp"), ["gene_id", "snp"], "left_semi")


def nearest_at_or_after(queries: DataFrame, points: DataFrame, bin_width: int = 1_000_000) -> DataFrame:
    """For each query (qid, chrom, at) the first point (snp, chrom, pos) with pos >= at, ties by snp; null if none.

    A running minimum over the merged rows would sort a whole chromosome in one task. Instead each bin of
    positions keeps its first point, and a query looks into its own bin and the next bin that has one.
    """
    bins = points.withColumn("bin", F.floor(F.col("pos") / bin_width))
    firsts = bins.groupBy("chrom", "bin").agg(F.min(F.struct("pos", "snp")).alias("first"))
    asked = queries.withColumn("bin", F.floor(F.col("at") / bin_width))
    within = asked.join(bins.select("chrom", "bin", "pos", "snp"), ["chrom", "bin"]).filter("pos >= at")
    own = within.groupBy("qid").agg(F.min(F.struct("pos", "snp")).alias("own"))
    # one row for each bin that a point or a query is in
    every = firsts.join(asked.select("chrom", "bin").distinct(), ["chrom", "bin"], "full")
    after = Window.partitionBy("chrom").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    later = every.withColumn("next", F.min("first").over(after)).select("chrom", "bin", "next")
    out = asked.join(own, "qid", "left").join(later, ["chrom", "bin"], "left").withColumn("hit", F.coalesce("own", "next"))
    return out.select(*queries.columns, F.col("hit.pos").alias("pos"), F.col("hit.snp").alias("snp"))


def gene_variant_maps(pairs: DataFrame, variants: DataFrame, cis: DataFrame) -> dict[str, DataFrame]:
    """Cis variants of each gene with and without an effect, the number of genes of each variant, and the variants of no gene."""
    typed = cis.select("gene_id", "snp").join(pairs.select("gene_id", "snp"), ["gene_id", "snp"], "left_semi")
    rest = cis.select("gene_id", "snp").join(pairs.select("gene_id", "snp"), ["gene_id", "snp"], "left_anti")
    counts = typed.groupBy("snp").agg(F.countDistinct("gene_id").alias("n_genes"))
    per_variant = variants.select("snp").join(counts, "snp", "left").fillna(0, ["n_genes"])
    return {"with_effect": typed, "without_effect": rest, "genes_per_variant": per_variant, "intergenic": per_variant.filter("n_genes = 0").select("snp")}


def gene_phenotypes(people: DataFrame, gene_pheno: DataFrame) -> DataFrame:
    """Phenotypes of known people, with each gene's variance and the centred value."""
    rows = gene_pheno.join(people.select("fid", "iid"), ["fid", "iid"])
    about = rows.groupBy("gene_id").agg(F.var_samp("value").alias("variance"), F.avg("value").alias("mean"))
    return rows.join(about, "gene_id").withColumn("centred", F.col("value") - F.col("mean")).drop("mean")


def align_to_reference_genes(reference: DataFrame, pairs: DataFrame, max_missing: float = 0.3) -> DataFrame:
    """The reference's (gene_id, snp, any more) with the pairs' beta, se and n where there are some.

    af is the pairs' where that is above 0, else the reference's, if either has one; flipped is the pairs'. Genes that
    the pairs lack, and those that lack more than max_missing of their variants, go; typed tells which pairs were there.
    """
    taken = [c for c in ("beta", "se", "n", "af", "flipped") if c in pairs.columns]
    own = pairs.select("gene_id", "snp", *[F.col(c).alias(f"__{c}") for c in taken], F.lit(True).alias("__typed"))
    rows = reference.join(pairs.select("gene_id").distinct(), "gene_id", "left_semi").join(own, ["gene_id", "snp"], "left")
    for c in taken:
        value = F.col(f"__{c}")
        if c == "af":
            value = F.coalesce(F.when(value > 0, value), F.col("af") if "af" in reference.columns else F.lit(None).cast("double"))
        rows = rows.withColumn(c, value).drop(f"__{c}")
    rows = rows.withColumn("typed", F.coalesce("__typed", F.lit(False))).drop("__typed")
    missing = rows.groupBy("gene_id").agg(F.avg((~F.col("typed")).cast("int")).alias("missing"))
    return rows.join(missing.filter(F.col("missing") <= max_missing).select("gene_id"), "gene_id", "left_semi")


def check_positions(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows, or an error that names a variant whose position differs from the reference's."""
    other = reference.select("snp", F.col("pos").alias("__pos"))
    off = rows.join(other, "snp").filter(F.col("pos") != F.col("__pos")).select("snp").first()
    if off is not None:
        raise EngineError(f"variant {off.snp} has another position in the reference")
    return rows


def lookup(rows: DataFrame, dimension: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Equi-join by id; strict makes an id without a match an error."""
    if strict:
        lost = rows.join(dimension.select(key), key, "left_anti").select(key).first()
        if lost is not None:
            raise EngineError(f"{key} {lost[0]} is unknown")
    return require_rows(rows.join(dimension, key), key) if strict else rows.join(dimension, key)
