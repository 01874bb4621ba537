"""Set operations and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stack(parts: list[DataFrame], name: str = "part") -> DataFrame:
    """All parts below one another by column name, with their number."""
    numbered = [p.withColumn(name, F.lit(k)) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """H1, H6: the first row of each key in the order given; max/min of structs, so it aggregates map-side."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*key, "__row.*")


def only_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key stands once; repeated keys go altogether."""
    once = rows.groupBy(*key).count().filter("count = 1").select(*key)
    return rows.join(once, key, "left_semi")


def merge_studies(studies: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """H1: each study has genes, variants and pairs. Dimensions keep the first study's row, pairs are united, and
    a pair that two studies hold keeps the first."""
    genes = first_of_each(stack([s["genes"] for s in studies]), ["gene_id"], ["part", "ord"])
    variants = first_of_each(stack([s["variants"] for s in studies]), ["snp"], ["part", "ord"])
    pairs = first_of_each(stack([s["pairs"] for s in studies]), ["gene_id", "snp"], ["part"])
    return {"genes": genes, "variants": variants, "pairs": pairs}


def merge_eigen(sets: list[DataFrame], key: str = "region") -> DataFrame:
    """H2: regions of several sets; a region that stands in two goes."""
    return only_unique(stack(sets), [key])


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """H3: (block, chrom, snp, index) of single blocks with start_idx and end_idx in the merged numbering, in
    numeric block order."""
    from .windows import running_offsets

    sizes = blocks.groupBy("block", "chrom").agg(F.count("*").alias("n_snps"), F.min_by("snp", "index").alias("first_snp"), F.max_by("snp", "index").alias("last_snp"))
    out = running_offsets(sizes.withColumn("block_number", F.regexp_extract("block", r"(\d+)", 1).cast("long")), "n_snps", "block_number")
    return out.select("block", "block_number", "chrom", F.col("offset").alias("start_idx"), "first_snp", (F.col("offset") + F.col("n_snps") - 1).alias("end_idx"), "last_snp", "n_snps")


def merge_by_block(parts: DataFrame, block: str = "block_number", listed: str = "listed") -> DataFrame:
    """H4: rows of one file for each block, the file that is listed last, in block order."""
    last = parts.groupBy(block).agg(F.max(listed).alias(listed))
    return parts.join(last, [block, listed], "left_semi")


def split_ranges(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """H5: (part, first, last), 1-based and both included, of ceil(n / parts) each."""
    size = -(-n // parts)
    rows = spark.range(parts).select((F.col("id") + 1).alias("part"), (F.col("id") * size + 1).alias("first"), F.least(F.lit(n), (F.col("id") + 1) * size).alias("last"))
    return rows.filter(F.col("first") <= F.col("last"))


def part_of(idx: Column, n: int, parts: int) -> Column:
    """H5: the 0-based part of a 0-based index, by the ranges of split_ranges."""
    return F.floor(idx / max(1, -(-n // parts)))
