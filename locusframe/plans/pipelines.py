"""Whole conversions: each flag of the blueprint is a keyword argument here."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, require_rows, require_unique
from ..operators import aggregates as A
from ..operators import filters as C
from ..operators import joins as D
from ..operators import ld as L
from ..operators import merges as H
from ..operators.aggregates import sample_size_stats, weighted_frequency
from ..sinks import writers as K
from ..sources import binary as B
from ..sources import text as R
from ..sources.datasource import register
from ..storage import materialise, release

Study = dict[str, DataFrame]


def load_study(spark: SparkSession, kind: str, path: str, folder: str = "", reference: DataFrame | None = None) -> Study:
    """genes, variants and pairs of an flist, a BESD set (path without suffix) or a gzipped pair table."""
    if kind == "flist":
        return R.read_flist(spark, path, folder)
    if kind == "query":
        return R.read_query(spark, path, reference)
    if kind == "besd":
        sets, failed = load_sets(spark, [path], reference)
        if failed:
            raise EngineError(f"{path}: {failed[path]}")
        study = {k: rows.drop("set") for k, rows in sets.items()}
        return study if reference is None else select_study(study, variants=reference)
    raise EngineError(f"unknown kind {kind}")


def load_sets(spark: SparkSession, paths: list[str], reference: DataFrame | None = None) -> tuple[Study, dict[str, str]]:
    """Genes, variants and pairs of all BESD sets that can be read, with set, the place in paths; and the reason for each
    of the others. With a reference, its variants only; if it has alleles, flagged and dropped as by read_esi.

    All sets are one scan: headers are looked at beforehand, descriptions are read together, and one source plans the
    ranges of all matrices. A set without a pair that counts, or with a repeated gene, fails.
    """
    failed, good = {}, []
    for path in paths:
        try:
            B.besd_layout(path + ".besd")
            missing = [x for x in (".esi", ".epi") if not B.file_exists(path + x)]
            if missing:
                raise EngineError(f"{path}{missing[0]} is not there")
            good.append(path)
        except (EngineError, OSError) as e:
            failed[path] = str(e)
    if not good:
        return {}, failed
    register(spark)

    def numbered(rows: DataFrame, suffix: str) -> DataFrame:
        plain = F.regexp_replace("file_path", "^file:/+", "/")
        places = F.create_map(*[F.lit(v) for k, p in enumerate(good) for v in (re.sub("^file:/+", "/", p) + suffix, k)])
        return rows.withColumn("set", F.try_element_at(places, plain)).drop("file_path")

    esi = numbered(R.read_esi(spark, [p + ".esi" for p in good]), ".esi")
    placed = C.reindex(esi, "set", "ord", name="row")
    first = placed.groupBy("set").agg(F.min("row").alias("first"))
    # one row a set
    variants = placed.join(F.broadcast(first), "set").withColumn("row", F.col("row") - F.col("first")).drop("first")
    if reference is not None:
        variants = R.flag_flipped(variants, reference)
    genes = materialise(numbered(R.read_epi(spark, [p + ".epi" for p in good]), ".epi"), "besd-genes")
    pairs = spark.read.format("locus_besd").option("prefixes", json.dumps(good)).load().select("set", "gene_id", "row", "beta", "se")
    flag = ["flipped"] if "flipped" in variants.columns else []
    pairs = pairs.join(variants.select("set", "row", "snp", *flag), ["set", "row"]).join(F.broadcast(genes.select("set", "gene_id", F.col("n").cast("long").alias("n"))), ["set", "gene_id"]).drop("row")
    # in order of sets, so that who reads one set of many passes over the others' pages
    pairs = materialise(pairs.sortWithinPartitions("set"), "besd-pairs")
    release(spark)
    # a row a set
    there = {r[0] for r in pairs.select("set").distinct().collect()}
    twice = {r[0]: r[1] for r in genes.groupBy("set", "gene_id").count().filter("count > 1").groupBy("set").agg(F.min("gene_id")).collect()}
    for k, path in enumerate(good):
        if k not in there or k in twice:
            failed[path] = f"repeated gene_id: {twice[k]}" if k in twice else "no pairs left"
    kept = [k for k, path in enumerate(good) if path not in failed]
    numbers = F.create_map(*[F.lit(v) for k in kept for v in (k, paths.index(good[k]))]) if kept else None
    sets = {"genes": genes, "variants": variants.drop("row"), "pairs": pairs}
    return ({k: rows.filter(F.col("set").isin(kept)).withColumn("set", F.element_at(numbers, F.col("set"))) for k, rows in sets.items()} if kept else {}), failed


def load_studies(spark: SparkSession, paths: list[str], reference: DataFrame | None = None) -> tuple[list[Study], dict[str, str]]:
    """The BESD sets that can be read, one by one, and the reason for each of the others."""
    sets, failed = load_sets(spark, paths, reference)
    good = [k for k, path in enumerate(paths) if path not in failed]
    return [{name: rows.filter(F.col("set") == k).drop("set") for name, rows in sets.items()} for k in good], failed


def load_gwas(spark: SparkSession, path: str, reference: DataFrame, impute_n: bool = False, **quality: float) -> DataFrame:
    """The rows of a .ma file that pass all rules of quality control against the reference (snp, a1, a2, af), effects
    turned to its alleles; impute_n replaces their sample sizes (J11). quality: the parameters of gwas_qc."""
    rows = C.gwas_qc(R.read_table(spark, "ma", path), reference, **quality)
    kept = require_rows(rows.filter("reason is null"), "matched variants").drop("reason")
    return L.impute_sample_size(kept) if impute_n else kept


def load_aligned_pairs(spark: SparkSession, kind: str, path: str, reference: DataFrame, eigen: DataFrame, variants: DataFrame | None = None, max_missing: float = 0.3) -> DataFrame:
    """Pairs of a BESD set or pair table aligned to the reference's genes (gene_id, snp, af), missing ones imputed
    through each gene's eigen row. With variants (snp, pos), a variant at another position is an error."""
    study = load_study(spark, kind, path)
    if variants is not None:
        D.check_positions(study["variants"], variants)
    extra = [c for c in ("af", "flipped") if c in study["variants"].columns]
    pairs = study["pairs"].join(study["variants"].select("snp", *extra), "snp", "left")
    return L.align_and_impute(reference, pairs, eigen, max_missing)


def load_eigen(spark: SparkSession, path: str | list[str], cutoff: float = 0.9999, kind: str = "ldblock", reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(eigen rows, variants) of a block folder or of eigen sets by prefix, cut again where cutoff is below the
    stored one. kind gene takes a reference (snp, a1, a2), whose missing variants drop a gene."""
    if isinstance(path, str) and B.file_exists(f"{path}/ldm.info") or isinstance(path, str) and B.file_exists(f"{path}/ldm.info/_SUCCESS"):
        blocks, variants = R.read_block_folder_info(spark, path)
        order = blocks.select(F.col("block").alias("region"), F.col("ord").alias("region_ord"))
        members = variants.select(F.col("block").alias("region"), "snp", F.col("idx").alias("ord")).join(order, "region")
        return L.retruncate(B.read_eigen(spark, f"{path}/*.eigen.bin", members), cutoff), variants
    prefixes = [path] if isinstance(path, str) else path
    # all regions of the files, as blocks follow their order; those that the reference drops go afterwards
    listed, variants = R.read_eigen_info(spark, prefixes, kind)
    first = listed.groupBy("region", "file_path").agg(F.min("ord").alias("region_ord"))
    members = listed.join(first, ["region", "file_path"]).withColumn("name", F.regexp_extract("file_path", r"([^/]*?)\.eigen\.", 1))
    rows = B.read_eigen(spark, [f"{p}.eigen.{kind}.bin" for p in prefixes], members.select("region", "region_ord", "snp", "ord", "name"))
    if reference is not None:
        kept, variants = R.read_eigen_info(spark, prefixes, kind, reference)
        rows = rows.join(kept.select("region").distinct(), "region", "left_semi")
    return L.retruncate(rows, cutoff), variants


def load_gene_eigen(spark: SparkSession, prefixes: list[str], reference: DataFrame, max_missing: float = 0.3, cutoff: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """(eigen rows, variants) of gene sets against a reference (snp, pos, a1, a2). Genes of which more than max_missing of the
    variants are not in it go; a variant at another position, or with other alleles, is an error. Variants have typed, whether the
    reference has them, flipped, and af turned round where they are."""
    members, variants = R.read_eigen_info(spark, prefixes, "gene")
    D.check_positions(variants, reference)
    ref = reference.select("snp", F.col("a1").alias("ref_a1"), F.col("a2").alias("ref_a2"))
    known = D.align_alleles(variants.join(ref, "snp", "left"), beta="none", keep_inconsistent=True).withColumn("typed", F.col("ref_a1").isNotNull())
    known = materialise(known, "gene-variants")
    other = known.filter("typed and orient is null").first()
    if other is not None:
        raise EngineError(f"variant {other.snp} has other alleles in the reference")
    here = members.withColumn("set", _set_of("file_path")).join(known.select("snp", "typed", _set_of("file_path").alias("set")), ["set", "snp"], "left")
    rate = here.groupBy("region").agg(F.avg((~F.coalesce("typed", F.lit(False))).cast("int")).alias("missing"))
    kept = rate.filter(F.col("missing") <= max_missing).select("region")
    eigen, _ = load_eigen(spark, prefixes, cutoff, "gene")
    return eigen.join(kept, "region", "left_semi"), known.drop("ref_a1", "ref_a2", "orient", "file_path")


def merge_eigen_sets(spark: SparkSession, prefixes: list[str], path: str, kind: str = "gene", cutoff: float = 0.9999, parts: int = 1) -> tuple[DataFrame, dict[str, str]]:
    """The regions of several eigen sets that stand in one of them only, written as sets again; returns their list and
    the reason for each set that cannot be read. Of a variant in several sets the first set's row counts.

    Files of all sets are read together, and sets that contradict themselves are told in one pass each rule.
    """
    failed = {}
    for p in prefixes:
        missing = [x for x in (f".eigen.{kind}.bin", f".eigen.{kind}.info", f".eigen.{kind}.snp.info") if not B.file_exists(p + x)]
        if missing:
            failed[p] = f"{p}{missing[0]} is not there"
    good = [p for p in prefixes if p not in failed]
    if good:
        members = materialise(R.read_table(spark, f"eigen_{'gene' if kind == 'gene' else 'block'}_info", *[f"{p}.eigen.{kind}.info" for p in good]), "eigen-members").withColumn("set", _set_of("file_path"))
        variants = R.read_table(spark, "eigen_snp_info", *[f"{p}.eigen.{kind}.snp.info" for p in good]).withColumn("set", _set_of("file_path"))
        rules = {
            "a variant twice": variants.groupBy("set", "snp").count().filter("count > 1").select("set"),
            "a pair twice": members.groupBy("set", "region", "snp").count().filter("count > 1").select("set"),
            "a variant is not described": members.join(variants.select("set", "snp"), ["set", "snp"], "left_anti").select("set"),
            "another number of members": members.groupBy("set", "region").agg(F.count("*").alias("k"), F.max("n_snps").alias("n")).filter("k <> n").select("set"),
        }
        for why, found in rules.items():
            # a row a set
            bad = {r[0] for r in found.distinct().collect()}
            failed |= {p: why for p in good if p.rpartition("/")[2] in bad and p not in failed}
        good = [p for p in good if p not in failed]
    if not good:
        raise EngineError("; ".join(f"{p}: {why}" for p, why in failed.items()) or "no sets")
    eigen = materialise(H.merge_eigen([load_eigen(spark, good, cutoff, kind)[0]]).drop("part"), "eigen-merged")
    order = F.create_map(*[F.lit(v) for k, p in enumerate(good) for v in (p.rpartition("/")[2], k)])
    first = H.first_of_each(variants.withColumn("of", F.try_element_at(order, F.col("set"))).filter("of is not null").drop("file_path"), ["snp"], ["of", "ord"])
    about = members.join(eigen.select("region"), "region", "left_semi").select("region", "chrom", "start", "end", *(["window"] if kind == "gene" else []))
    return K.write_eigen_set(eigen, about, first, None, path, kind, parts), failed


def _set_of(path: str) -> Column:
    """The name of the set that a file belongs to."""
    return F.regexp_extract(path, r"([^/]*?)\.eigen\.", 1)


def load_ld(spark: SparkSession, path: str | list[str], keep: DataFrame | None = None, shrink: DataFrame | None = None, **shrinkage: float) -> tuple[DataFrame, DataFrame]:
    """(info, ld) of one set, several shards, or a .mldm list of shards; with shrink (snp, gen_pos) also J7, on the
    frequencies of info."""
    if isinstance(path, str):
        # one line a shard
        path = [r.value for r in R.read_lines(spark, path).orderBy("file_path", "ord").collect()] if path.endswith(".mldm") else [path]
    info, ld = B.read_ld_set(spark, path, keep=keep)
    if shrink is None:
        return info, ld
    v = info.select("idx", "snp", (2 * F.col("af") * (1 - F.col("af"))).alias("twopq")).join(shrink.select("snp", "gen_pos"), "snp")
    return info, L.shrink(ld, v, **shrinkage)


def select_study(
    study: Study, *, variants: DataFrame | None = None, genes: DataFrame | None = None, without_genes: DataFrame | None = None, gene: str | None = None,
    chrom: int = 0, max_p: float = 1.0, window_mb: float | None = None, sizes: DataFrame | None = None,
) -> Study:
    """The study restricted as asked, in this order; genes and variants without a pair go at the end (C21), and with window_mb genes
    have their windows (C14).

    The pairs are written once, so that what refers to them does not compute them anew; none left is an error.
    """
    g, v, p = study["genes"], study["variants"], study["pairs"]
    if variants is not None:
        v = C.include_ids(v, variants)
    v = C.include_chromosome(v, chrom)
    if genes is not None:
        g = C.include_ids(g, genes, "gene_id")
    if without_genes is not None:
        g = C.exclude_ids(g, without_genes, "gene_id")
    if gene is not None:
        g = C.include_one(g, "gene_id", gene)
    p = C.include_ids(C.include_ids(p, v), g, "gene_id")
    if max_p < 1:
        p = C.filter_pairs_by_p(p, max_p)
    if window_mb is not None:
        p = D.filter_pairs_by_window(p, v, g, window_mb)
        g = D.gene_windows(g, v, window_mb)
    if sizes is not None:
        p = R.with_gene_sizes(p, sizes)
    p = require_rows(materialise(p, "study-pairs"), "pairs")
    return {"genes": C.include_ids(g, p, "gene_id"), "variants": C.include_ids(v, p), "pairs": p}


def load_proteins(
    spark: SparkSession, rsid_map: str, protein_map: str, root: str = "", build: int = 19, max_p: float = 1.0, chromosomes: list[int] | None = None, negative_log: bool = True
) -> tuple[Study, dict[str, DataFrame]]:
    """The study of all proteins of a map whose results lie in a folder each, and the tables set aside: `elsewhere`,
    proteins on no numbered chromosome, `repeated`, ids whose rsid is not alone, and `absent`, proteins without a result that counts.

    All folders are one scan: a file's name tells its folder, which is joined to the map as a dimension, and its
    chromosome. Files and rows of chromosome 23, or of others than those asked for, are left out. A relative folder lies in root. A
    protein's size is the mean over its pairs; an rsid twice in a protein is an error.
    """
    ids, repeated = R.read_rsid_map(spark, rsid_map, build)
    proteins, elsewhere = R.read_protein_map(spark, protein_map)
    proteins = require_unique(proteins, "gene_id")
    plain = F.regexp_replace(F.when(F.col("folder").startswith("/") | F.col("folder").contains(":"), F.col("folder")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "folder")), "^file:/+", "/")
    proteins = materialise(proteins.withColumn("folder", F.rtrim(plain, F.lit("/"))), "proteins")
    # the folders that hold the proteins' folders: one, or a few
    parents = [r[0] for r in proteins.select(F.regexp_replace("folder", "/[^/]*$", "")).distinct().collect()]
    if not parents:
        raise EngineError("no protein on a numbered chromosome")
    results = R.read_pqtl_files(spark, [f"{p}/*/*_chr*_*" for p in parents], ids, chromosomes, max_p, negative_log)
    pairs = results.join(proteins.select("gene_id", "folder"), "folder").select("gene_id", F.col("rsid").alias("snp"), "beta", "se", "p", "n", "af")
    pairs = require_unique(materialise(pairs, "protein-pairs"), "gene_id", "snp")
    sizes = sample_size_stats(pairs)
    genes = proteins.join(sizes.withColumnRenamed("n_mean", "n"), "gene_id").select("gene_id", "chrom", ((F.col("start") + F.col("end")) / 2).alias("mid"), "ord", "n")
    # frequencies of several proteins are averaged by size
    seen = pairs.groupBy("snp").agg(weighted_frequency(F.col("af"), F.col("n")).alias("af"))
    variants = ids.join(seen, ids.rsid == seen.snp).select("snp", "chrom", "pos", "a1", "a2", "af").withColumn("ord", F.struct("chrom", "pos", "snp"))
    absent = proteins.join(pairs.select("gene_id").distinct(), "gene_id", "left_anti")
    return {"genes": genes, "variants": variants, "pairs": pairs.drop("af", "p")}, {"elsewhere": elsewhere, "repeated": repeated, "absent": absent}


def merge_block_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """H3: (blocks, variants) of the files block<k>.snp.info of a folder, in the order of k, with indices that run on over all
    blocks; as read_block_folder_info gives them for a merged folder.

    The number stands in the file's name. Sizes of blocks are summed, one row each, and joined to the variants. Only an
    empty folder is an error.
    """
    number = F.regexp_extract("file_path", r"block(\d+)[^/]*$", 1).try_cast("long")
    try:
        rows = R.read_table(spark, "block_snp_info", f"{folder}/block*.snp.info").withColumn("number", number).filter("number is not null")
    except AnalysisException as e:
        raise EngineError(f"{folder}: no block to merge") from e
    rows = require_rows(materialise(rows, "block-variants"), "blocks")
    blocks = H.merge_blocks(rows.select(F.concat(F.lit("block"), "number").alias("block"), "chrom", "snp", F.col("ord").alias("index")))
    blocks = materialise(blocks, "blocks")
    within = C.reindex(rows, "ord", name="place", group=("number",))
    variants = within.join(blocks.select(F.col("block_number").alias("number"), "start_idx"), "number").withColumn("idx", F.col("start_idx") + F.col("place"))
    info = blocks.select(F.col("block_number").cast("string").alias("block"), "chrom", "start_idx", F.col("first_snp").alias("start_snp"), "end_idx", F.col("last_snp").alias("end_snp"), "n_snps")
    return info, variants.select("chrom", "snp", "idx", "gen_pos", "pos", "a1", "a2", "af", "n", F.col("number").cast("string").alias("block"))


def merge_block_summaries(spark: SparkSession, prefix: str) -> DataFrame:
    """H4: the rows of the files <prefix>.block<k>*.ma, in the order of k and of the file: (block_number, ord, snp, ...). Of several
    files of one block the last by name counts; the others are not read.

    Files are listed first, with nothing of them read; what is chosen is a path a block.
    """
    number = F.regexp_extract("path", r"\.block(\d+)[^/]*\.ma$", 1).try_cast("long")
    listed = spark.read.format("binaryFile").load(f"{prefix}.block*.ma").select("path").withColumn("number", number).filter("number is not null")
    chosen = listed.groupBy("number").agg(F.max("path").alias("path")).collect()
    if not chosen:
        raise EngineError(f"{prefix}: no block to merge")
    rows = R.read_table(spark, "ma", *[r.path for r in chosen])
    return rows.withColumn("block_number", F.regexp_extract("file_path", r"\.block(\d+)[^/]*\.ma$", 1).cast("long")).drop("file_path")


def merge_study_files(spark: SparkSession, paths: list[str], soft: bool = False, reference: DataFrame | None = None) -> Study:
    """H1: BESD sets united from one scan, the first set's row of each gene, variant and pair. A set that cannot be read is an
    error, unless soft; none left is one in any case."""
    sets, failed = load_sets(spark, paths, reference)
    if not sets or failed and not soft:
        raise EngineError("; ".join(f"{p}: {why}" for p, why in failed.items()) or "no sets")
    return {
        "genes": H.first_of_each(sets["genes"], ["gene_id"], ["set", "ord"]), "variants": H.first_of_each(sets["variants"], ["snp"], ["set", "ord"]),
        "pairs": H.first_of_each(sets["pairs"], ["gene_id", "snp"], ["set"]),
    }


def export_study(study: Study, kind: str, path: str, parts: int | None = None, array_limit: int = 1000, binary: bool = False, gzip: bool = False) -> DataFrame | None:
    """besd, besd_file, query, ma, sumstats or annotation; besd and ma return the list of what was written. parts of a BESD set
    follow the number of pairs, parts are the least; besd_file is one set of all genes, path its prefix. gzip: an annotation
    matrix, which has a cell for each variant and gene, is written compressed."""
    g, v, p = study["genes"], study["variants"], study["pairs"]
    if kind == "besd":
        return K.write_besd(p, v, g, path, parts or 1)
    if kind == "besd_file":
        return K.write_besd_file(p, v, g, path)
    if kind == "query":
        return K.write_query(p, v, g, path)
    if kind == "ma":
        return K.write_ma(p, v, path, array_limit)
    if kind == "sumstats":
        return K.write_text(K.sumstats_rows(p, v, g), path)
    if kind == "annotation":
        # sorted over all partitions, the header first
        return K.annotation_lines(p, g, binary).select("line").write.text(path, compression="gzip" if gzip else "none")
    raise EngineError(f"unknown kind {kind}")


def load_individuals(
    spark: SparkSession, fam: str, phenotype: str, trait: int = 1, covariates: str | None = None, random: str | None = None, residual: str | None = None, keep: str | None = None, most: int | None = None
) -> tuple[DataFrame, list[str], list[str]]:
    """(people, names of fixed effects, names of random ones): fid, iid, person (the place in the .fam file), idx (dense,
    in its order), root_weight, y, x and w of the people that stand in every file given, at most `most` of them.

    root_weight is 1 over the root of the residual variance, 1 without such a file or where it lacks a person; y, x and w are
    multiplied by it. Without covariates x is the intercept, without random ones w is empty. No one left is an error.
    """
    people = C.reindex(R.read_fam(spark, fam).select("fid", "iid", "ord"), "ord", name="person")
    key, tables = ["fid", "iid"], [R.read_phenotype(spark, phenotype, trait).withColumnRenamed("value", "y")]
    fixed, names_w = ["intercept"], []
    if covariates is not None:
        fixed, rows = R.read_covariates(spark, covariates)
        tables.append(rows.withColumnRenamed("covariates", "x"))
    if random is not None:
        names_w, rows = R.read_covariates(spark, random, intercept=False)
        tables.append(rows.withColumnRenamed("covariates", "w"))
    kept = C.keep_individuals(people, *tables, keep=None if keep is None else R.read_table(spark, "keep", keep), most=most)
    for rows in tables:
        kept = kept.join(rows, key)
    weight = F.lit(1.0)
    if residual is not None:
        kept = kept.join(R.read_residual_weights(spark, residual), key, "left")
        weight = F.sqrt(F.coalesce("weight", F.lit(1.0)))
    kept = kept.withColumn("root_weight", weight)
    x = F.col("x") if covariates is not None else F.array(F.lit(1.0))
    w = F.col("w") if random is not None else F.array().cast("array<double>")
    scaled = [F.transform(c, lambda v: v * F.col("root_weight")).alias(n) for c, n in ((x, "x"), (w, "w"))]
    out = C.reindex(kept.select("fid", "iid", "person", "root_weight", (F.col("y") * F.col("root_weight")).alias("y"), *scaled), "person")
    return require_rows(materialise(out, "people"), "people"), fixed, names_w


def individual_products(people: DataFrame, fixed: list[str], random: list[str]) -> DataFrame:
    """(left, right, value) of load_individuals' people: X'X, X'y and W'W by names, and ypy about the mean as (y, y)."""
    columns = [F.get("x", F.lit(k)).alias(f"x:{n}") for k, n in enumerate(fixed)] + [F.get("w", F.lit(k)).alias(f"w:{n}") for k, n in enumerate(random)]
    rows = people.select("y", *columns)
    xs, ws = [f"x:{n}" for n in fixed], [f"w:{n}" for n in random]
    out = A.cross_products(rows, xs, [*xs, "y"])
    out = out.unionAll(A.cross_products(rows, ws, ws)) if ws else out
    return out.unionAll(people.select(F.lit("y").alias("left"), F.lit("y").alias("right"), (F.var_pop("y") * F.count("y")).alias("value")))


def weighted_genotypes(genotypes: DataFrame, people: DataFrame, scale: bool = True) -> DataFrame:
    """A3 with A8: genotype_stats of the people's dosages, each person's multiplied by root_weight; genotypes hold the people in the
    order of idx. One row, a number a person, meets all variants."""
    roots = people.agg(F.sort_array(F.collect_list(F.struct("idx", "root_weight"))).alias("p")).select(F.lit(0).alias("__one"), F.col("p.root_weight").alias("__roots"))
    rows = B.genotype_stats(genotypes, scale).withColumn("__one", F.lit(0)).join(F.broadcast(roots), "__one")
    rows = rows.withColumn("z", F.zip_with("z", "__roots", lambda z, r: z * r)).drop("__one", "__roots")
    return rows.withColumn("sum_squares", F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))


def load_genotypes(spark: SparkSession, prefix: str, *, extract: DataFrame | None = None, exclude: DataFrame | None = None, chrom: int = 0, keep: DataFrame | None = None) -> DataFrame:
    """(idx, snp, chrom, pos, gen_pos, a1, a2, dosage) of a .bed/.bim/.fam set, variants and people restricted."""
    people = C.reindex(R.read_fam(spark, prefix + ".fam"), "ord", name="person")
    variants = C.reindex(R.read_bim(spark, prefix + ".bim"), "ord", name="file_idx")
    if extract is not None:
        variants = C.include_ids(variants, extract)
    if exclude is not None:
        variants = C.exclude_ids(variants, exclude)
    variants = require_rows(C.include_chromosome(variants, chrom), "variants")
    chosen = None
    if keep is not None:
        # places of the people kept: one number a person
        chosen = sorted(r.person for r in people.join(keep.select("fid", "iid"), ["fid", "iid"], "left_semi").select("person").collect())
    rows = C.reindex(variants.select("snp", "chrom", "pos", "gen_pos", "a1", "a2", F.col("file_idx").cast("long").alias("file_idx")), "file_idx")
    return B.read_bed(prefix + ".bed", rows, people.count(), chosen)


def build_ld(
    genotypes: DataFrame, kind: str = "full", people: int | None = None, *, least_r: float | None = None, chi2: float = 10.0, width: int | None = None, check: bool = True, **shrinkage: float
) -> DataFrame:
    """Full, sparse, band (by r or by distance), shrunk or sparseshrunk matrices, i <= j; band by r is mirrored.

    A variant of one dosage only is an error (J1b), unless check is false. Thresholds and reaches go into the tiles: sparse
    drops small values where they are computed, and shrunk and banded matrices form no pair of tiles out of reach or of two
    chromosomes. Columns of variants whose skeleton is true stay in sparse matrices.
    """
    genotypes = C.require_polymorphic(genotypes) if check else genotypes
    if kind == "full":
        return L.ld_pairs(genotypes)
    if kind == "band":
        return L.band_by_r(L.mirrored(L.ld_pairs(genotypes)), least_r) if width is None else L.ld_pairs(genotypes, reach=width // 2)
    n = people or genotypes.select(F.size("dosage")).first()[0]
    least = least_r * least_r if least_r is not None else chi2 / n
    # a little below the bound, as the tiles' products and the filter may round apart
    skeleton = genotypes.filter("skeleton").select("idx") if "skeleton" in genotypes.columns else None
    if kind == "sparse":
        ld = L.ld_pairs(genotypes, least_r2=least * (1 - 1e-9))
        return L.sparse(ld if skeleton is None else L.mirrored(ld), n, least_r, chi2, skeleton=skeleton)
    if kind in ("shrunk", "sparseshrunk"):
        stats = B.genotype_stats(genotypes).select("idx", "gen_pos", "twopq")
        ld = L.ld_pairs(genotypes, reach=L.shrink_reach(**{k: v for k, v in shrinkage.items() if k in ("ne", "cut", "map_n")}), along="gen_pos")
        out = L.shrink(ld, stats, **shrinkage)
        return out if kind == "shrunk" else L.sparse(out, n, least_r, chi2)
    raise EngineError(f"unknown kind {kind}")


def build_block_eigen(genotypes: DataFrame, blocks: DataFrame, cutoff: float = 0.9999, margin: int = 0) -> DataFrame:
    """Variants to blocks by position, then one decomposition a block."""
    mapped = D.map_to_blocks(genotypes.select("snp", "chrom", "pos"), blocks, margin).select("snp", F.col("block_id").alias("region"))
    return L.region_eigen(require_rows(genotypes.join(mapped, "snp"), "mapped variants"), cutoff)


def build_gene_eigen(genotypes: DataFrame, pairs: DataFrame, cutoff: float = 0.9999) -> DataFrame:
    """Each gene's variants, in the order of the genotypes, one decomposition a gene."""
    return L.region_eigen(genotypes.join(pairs.select("snp", F.col("gene_id").alias("region")).distinct(), "snp"), cutoff)
