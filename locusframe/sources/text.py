"""Text tables: one description a format, one reader for all of them.

A description gives the columns by position and, where the format has a header line, its first word. Numbers
that do not parse become null, as do the sentinels that stand for missing values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, require_unique
from ..functions.scalar import chromosome, is_missing, positive_integer
from ..operators.joins import align_alleles, lookup
from ..operators.merges import first_of_each, only_unique

_GENO_INFO = "snp string, a1 string, a2 string, af double"

#: name: (first word of the header or None, columns)
FORMATS: dict[str, tuple[str | None, str]] = {
    "fam": (None, "fid string, iid string, father string, mother string, sex int, phen string"),
    "bim": (None, "chrom int, snp string, gen_pos double, pos int, a1 string, a2 string"),
    "keep": (None, "fid string, iid string"),
    "residual": (None, "fid string, iid string, d double"),
    "ids": (None, "snp string"),
    "regions": (None, "chrom int, start int, end int"),
    "genetic_map": (None, "snp string, pos int, gen_pos double"),
    "ld_scores": (None, "snp string, ldsc double"),
    "frequencies": (None, "snp string, a1 string, af double"),
    "windows": ("SNP", "snp string, window int"),
    "blocks": ("Block", "block_id string, chrom int, start int, end int"),
    "ma": ("SNP", "snp string, a1 string, a2 string, af double, b double, se double, p double, n double"),
    "snp_results": ("Id", "idx long, snp string, chrom int, pos int, af double, effect double, se double, pip double, window int"),
    "esd": ("Chr", "chrom int, snp string, pos int, a1 string, a2 string, af double, beta double, se double, p double"),
    "flist": ("Chr", "chrom int, probe_id string, gen_dist double, mid double, gene string, n long, orientation string, path string"),
    "plist": ("chr", "chrom int, start int, end int, gene_id string, path string"),
    "gene_pheno": ("FID", "fid string, iid string, value double"),
    "rsid_map": ("ID", "id string, a2 string, a1 string, rsid string, pos19 int, pos38 int"),
    "protein_map": ("gene", "gene_id string, chrom string, start int, end int, folder string"),
    "pqtl": ("CHROM", "chrom int, pos int, id string, a0 string, a1 string, af double, info double, n long, test string, beta double, se double, chisq double, log10p double, extra string"),
    "ldm_info": ("Block", "block string, chrom int, start_idx long, start_snp string, end_idx long, end_snp string, n_snps long"),
    "block_snp_info": ("Chrom", "chrom int, snp string, idx long, gen_pos double, pos int, a1 string, a2 string, af double, n double, block string"),
    "eigen_gene_info": ("Chrom", "chrom int, region string, start int, end int, window double, snp string, n_snps int"),
    "eigen_block_info": ("Chrom", "chrom int, region string, start int, end int, snp string, n_snps int"),
    "eigen_snp_info": ("Chrom", f"chrom int, snp string, gen_pos double, pos int, {_GENO_INFO.split(', ', 1)[1]}, n double"),
}
#: Missing values by column; any other column has none.
SENTINELS = {"gen_pos": (-9.0, -999.0), "gen_dist": (-999.0,), "af": (-999.0, -9.0), "se": (-9.0, -999.0), "beta": (-999.0,), "b": (-999.0,), "n": (-999.0,), "value": (-9.0,), "phen": ("-9",)}


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, ord, file_path): lines with a number that grows along each file, also where a file has many splits."""
    rows = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    place = F.shiftleft(F.shiftright("at", 20), 33) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.filter(F.trim("value") != "").select("value", place.alias("ord"), "file_path")


def read_table(spark: SparkSession, name: str, *paths: str, strict: bool = False) -> DataFrame:
    """The columns of a format with ord and file_path. strict makes lines of another width an error."""
    header, columns = FORMATS[name]
    fields = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    rows = read_lines(spark, *paths).withColumn("parts", F.split(F.trim("value"), r"[ \t]+"))
    if header:
        rows = rows.filter(F.regexp_replace(F.col("parts")[0], "^#", "") != header)
    if strict:
        bad = rows.filter(F.size("parts") != len(fields)).first()
        if bad is not None:
            raise EngineError(f"{bad.file_path}: {len(bad.parts)} columns where {name} has {len(fields)}")
    out = []
    for k, (column, kind) in enumerate(fields):
        value = F.get("parts", F.lit(k))
        if kind != "string":
            value = value.try_cast(kind)
        for missing in SENTINELS.get(column, ()):
            value = F.when(value != missing, value)
        out.append(value.alias(column))
    return rows.select(*out, "ord", "file_path")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """A1."""
    return require_unique(read_table(spark, "fam", path), "fid", "iid")


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """A2."""
    return require_unique(read_table(spark, "bim", path), "snp")


def read_phenotype(spark: SparkSession, path: str, trait: int = 1) -> DataFrame:
    """A5: (fid, iid, value) of a 1-based trait; NA, -9 and lines that are no numbers go."""
    parts = F.split(F.trim("value"), r"[ \t]+")
    rows = read_lines(spark, path).select(parts[0].alias("fid"), parts[1].alias("iid"), F.get(parts, F.lit(trait + 1)).try_cast("double").alias("value"))
    return rows.filter("value is not null and value <> -9")


def read_covariates(spark: SparkSession, path: str, intercept: bool = True) -> tuple[list[str], DataFrame]:
    """Names and (fid, iid, covariates); the header is the file's first line."""
    lines = read_lines(spark, path).withColumn("parts", F.split(F.trim("value"), r"[ \t]+"))
    first = lines.orderBy("ord").first()
    if first is None:
        raise EngineError(f"{path} is empty")
    names = first.parts[2:]
    values = F.transform(F.slice("parts", 3, len(names)), lambda x: x.try_cast("double"))
    values = F.concat(F.array(F.lit(1.0)), values) if intercept else values
    rows = lines.filter(F.col("ord") != first.ord).select(F.col("parts")[0].alias("fid"), F.col("parts")[1].alias("iid"), values.alias("covariates"))
    return (["intercept"] * intercept + names), rows


def read_residual_weights(spark: SparkSession, path: str) -> DataFrame:
    """(fid, iid, weight)."""
    return read_table(spark, "residual", path).select("fid", "iid", (1 / F.col("d")).alias("weight"))


def read_genes(spark: SparkSession, plist: str) -> DataFrame:
    """(chrom, start, end, mid, gene_id, ord) of a list of genes."""
    genes = read_table(spark, "plist", plist)
    return genes.select("chrom", "start", "end", ((F.col("start") + F.col("end")) / 2).alias("mid"), "gene_id", "ord")


def read_gene_phenotypes(spark: SparkSession, plist: str, folder: str | None = None, people: DataFrame | None = None) -> DataFrame:
    """(gene_id, fid, iid, value) of all genes of a list, each file matched by its name; of known people only,
    where they are given. A person twice in a gene is an error."""
    genes = read_table(spark, "plist", plist).withColumn("file", F.element_at(F.split("path", "/"), -1)).select("gene_id", "file", F.col("path").alias("own"))
    # one name a gene
    names = [(f"{folder}/{r.file}" if folder else r.own) for r in genes.select("file", "own").collect()]
    rows = read_table(spark, "gene_pheno", *names).withColumn("file", F.element_at(F.split("file_path", "/"), -1))
    out = rows.join(genes.select("gene_id", "file"), "file").filter("value is not null").select("gene_id", "fid", "iid", "value")
    out = out if people is None else out.join(people.select("fid", "iid"), ["fid", "iid"], "left_semi").select("gene_id", "fid", "iid", "value")
    return require_unique(out, "gene_id", "fid", "iid")


def read_flist(spark: SparkSession, path: str, folder: str) -> dict[str, DataFrame]:
    """Genes, variants and pairs of a list of .esd files, keyed by probe.

    The first sighting of a variant, by gene and then line, gives its position, alleles and frequency.
    """
    genes = read_table(spark, "flist", path).drop("path", "gene", "file_path").withColumnRenamed("probe_id", "gene_id")
    require_unique(genes, "gene_id")
    listed = read_table(spark, "flist", path).select(F.col("probe_id").alias("gene_id"), F.col("ord").alias("gene_ord"), F.element_at(F.split(F.col("path"), "/"), -1).alias("file"), F.regexp_replace("path", r"^\./", "").alias("own"))
    names = [f"{folder}/{r.own}" for r in listed.select("own").collect()]
    rows = read_table(spark, "esd", *names, strict=True).withColumn("file", F.element_at(F.split("file_path", "/"), -1))
    rows = rows.join(listed.drop("own"), "file")
    variants = first_of_each(rows.select("snp", "chrom", "pos", "a1", "a2", "af", "gene_ord", "ord"), ["snp"], ["gene_ord", "ord"])
    pairs = rows.select("gene_id", "snp", "beta", "se", "p")
    return {"genes": genes, "variants": variants, "pairs": pairs.join(genes.select("gene_id", "n"), "gene_id")}


def read_esi(spark: SparkSession, path: str | list[str], reference: DataFrame | None = None) -> DataFrame:
    """Variants of a BESD set, with N if the file has it; X and Y are 23 and 24, missing values null. Of several files
    each row has its file_path.

    With a reference (snp, and a1 and a2 if alleles are to be checked), only its variants stay; flipped tells those whose
    alleles are swapped there, and those with other alleles go.
    """
    many = isinstance(path, list)
    rows = read_lines(spark, *(path if many else [path])).withColumn("parts", F.split(F.trim("value"), r"[ \t]+"))
    part = [F.get("parts", F.lit(k)) for k in range(8)]

    def number(k: int, kind: str):
        value = F.when(~is_missing(part[k]), part[k].try_cast(kind))
        return F.when(value != -9, value)

    out = rows.select(
        chromosome(part[0]).alias("chrom"), part[1].alias("snp"), number(2, "double").alias("gen_pos"), number(3, "int").alias("pos"),
        *[F.when(~is_missing(part[k]), F.upper(part[k])).alias(f"a{k - 3}") for k in (4, 5)], number(6, "double").alias("af"), number(7, "double").alias("n"), "ord", *(["file_path"] if many else []),
    )
    return out if reference is None else flag_flipped(out, reference)


def flag_flipped(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Variants that the reference has. If it has alleles, flipped tells those whose alleles are swapped there, and those
    with other alleles go; alleles, frequencies and effects stay as they are."""
    if "a1" not in reference.columns:
        return variants.join(reference.select("snp"), "snp", "left_semi")
    ref = reference.select("snp", F.col("a1").alias("ref_a1"), F.col("a2").alias("ref_a2"))
    return align_alleles(variants.join(ref, "snp"), beta="none", af="none").drop("orient", "ref_a1", "ref_a2")


def read_epi(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Probes, of 6 or 7 columns; the distance column is no position, so start and end stay null. Of several files each
    row has its file_path, and a gene may stand in each."""
    many = isinstance(path, list)
    rows = read_lines(spark, *(path if many else [path])).withColumn("parts", F.split(F.trim("value"), r"[ \t]+"))
    part, wide = [F.get("parts", F.lit(k)) for k in range(7)], F.size("parts") == 7
    distance = part[2].try_cast("double")
    out = rows.select(
        chromosome(part[0]).alias("chrom"), part[1].alias("gene_id"), F.when(distance != -999, distance).alias("gen_dist"), part[3].try_cast("double").alias("mid"), part[4].alias("probe_id"),
        F.when(wide, part[5].try_cast("long")).alias("n"), F.when(wide, part[6]).otherwise(part[5]).alias("orientation"), "ord", *(["file_path"] if many else []),
    )
    return out if many else require_unique(out, "gene_id")


QUERY_COLUMNS = "GeneID GeneChr GeneLength GenePhyPos SNPID SNPChr SNPPhyPos A1 A2 A1Freq BETA SE Pvalue N".split()


def read_query(spark: SparkSession, path: str, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Genes, variants and pairs of a gzipped pair table. Its header must be the fourteen names.

    Pairs whose N is not a positive integer go; n_mean and n_sd are each gene's; has_pairs: more than one pair. With a
    reference only its variants stay; if it has alleles, variants with others go with their pairs, and variants and pairs tell in
    flipped where the alleles are swapped.
    """
    from ..operators.aggregates import sample_size_stats

    rows = spark.read.csv(path, sep="\t", header=True)
    if rows.columns != QUERY_COLUMNS:
        raise EngineError(f"{path}: header is not {' '.join(QUERY_COLUMNS)}")
    rows = rows.filter(positive_integer(F.col("N"))).withColumn("ord", F.monotonically_increasing_id())
    flag = []
    if reference is not None:
        rows = flag_flipped(rows.withColumnsRenamed({"SNPID": "snp", "A1": "a1", "A2": "a2"}), reference).withColumnsRenamed({"snp": "SNPID", "a1": "A1", "a2": "A2"})
        flag = ["flipped"] if "flipped" in rows.columns else []
    pairs = rows.select(F.col("GeneID").alias("gene_id"), F.col("SNPID").alias("snp"), *[F.col(c).try_cast("double").alias(d) for c, d in (("BETA", "beta"), ("SE", "se"), ("Pvalue", "p"))], F.col("N").cast("long").alias("n"), "ord", *flag)
    variants = first_of_each(rows.select(F.col("SNPID").alias("snp"), F.col("SNPChr").cast("int").alias("chrom"), F.col("SNPPhyPos").cast("int").alias("pos"), F.col("A1").alias("a1"), F.col("A2").alias("a2"), F.col("A1Freq").try_cast("double").alias("af"), "ord", *flag), ["snp"], ["ord"])
    genes = first_of_each(rows.select(F.col("GeneID").alias("gene_id"), F.col("GeneChr").cast("int").alias("chrom"), F.col("GeneLength").try_cast("int").alias("length"), F.col("GenePhyPos").try_cast("double").alias("mid"), "ord"), ["gene_id"], ["ord"])
    counts = pairs.groupBy("gene_id").agg((F.count("*") > 1).alias("has_pairs"))
    return {"genes": genes.join(sample_size_stats(pairs), "gene_id").join(counts, "gene_id"), "variants": variants, "pairs": pairs.drop("ord")}


def read_rsid_map(spark: SparkSession, path: str, build: int = 19) -> tuple[DataFrame, DataFrame]:
    """(id, rsid, chrom, pos, a1, a2) of rsids that stand once, and the repeated ones."""
    rows = read_table(spark, "rsid_map", path)
    chrom = F.split_part("id", F.lit(":"), F.lit(1)).try_cast("int").alias("chrom")
    rows = rows.select("id", "rsid", chrom, F.col(f"pos{build}").alias("pos"), "a1", "a2")
    kept = only_unique(rows, ["rsid"])
    return kept, rows.join(kept.select("rsid"), "rsid", "left_anti")


def read_protein_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Proteins on numbered chromosomes, and the others."""
    rows = read_table(spark, "protein_map", path)
    numbered = F.col("chrom").rlike(r"^\d+$")
    return rows.filter(numbered).withColumn("chrom", F.col("chrom").cast("int")), rows.filter(~numbered)


def line_count(spark: SparkSession, *paths: str) -> int:
    """Lines of plain or compressed files."""
    return spark.read.text(list(paths)).count()


def read_pqtl(spark: SparkSession, paths: list[str], ids: DataFrame, max_p: float = 1.0, negative_log: bool = True) -> DataFrame:
    """Results of one protein over all its chromosome files but that of chromosome 23, with rsids."""
    from ..functions.scalar import p_from_log10

    paths = [p for p in paths if "_chr23_" not in p]
    rows = read_table(spark, "pqtl", *paths).withColumn("p", p_from_log10(F.col("log10p"), negative_log))
    return rows.filter(F.col("p") <= max_p).join(ids.select("id", "rsid"), "id")


def read_pqtl_folder(spark: SparkSession, folder: str, ids: DataFrame, chromosomes: list[int] | None = None, max_p: float = 1.0, negative_log: bool = True) -> DataFrame:
    """read_pqtl over the files of a folder whose names hold _chr<k>_, of the chromosomes given or of all but 23."""
    return read_pqtl_files(spark, [f"{folder}/*_chr*_*"], ids, chromosomes, max_p, negative_log)


def read_pqtl_files(spark: SparkSession, paths: list[str], ids: DataFrame, chromosomes: list[int] | None = None, max_p: float = 1.0, negative_log: bool = True) -> DataFrame:
    """Results of all files that match, with rsid and folder, the file's. Rows of other files than those of the
    chromosomes given, or of all but 23, are told by the file's name alone, and such rows in other files go too."""
    from ..functions.scalar import p_from_log10

    wanted = F.regexp_extract("file_path", r"_chr(\d+)_[^/]*$", 1).try_cast("int")
    rows = read_table(spark, "pqtl", *paths).filter(wanted.isin(chromosomes) if chromosomes else wanted != 23)
    rows = rows.filter(F.col("chrom").isin(chromosomes) if chromosomes else F.col("chrom") != 23).withColumn("p", p_from_log10(F.col("log10p"), negative_log))
    rows = rows.withColumn("folder", F.regexp_replace(F.regexp_replace("file_path", "^file:/+", "/"), "/[^/]*$", ""))
    return rows.filter(F.col("p") <= max_p).join(ids.select("id", "rsid"), "id")


def read_snp_results(spark: SparkSession, path: str, mixture: bool = False, variants: DataFrame | None = None) -> DataFrame:
    """Posterior results (snp, chrom, pos, af, effect, se, pip and window; with mixture a share pi instead of window).

    With variants, those that are listed, with the results' frequency and effect; a listed one that they lack is an error.
    """
    rows = read_table(spark, "snp_results", path)
    if mixture:
        parts = F.split(F.trim("value"), r"[ \t]+")
        share = read_lines(spark, path).select(parts[1].alias("snp"), F.get(parts, F.lit(8)).try_cast("double").alias("pi"))
        rows = rows.drop("window").join(share, "snp")
    rows = rows.drop("idx", "file_path")
    if variants is None:
        return rows
    return lookup(rows.select("snp", "af", "effect"), variants.drop("af", "effect"), "snp", strict=True)


_LD_COLUMNS = "chrom int, snp string, gen_pos double, pos int, a1 string, a2 string, af double, idx long, window_start long, window_end long, window_size long, window_width double, n double, sampling_var double, ld_sum double, skeleton int"


def read_ld_info(spark: SparkSession, *paths: str) -> DataFrame:
    """What the rows of a correlation matrix are about, with ord and file_path. The four layouts are told by their
    width: 12 columns without frequency and sums (and without a header), 14 without ld_sum, 15, and 16 with skeleton."""
    rows = read_lines(spark, *paths).withColumn("parts", F.split(F.trim("value"), r"[ \t]+")).filter(F.col("parts")[0] != "Chrom")
    rows = rows.withColumn("old", F.size("parts") == 12)
    out = []
    for k, (name, kind) in enumerate(c.rsplit(" ", 1) for c in _LD_COLUMNS.split(", ")):
        # the old layout has no frequency, so what follows stands one column to the left
        at = F.lit(k) if k < 6 else F.when(F.col("old"), k - 1).otherwise(k)
        value = F.get("parts", at)
        value = F.when(~F.col("old"), value) if name == "af" else value
        out.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    return rows.select(*out, "ord", "file_path")


def with_ld_info(variants: DataFrame, info: DataFrame) -> DataFrame:
    """Variants (snp, idx) with the columns of LD rows of the same id. An LD row without a variant, or with another
    index, is an error."""
    given = info.select("snp", F.col("idx").alias("ld_idx"), "window_start", "window_end", "window_size", "n", "sampling_var", "ld_sum", "skeleton")
    odd = given.join(variants.select("snp", "idx"), "snp", "left").filter(F.col("idx").isNull() | (F.col("idx") != F.col("ld_idx"))).first()
    if odd is not None:
        raise EngineError(f"variant {odd.snp} of the matrix " + ("is unknown" if odd.idx is None else "has another index"))
    return variants.join(given.drop("ld_idx"), "snp", "left")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(ord, block_id, chrom, start, end); an id twice is an error."""
    rows = require_unique(read_table(spark, "blocks", path), "block_id")
    return rows.select("ord", "block_id", "chrom", "start", "end")


def read_block_folder_info(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of ldm.info and variants of snp.info of a block folder; a variant twice is an error."""
    variants = require_unique(read_table(spark, "block_snp_info", f"{folder}/snp.info"), "snp")
    return read_table(spark, "ldm_info", f"{folder}/ldm.info"), variants


def read_eigen_info(spark: SparkSession, prefixes: list[str], kind: str = "ldblock", reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (chrom, region, start, end, snp, n_snps, ord, file_path) and variants of eigen sets, of LD
    blocks or of genes (with window).

    A pair of region and variant twice, a variant twice in one set, a region with another number of members than it states
    or with one that its variants lack are errors. With a reference (snp, a1, a2), genes with a variant that it lacks
    go, and a variant with other alleles is an error, swapped ones are flipped.
    """
    variants = read_table(spark, "eigen_snp_info", *[f"{p}.eigen.{kind}.snp.info" for p in prefixes])
    variants = require_unique(variants, "snp", "file_path")
    members = read_table(spark, f"eigen_{'gene' if kind == 'gene' else 'block'}_info", *[f"{p}.eigen.{kind}.info" for p in prefixes])
    members = require_unique(members, "region", "snp", "file_path")
    lost = members.join(variants.select("snp"), "snp", "left_anti").first()
    if lost is not None:
        raise EngineError(f"region {lost.region}: variant {lost.snp} is not described")
    short = members.groupBy("region", "file_path").agg(F.count("*").alias("k"), F.max("n_snps").alias("n")).filter("k <> n").first()
    if short is not None:
        raise EngineError(f"region {short.region}: {short.k} members of {short.n}")
    if reference is None:
        return members, variants
    ref = reference.select("snp", F.col("a1").alias("ref_a1"), F.col("a2").alias("ref_a2"))
    aligned = align_alleles(variants.join(ref, "snp", "left"), beta="none", keep_inconsistent=True)
    other = aligned.filter("ref_a1 is not null and orient is null").first()
    if other is not None:
        raise EngineError(f"variant {other.snp} has other alleles in the reference")
    known = aligned.filter("ref_a1 is not null").drop("ref_a1", "ref_a2", "orient")
    gone = members.join(known.select("snp"), "snp", "left_anti").select("region").distinct()
    return members.join(gone, "region", "left_anti"), known


def read_gene_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, snp or null, n); a header is told by a size that is no number."""
    parts = F.split(F.trim("value"), r"[ \t]+")
    wide = F.size(parts) == 3
    rows = read_lines(spark, path).select(parts[0].alias("gene_id"), F.when(wide, parts[1]).alias("snp"), F.when(wide, F.get(parts, F.lit(2))).otherwise(parts[1]).try_cast("double").cast("long").alias("n"))
    return rows.filter("n is not null")


def with_gene_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs with n from the file: by pair, else by gene, else their own."""
    by_pair = sizes.filter("snp is not null").select("gene_id", "snp", F.col("n").alias("n_pair"))
    by_gene = sizes.filter("snp is null").select("gene_id", F.col("n").alias("n_gene"))
    out = pairs.join(by_pair, ["gene_id", "snp"], "left").join(by_gene, "gene_id", "left")
    return out.withColumn("n", F.coalesce("n_pair", "n_gene", "n")).drop("n_pair", "n_gene")


def overlay(variants: DataFrame, values: DataFrame, column: str, missing: tuple[float, ...] = ()) -> DataFrame:
    """The column of values set by id; variants without one, or with a missing value, go."""
    given = values.select("snp", column).filter(F.col(column).isNotNull() & ~F.col(column).isin(*missing) if missing else F.col(column).isNotNull())
    return variants.drop(column).join(given, "snp")
