"""Sources and sinks as queries: tables derived from the given ones are written in a format, read back, and compared with
what was written. Files go to the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as X
from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import filters as C
from ..operators import joins as D
from ..operators import ld as L
from ..operators import merges as H
from ..operators import windows as W
from ..sinks import writers as K
from ..sources import binary as B
from ..sources import text as R
from ..sources.datasource import register
from ..storage import fresh_path
from . import pipelines as P
from .queries import effects, genes, genotypes, pairs, query, r6, two, variants


def folder(t, label: str) -> str:
    return fresh_path(t("region").sparkSession, label)


def lines(rows: DataFrame, path: str, *columns, header: str | None = None) -> str:
    """Rows as lines of blank-separated columns; a header stands in a file of its own, which readers pass over."""
    text = rows.select(F.concat_ws(" ", *columns).alias("value"))
    if header is not None:
        text = rows.sparkSession.createDataFrame([(header,)], "value string").unionAll(text)
    text.write.text(path)
    return path


def one_file(rows: DataFrame, folder: str, name: str, order, *columns, header: str | None = None) -> str:
    K.write_named(rows.select(F.lit(name).alias("name"), F.col(order).alias("ord"), F.concat_ws(" ", *columns).alias("line")), folder, header).count()
    return f"{folder}/{name}"


def spark_of(t):
    return t("region").sparkSession


# ---- text sources


@query("SELECT 'f' || c_custkey AS fid, 'i' || c_custkey AS iid, CAST(c_nationkey % 2 + 1 AS INTEGER) AS sex FROM customer")
def fam_scan(t):
    key = F.col("c_custkey").cast("string")
    path = lines(t("customer"), folder(t, "fam"), F.concat(F.lit("f"), key), F.concat(F.lit("i"), key), F.lit("0"), F.lit("0"), (F.col("c_nationkey") % 2 + 1), F.lit("-9"))
    return R.read_fam(spark_of(t), path).select("fid", "iid", "sex")


@query("SELECT chrom, snp, round(gen_pos, 4) AS gen_pos, pos::INTEGER AS pos, a1, a2 FROM variants")
def bim_scan(t):
    path = lines(variants(t), folder(t, "bim"), "chrom", "snp", "gen_pos", "pos", "a1", "a2")
    return R.read_bim(spark_of(t), path).select("chrom", "snp", F.round("gen_pos", 4).alias("gen_pos"), "pos", "a1", "a2")


@query("SELECT 'f' || c_custkey AS fid, round(c_acctbal, 2) AS value FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def phenotype_scan(t):
    value = F.when(F.col("c_custkey") % 7 == 0, "NA").when(F.col("c_custkey") % 11 == 0, "-9").otherwise(F.col("c_acctbal").cast("string"))
    path = lines(t("customer"), folder(t, "phen"), F.concat(F.lit("f"), "c_custkey"), F.lit("i"), F.lit("5.5"), value, header="FID IID other trait")
    return R.read_phenotype(spark_of(t), path, 2).select("fid", F.round("value", 2).alias("value"))


@query("SELECT 'f' || c_custkey AS fid, 1.0::DOUBLE AS intercept, round(c_acctbal, 2) AS balance, c_nationkey::DOUBLE AS nation FROM customer")
def covariate_scan(t):
    path = one_file(t("customer"), folder(t, "cov"), "covariates", "c_custkey", F.concat(F.lit("f"), "c_custkey"), F.lit("i"), "c_acctbal", "c_nationkey", header="FID IID balance nation")
    names, rows = R.read_covariates(spark_of(t), path)
    return rows.select("fid", *[F.round(F.get("covariates", F.lit(k)), 2).alias(n) for k, n in enumerate(names)])


@query("SELECT 'f' || c_custkey AS fid, round(c_acctbal, 2) AS balance, c_nationkey::DOUBLE AS nation FROM customer")
def random_covariate_scan(t):
    path = one_file(t("customer"), folder(t, "cov"), "covariates", "c_custkey", F.concat(F.lit("f"), "c_custkey"), F.lit("i"), "c_acctbal", "c_nationkey", header="FID IID balance nation")
    names, rows = R.read_covariates(spark_of(t), path, intercept=False)
    return rows.select("fid", *[F.round(F.get("covariates", F.lit(k)), 2).alias(n) for k, n in enumerate(names)])


@query("SELECT 'f' || c_custkey AS fid, round(1.0 / (c_nationkey + 2), 6) AS weight FROM customer")
def residual_weights(t):
    path = lines(t("customer"), folder(t, "diag"), F.concat(F.lit("f"), "c_custkey"), F.lit("i"), F.col("c_nationkey") + 2)
    return R.read_residual_weights(spark_of(t), path).select("fid", r6("weight").alias("weight"))


def individual_files(t) -> dict[str, str]:
    """People with a phenotype, covariates, residual variances and a list of those to keep, each file lacking some."""
    key, at = F.col("c_custkey").cast("string"), folder(t, "people")
    who = (F.concat(F.lit("f"), key), F.lit("i"))
    c = t("customer")
    return {
        "fam": one_file(c, at, "fam", "c_custkey", *who, F.lit("0 0 1 -9")),
        "phenotype": lines(c, folder(t, "phen"), *who, F.when(F.col("c_custkey") % 7 == 0, "NA").otherwise(F.format_string("%.2f", F.col("c_acctbal") / 1000)), header="FID IID trait"),
        "covariates": one_file(c.filter("c_custkey % 11 <> 0"), at, "cov", "c_custkey", *who, F.col("c_nationkey"), F.col("c_custkey") % 10, header="FID IID nation digit"),
        "random": one_file(c, at, "rnd", "c_custkey", *who, F.col("c_custkey") % 3, header="FID IID third"),
        "residual": lines(c.filter("c_custkey % 2 = 0"), folder(t, "diag"), *who, F.col("c_nationkey") + 2),
        "keep": lines(c.filter("c_custkey % 5 <> 0"), folder(t, "keep"), *who),
    }


@query("""
, p AS (SELECT 1 / sqrt(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 2 ELSE 1 END::DOUBLE) AS s, round(c_acctbal / 1000, 2) AS v, c_nationkey AS nation, c_custkey % 10 AS digit, c_custkey % 3 AS third
  FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 5 <> 0),
q AS (SELECT v * s AS y, s AS "x:intercept", nation * s AS "x:nation", digit * s AS "x:digit", third * s AS "w:third" FROM p),
x AS (SELECT row_number() OVER () AS k, * FROM q), long AS (UNPIVOT x ON y, "x:intercept", "x:nation", "x:digit", "w:third" INTO NAME name VALUE value)
SELECT a.name AS "left", b.name AS "right", round(sum(a.value * b.value), 3) AS value FROM long a JOIN long b USING (k)
WHERE (a.name LIKE 'x:%' AND (b.name LIKE 'x:%' OR b.name = 'y')) OR (a.name = 'w:third' AND b.name = 'w:third') GROUP BY 1, 2
UNION ALL SELECT 'y', 'y', round(var_pop(y) * count(*), 3) FROM q
""")
def individual_inputs(t):
    """Y, X and W of the people that stand in all files, weighted, through their products."""
    files = individual_files(t)
    people, fixed, random = P.load_individuals(spark_of(t), **files)
    out = P.individual_products(people, fixed, random)
    return out.select("left", "right", F.round("value", 3).alias("value"))


@query("SELECT s_suppkey::VARCHAR AS gene_id, CAST(s_suppkey % 22 + 1 AS INTEGER) AS chrom, s_suppkey * 1000.0 + 250 AS mid FROM supplier")
def gene_list_scan(t):
    key = F.col("s_suppkey")
    path = lines(t("supplier"), folder(t, "plist"), key % 22 + 1, key * 1000, key * 1000 + 500, key, F.concat(F.lit("x/"), key), header="chr start end geneID path")
    return R.read_genes(spark_of(t), path).select("gene_id", "chrom", "mid")


@query("""
, o AS (SELECT o_orderstatus AS gene_id, o_custkey AS iid, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)
SELECT gene_id, iid::VARCHAR AS iid, round(value, 2) AS value FROM o WHERE iid % 5 <> 0 AND iid % 3 <> 0
""")
def gene_phenotype_scan(t):
    at = folder(t, "genes")
    rows = t("orders").groupBy(F.col("o_orderstatus").alias("name"), F.col("o_custkey").alias("ord")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    value = F.when(F.col("ord") % 5 == 0, "NA").otherwise(F.col("v").cast("decimal(20,2)").cast("string"))
    K.write_named(rows.select("name", "ord", F.concat_ws(" ", F.lit("f"), "ord", value).alias("line")), at, "FID IID value").count()
    listed = lines(rows.select("name").distinct(), folder(t, "plist"), F.lit("1 0 10"), "name", F.concat(F.lit("elsewhere/"), "name"), header="chr start end geneID path")
    people = t("customer").filter("c_custkey % 3 <> 0").select(F.lit("f").alias("fid"), F.col("c_custkey").cast("string").alias("iid"))
    out = R.read_gene_phenotypes(spark_of(t), listed, at, people)
    return out.select("gene_id", "iid", F.round("value", 2).alias("value"))


def first_pairs(t) -> DataFrame:
    """One row a pair, with the gene's id as text."""
    rows = pairs(t).groupBy(F.concat(F.lit("g"), F.col("gene_id")).alias("gene_id"), "snp").agg(F.max(F.struct("line_order", "line", "n", "beta", "se")).alias("m"))
    return rows.select("gene_id", "snp", F.round("m.beta", 6).alias("beta"), F.round("m.se", 6).alias("se"), F.col("m.n").cast("long").alias("n"))


_FIRST = """
, first_pairs AS (SELECT gene_id, snp, round(m.beta, 6) AS beta, round(m.se, 6) AS se, m.n::BIGINT AS n
  FROM (SELECT 'g' || gene_id AS gene_id, snp, max({'o': line_order, 'l': line, 'n': n, 'beta': beta, 'se': se}) AS m FROM pairs GROUP BY 1, 2))
"""


def study(t) -> dict[str, DataFrame]:
    g = genes(t).select(F.concat(F.lit("g"), "gene_id").alias("gene_id"), "chrom", "mid", "ord", F.lit(500).cast("long").alias("n"))
    return {"genes": g, "variants": variants(t), "pairs": first_pairs(t)}


@query(_FIRST + "SELECT gene_id, snp, beta, se FROM first_pairs WHERE gene_id < 'g15'")
def flist_scan(t):
    at = folder(t, "esd")
    rows = first_pairs(t).filter("gene_id < 'g15'").join(variants(t), "snp")
    line = F.concat_ws("\t", "chrom", "snp", "pos", "a1", "a2", F.col("af"), "beta", "se", F.lit(0.5))
    K.write_named(rows.select(F.concat("gene_id", F.lit(".esd")).alias("name"), F.col("snp").alias("ord"), line.alias("line")), at, "Chr SNP Bp A1 A2 Freq Beta se p").count()
    listed = lines(rows.select("gene_id").distinct(), folder(t, "flist"), F.lit("1"), "gene_id", F.lit("0 1000 NA 500 +"), F.concat(F.lit("./"), "gene_id", F.lit(".esd")), header="Chr ProbeID GeneticDistance ProbeBp Gene N Orientation PathOfEsd")
    return R.read_flist(spark_of(t), listed, at)["pairs"].select("gene_id", "snp", r6("beta").alias("beta"), r6("se").alias("se"))


@query(_FIRST + "SELECT v.snp, v.chrom, v.pos::INTEGER AS pos, a1, round(af, 4) AS af FROM variants v WHERE snp IN (SELECT snp FROM first_pairs WHERE gene_id < 'g15')")
def flist_variants(t):
    at = folder(t, "esd")
    rows = first_pairs(t).filter("gene_id < 'g15'").join(variants(t), "snp")
    line = F.concat_ws("\t", "chrom", "snp", "pos", "a1", "a2", F.col("af"), "beta", "se", F.lit(0.5))
    K.write_named(rows.select(F.concat("gene_id", F.lit(".esd")).alias("name"), F.col("snp").alias("ord"), line.alias("line")), at, "Chr SNP Bp A1 A2 Freq Beta se p").count()
    listed = lines(rows.select("gene_id").distinct(), folder(t, "flist"), F.lit("1"), "gene_id", F.lit("0 1000 NA 500 +"), F.concat(F.lit("./"), "gene_id", F.lit(".esd")), header="Chr ProbeID GeneticDistance ProbeBp Gene N Orientation PathOfEsd")
    return R.read_flist(spark_of(t), listed, at)["variants"].select("snp", "chrom", "pos", "a1", F.round("af", 4).alias("af"))


def _esi(t) -> str:
    chrom = F.when(F.col("chrom") == 23, "X").when(F.col("chrom") == 24, "y").when(F.col("chrom") == 25, "NA").otherwise(F.col("chrom").cast("string"))
    swapped = F.col("ord") % 3 == 0
    alleles = [F.lower(F.when(swapped, F.col(b)).otherwise(F.col(a))) for a, b in (("a1", "a2"), ("a2", "a1"))]
    size = F.when(F.col("ord") % 5 == 0, "NA").otherwise((F.col("ord") + 100).cast("string"))
    return lines(variants(t), folder(t, "esi"), chrom, "snp", F.lit("0"), "pos", *alleles, F.when(F.col("ord") % 4 == 0, "NA").otherwise(F.col("af").cast("string")), size)


@query("""
SELECT snp, CASE WHEN chrom = 25 THEN NULL ELSE chrom END AS chrom, pos::INTEGER AS pos, CASE WHEN ord % 3 = 0 THEN a2 ELSE a1 END AS a1,
  CASE WHEN ord % 4 <> 0 THEN round(af, 4) END AS af, CASE WHEN ord % 5 <> 0 THEN ord + 100.0::DOUBLE END AS n FROM variants
""")
def esi_scan(t):
    return R.read_esi(spark_of(t), _esi(t)).select("snp", "chrom", "pos", "a1", F.round("af", 4).alias("af"), "n")


@query("SELECT snp, ord % 3 = 0 AND a1 <> a2 AS flipped FROM variants WHERE ord % 2 = 0 AND ord % 7 <> 0")
def esi_flipped(t):
    reference = variants(t).filter("ord % 2 = 0").withColumn("a1", F.when(F.col("ord") % 7 == 0, "N").otherwise(F.col("a1")))
    return R.read_esi(spark_of(t), _esi(t), reference).select("snp", "flipped")


@query("SELECT 'g' || gene_id AS gene_id, chrom, mid::DOUBLE AS mid, CASE WHEN gene_id % 2 = 0 THEN 500 END::BIGINT AS n, '+' AS orientation FROM genes")
def epi_scan(t):
    six = F.concat_ws(" ", "chrom", F.concat(F.lit("g"), "gene_id"), F.lit("-999"), "mid", F.lit("p"))
    path = lines(genes(t), folder(t, "epi"), F.when(F.col("gene_id") % 2 == 0, F.concat(six, F.lit(" 500 +"))).otherwise(F.concat(six, F.lit(" +"))))
    return R.read_epi(spark_of(t), path).select("gene_id", "chrom", "mid", "n", "orientation")


_IDS = "SELECT ord, chrom, chrom || ':' || pos AS id, CASE WHEN ord % 10 < 2 THEN 'dup' || ord // 10 ELSE snp END AS rsid, pos, a1, a2 FROM variants"


def _ids(t) -> str:
    rs = F.when(F.col("ord") % 10 < 2, F.concat(F.lit("dup"), F.floor(F.col("ord") / 10))).otherwise(F.col("snp"))
    return lines(variants(t), folder(t, "rsid"), F.concat_ws(":", "chrom", "pos"), "a2", "a1", rs, "pos", F.col("pos") + 5, header="ID a2 a1 rsid pos19 pos38")


@query(f", m AS ({_IDS}) SELECT id, rsid, chrom, pos::INTEGER + 5 AS pos, a1 FROM m WHERE rsid IN (SELECT rsid FROM m GROUP BY rsid HAVING count(*) = 1)")
def rsid_map_scan(t):
    return R.read_rsid_map(spark_of(t), _ids(t), 38)[0].select("id", "rsid", "chrom", "pos", "a1")


@query(f", m AS ({_IDS}) SELECT id, rsid FROM m WHERE rsid IN (SELECT rsid FROM m GROUP BY rsid HAVING count(*) > 1)")
def repeated_rsids(t):
    return R.read_rsid_map(spark_of(t), _ids(t), 38)[1].select("id", "rsid")


def _proteins(t) -> str:
    return lines(genes(t), folder(t, "proteins"), F.concat(F.lit("g"), "gene_id"), F.when(F.col("gene_id") % 9 == 0, "X").otherwise(F.col("chrom").cast("string")), F.lit("1 2"), F.concat(F.lit("dir"), "gene_id"), header="gene chr start end dir")


@query("SELECT 'g' || gene_id AS gene_id, chrom, 'dir' || gene_id AS folder FROM genes WHERE gene_id % 9 <> 0")
def protein_map_scan(t):
    return R.read_protein_map(spark_of(t), _proteins(t))[0].select("gene_id", "chrom", "folder")


@query("SELECT 'g' || gene_id AS gene_id, 'X' AS chrom FROM genes WHERE gene_id % 9 = 0")
def proteins_elsewhere(t):
    return R.read_protein_map(spark_of(t), _proteins(t))[1].select("gene_id", "chrom")


@query("SELECT snp AS rsid, round(ord % 13 / 100.0::DOUBLE, 6) AS beta, round(pow(10.0::DOUBLE, -(ord % 6)), 6) AS p FROM variants WHERE chrom BETWEEN 20 AND 26 AND chrom <> 23 AND ord % 6 >= 2")
def protein_results(t):
    at = folder(t, "pqtl")
    rows = variants(t).filter("chrom between 20 and 26")
    line = F.concat_ws(" ", "chrom", "pos", F.concat_ws(":", "chrom", "pos"), "a2", "a1", "af", F.lit("1 500 ADD"), F.col("ord") % 13 / 100, F.lit("0.1 3"), F.col("ord") % 6, F.lit("NA"))
    name = F.concat(F.lit("protein_chr"), "chrom", F.lit("_results.txt"))
    K.write_named(rows.select(name.alias("name"), "ord", line.alias("line")), at, "CHROM GENPOS ID ALLELE0 ALLELE1 A1FREQ INFO N TEST BETA SE CHISQ LOG10P EXTRA").count()
    ids = rows.select(F.concat_ws(":", "chrom", "pos").alias("id"), F.col("snp").alias("rsid"))
    return R.read_pqtl_folder(spark_of(t), at, ids, max_p=0.05).select("rsid", r6("beta").alias("beta"), r6("p").alias("p"))


def protein_folders(t) -> tuple[str, str, str]:
    """A folder a protein with a file of chromosome 23 and one of all others, and both maps; each ninth protein is on X."""
    at = folder(t, "proteins-of")
    rows = first_pairs(t).join(variants(t), "snp")
    line = F.concat_ws(" ", "chrom", "pos", F.concat_ws(":", "chrom", "pos"), "a2", "a1", F.format_string("%.4f", "af"), F.lit("1"), "n", F.lit("ADD"), F.format_string("%.6f", "beta"), F.format_string("%.6f", "se"), F.lit("3 2 NA"))
    name = F.concat(F.lit("dir"), F.substring("gene_id", 2, 18), F.lit("/p_chr"), F.when(F.col("chrom") == 23, 23).otherwise(1), F.lit("_r.txt"))
    named = rows.select(name.alias("name"), "ord", line.alias("line"))
    K.write_named(named, at, "CHROM GENPOS ID ALLELE0 ALLELE1 A1FREQ INFO N TEST BETA SE CHISQ LOG10P EXTRA").count()
    return at, _ids(t), _proteins(t)


_PROTEINS = _FIRST + f", m AS ({_IDS}), single AS (SELECT rsid FROM m GROUP BY rsid HAVING count(*) = 1)" + """
, kept AS (SELECT f.gene_id, f.snp, f.beta, f.se, f.n, v.chrom FROM first_pairs f JOIN variants v USING (snp) JOIN single ON rsid = snp
  WHERE v.chrom <> 23 AND CAST(substr(f.gene_id, 2) AS INTEGER) % 9 <> 0)
"""


@query(_PROTEINS + "SELECT gene_id, snp, round(beta, 5) AS beta, round(se, 5) AS se FROM kept")
def proteins_to_besd(t):
    """All proteins' folders to one BESD set."""
    at, ids, proteins = protein_folders(t)
    study, _ = P.load_proteins(spark_of(t), ids, proteins, root=at)
    path = folder(t, "besd") + "/proteins"
    P.export_study(study, "besd_file", path)
    return P.load_study(spark_of(t), "besd", path)["pairs"].select("gene_id", "snp", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"))


@query(_PROTEINS + """
SELECT 'genes' AS name, count(DISTINCT gene_id) AS n, round(sum(n) / count(*), 4) AS size FROM kept
UNION ALL SELECT 'elsewhere', count(*), 0 FROM genes WHERE gene_id % 9 = 0
UNION ALL SELECT 'repeated', count(*), 0 FROM m WHERE rsid NOT IN (SELECT rsid FROM single)
UNION ALL SELECT 'absent', count(*), 0 FROM genes WHERE gene_id % 9 <> 0 AND 'g' || gene_id NOT IN (SELECT gene_id FROM kept)
""")
def proteins_set_aside(t):
    """How many proteins and ids stay and go, and the mean size of all pairs."""
    at, ids, proteins = protein_folders(t)
    study, aside = P.load_proteins(spark_of(t), ids, proteins, root=at)
    kept = study["pairs"].agg(F.lit("genes").alias("name"), F.countDistinct("gene_id").alias("n"), F.round(F.sum("n") / F.count("*"), 4).alias("size"))
    rest = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(0.0).alias("size")) for name, rows in aside.items()]
    return kept.unionAll(rest[0]).unionAll(rest[1]).unionAll(rest[2])


def block_files(t) -> str:
    """snp.info files of single blocks, of variants by chromosome, each numbered from 0; the names sort otherwise than the numbers."""
    at = folder(t, "blocks")
    name = F.concat(F.lit("block"), "chrom", F.lit(".snp.info"))
    line = F.concat_ws(" ", "chrom", "snp", F.lit(0), "gen_pos", "pos", "a1", "a2", F.format_string("%.6f", "af"), F.lit(500), F.concat(F.lit("b"), "chrom"))
    K.write_named(variants(t).select(name.alias("name"), "ord", line.alias("line")), at, "Chrom ID Index GenPos PhysPos A1 A2 A1Freq N Block").count()
    return at


@query("""
SELECT chrom::VARCHAR AS block, (sum(count(*)) OVER (ORDER BY chrom) - count(*))::BIGINT AS start_idx, arg_min(snp, ord) AS start_snp, (sum(count(*)) OVER (ORDER BY chrom) - 1)::BIGINT AS end_idx,
  arg_max(snp, ord) AS end_snp, count(*) AS n_snps FROM variants GROUP BY chrom
""")
def merged_folder_blocks(t):
    """H3: blocks of a folder of single files."""
    return P.merge_block_folder(spark_of(t), block_files(t))[0].drop("chrom")


@query("SELECT snp, row_number() OVER (ORDER BY chrom, ord) - 1 AS idx, chrom::VARCHAR AS block, pos::INTEGER AS pos FROM variants")
def merged_folder_variants(t):
    """H3: their variants in the merged numbering."""
    return P.merge_block_folder(spark_of(t), block_files(t))[1].select("snp", "idx", "block", "pos")


@query("SELECT chrom::BIGINT AS block_number, snp, round(af, 2) AS af, CASE WHEN chrom % 4 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS b, ord * 1.0::DOUBLE AS n FROM variants")
def merged_summaries(t):
    """H4: each block's last file; every fourth block has a second one, whose effects differ."""
    at = folder(t, "parts")
    rows = variants(t).select("chrom", "snp", "a1", "a2", "af", "ord", F.lit("a").alias("part"), F.lit(1).alias("b"))
    rows = rows.unionAll(rows.filter("chrom % 4 = 0").withColumn("part", F.lit("b")).withColumn("b", F.lit(2)))
    name = F.concat(F.lit("all.block"), "chrom", F.lit("_"), "part", F.lit(".ma"))
    line = F.concat_ws(" ", "snp", "a1", "a2", F.format_string("%.6f", "af"), "b", F.lit("0.1 0.5"), "ord")
    K.write_named(rows.select(name.alias("name"), "ord", line.alias("line")), at, "SNP A1 A2 freq b se p N").count()
    return P.merge_block_summaries(spark_of(t), f"{at}/all").select("block_number", "snp", F.round("af", 2).alias("af"), "b", "n")


@query("SELECT 'rs' || p_partkey AS snp, p_size / 10.0::DOUBLE AS gen_pos FROM part WHERE p_size % 4 <> 0 AND p_partkey % 3 = 0")
def genetic_map_overlay(t):
    v = variants(t).filter("ord % 3 = 0")
    path = lines(variants(t), folder(t, "map"), "snp", "pos", F.when(F.col("chrom") % 4 == 0, "-999").otherwise((F.col("chrom") / 10).cast("string")))
    return R.overlay(v, R.read_table(spark_of(t), "genetic_map", path), "gen_pos", (0.0,)).select("snp", "gen_pos")


@query("SELECT snp, 0.25::DOUBLE AS af FROM variants WHERE ord % 5 <> 0")
def frequency_overlay(t):
    path = lines(variants(t), folder(t, "freq"), "snp", "a1", F.when(F.col("ord") % 5 == 0, "-1").otherwise("0.25"))
    return R.overlay(variants(t), R.read_table(spark_of(t), "frequencies", path), "af", (-1.0,)).select("snp", "af")


@query("SELECT snp, chrom / 2.0::DOUBLE AS ldsc FROM variants WHERE chrom % 3 <> 0")
def ld_score_overlay(t):
    path = lines(variants(t), folder(t, "ldsc"), "snp", F.when(F.col("chrom") % 3 == 0, 0.0).otherwise(F.col("chrom") / 2))
    return R.overlay(variants(t), R.read_table(spark_of(t), "ld_scores", path), "ldsc", (0.0,)).select("snp", "ldsc")


@query("SELECT dense_rank() OVER (ORDER BY chrom % 13) - 1 AS code, count(*) AS size, min(snp) AS first FROM variants GROUP BY chrom % 13")
def window_file_bins(t):
    path = lines(variants(t), folder(t, "win"), "snp", F.col("chrom") % 13, header="SNP win")
    return W.window_bins(R.overlay(variants(t), R.read_table(spark_of(t), "windows", path), "window"))


@query("SELECT block_id, chrom, start::INTEGER AS start, \"end\"::INTEGER AS \"end\" FROM blocks")
def block_list_scan(t):
    from .queries import blocks

    path = lines(blocks(t), folder(t, "blocks"), "block_id", "chrom", "start", "end", header="Block chrom start stop")
    return R.read_blocks(spark_of(t), path).select("block_id", "chrom", "start", "end")


_SIZED = """
, s AS (SELECT *, CASE WHEN line_order % 4 = 0 THEN 'N' ELSE substr('ACGT', CAST(CAST(substr(snp, 3) AS BIGINT) % 4 + 1 AS INTEGER), 1) END AS a1, substr('ACGT', CAST((CAST(substr(snp, 3) AS BIGINT) // 4) % 4 + 1 AS INTEGER), 1) AS a2 FROM pairs WHERE line = 1)
"""


@query(_SIZED + """
, k AS (SELECT s.snp, s.line_order, s.beta, CASE WHEN s.line_order % 6 = 1 THEN v.af ELSE round(v.af, 4) END AS af, s.n FROM s JOIN variants v ON v.snp = s.snp AND v.a1 = s.a1 AND v.a2 = s.a2)
SELECT count(*) AS rows, count(DISTINCT snp) AS snps, round(sum(beta), 4) AS beta, round(sum(n), 2) AS n FROM k WHERE af > 0
""")
def gwas_file(t):
    v = variants(t)
    number = F.substring("snp", 3, 18).cast("long")
    letter = F.lit("ACGT")
    a1 = F.when(F.col("line_order") % 4 == 0, "N").otherwise(F.substr(letter, (number % 4 + 1).cast("int"), F.lit(1)))
    a2 = F.substr(letter, (F.floor(number / 4) % 4 + 1).cast("int"), F.lit(1))
    rows = pairs(t).filter("line = 1").join(v.select("snp", "af"), "snp")
    af = F.when(F.col("line_order") % 6 == 1, "-999").otherwise(F.col("af").cast("string"))
    path = lines(rows, folder(t, "ma"), "snp", a1, a2, af, F.round("beta", 6), F.round("se", 6), F.lit("0.5"), "n", header="SNP A1 A2 freq b se p N")
    out = P.load_gwas(spark_of(t), path, v, max_af_diff=0.001)
    return out.agg(F.count("*").alias("rows"), F.countDistinct("snp").alias("snps"), F.round(F.sum("b"), 4).alias("beta"), F.round(F.sum("n"), 2).alias("n"))


@query(_FIRST + "SELECT gene_id, snp, coalesce(CASE WHEN snp LIKE '%7' THEN 1000 + length(snp) END, CASE WHEN gene_id LIKE '%3' THEN 77 END, n)::BIGINT AS n FROM first_pairs")
def gene_sizes_file(t):
    p = first_pairs(t)
    by_pair = p.filter("snp like '%7'").select(F.concat_ws(" ", "gene_id", "snp", F.length("snp") + 1000).alias("l"))
    by_gene = p.filter("gene_id like '%3'").select(F.concat_ws(" ", "gene_id", F.lit("77")).alias("l")).distinct()
    path = lines(by_pair.unionAll(by_gene), folder(t, "gsam"), "l", header="gene N")
    return R.with_gene_sizes(p, R.read_gene_sizes(spark_of(t), path)).select("gene_id", "snp", "n")


@query("SELECT snp, round(af, 4) AS af, round(ord % 10 / 100.0::DOUBLE, 4) AS effect, chrom FROM variants WHERE ord % 4 = 0")
def snp_results_file(t):
    v = variants(t)
    path = lines(v.filter("ord % 4 = 0"), folder(t, "res"), "ord", "snp", "chrom", "pos", "af", F.col("ord") % 10 / 100, F.lit("0.01 0.5"), F.col("ord") % 3, header="Id Name Chrom Position A1Frq A1Effect SE PIP Window")
    return R.read_snp_results(spark_of(t), path, variants=v).select("snp", F.round("af", 4).alias("af"), F.round("effect", 4).alias("effect"), "chrom")


@query("SELECT snp, round(ord % 3 / 10.0::DOUBLE, 4) AS pi FROM variants WHERE ord % 4 = 0")
def snp_results_mixture(t):
    path = lines(variants(t).filter("ord % 4 = 0"), folder(t, "res"), "ord", "snp", "chrom", "pos", "af", F.col("ord") % 10 / 100, F.lit("0.01 0.5"), F.col("ord") % 3 / 10, header="Id Name Chrom Position A1Frq A1Effect SE PIP PiS")
    return R.read_snp_results(spark_of(t), path, mixture=True).select("snp", F.round("pi", 4).alias("pi"))


@query("SELECT count(*) AS lines FROM lineitem")
def line_counts(t):
    path = folder(t, "counted")
    t("lineitem").select(F.concat_ws(" ", "l_orderkey", "l_linenumber").alias("value")).write.text(path, compression="gzip")
    return spark_of(t).range(1).select(F.lit(R.line_count(spark_of(t), path)).cast("long").alias("lines"))


# ---- pair sets


@query(_FIRST + "SELECT gene_id, snp, round(beta, 5) AS beta, round(se, 5) AS se FROM first_pairs")
def besd_round_trip(t):
    listed = P.export_study(study(t), "besd", folder(t, "besd"), parts=3)
    pairs = P.merge_study_files(spark_of(t), [r.name for r in listed.collect()])["pairs"]
    return pairs.select("gene_id", "snp", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"))


@query(_FIRST + "SELECT gene_id, snp, round(beta, 5) AS beta, round(se, 5) AS se FROM first_pairs")
def besd_one_file(t):
    """B1: one set of all genes, written by many tasks."""
    path = folder(t, "besd") + "/all"
    P.export_study(study(t), "besd_file", path)
    return P.load_study(spark_of(t), "besd", path)["pairs"].select("gene_id", "snp", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"))


@query(_FIRST + "SELECT f.gene_id, g.chrom, count(*) AS pairs, round(sum(beta), 3) AS beta FROM first_pairs f JOIN genes g ON f.gene_id = 'g' || g.gene_id GROUP BY ALL")
def besd_source(t):
    """The source by itself. Effects are stored in single precision; their six digits come back before they are summed, as what
    is lost would decide sums that lie half-way."""
    path = folder(t, "besd") + "/all"
    P.export_study(study(t), "besd_file", path)
    register(spark_of(t))
    beta = r6("beta")
    # multiples of 2^-30 and what is left of each value: neither sum is rounded, so that the order of rows does not matter
    coarse = F.rint(beta * 2.0**30) / 2.0**30
    total = F.sum(coarse) + F.sum(beta - coarse)
    return spark_of(t).read.format("locus_besd").load(path).groupBy("gene_id", "chrom").agg(F.count("*").alias("pairs"), F.round(total, 3).alias("beta"))


#: Every third variant swapped in the reference, every seventh with another allele.
_SWAPPED = """
, seen AS (SELECT snp, ord % 3 = 0 AND a1 <> a2 AS flipped FROM variants WHERE ord % 7 <> 0)
"""


def swapped(t) -> DataFrame:
    turn, other = F.col("ord") % 3 == 0, F.col("ord") % 7 == 0
    return variants(t).select("snp", F.when(other, "N").when(turn, F.col("a2")).otherwise(F.col("a1")).alias("a1"), F.when(turn & ~other, F.col("a1")).otherwise(F.col("a2")).alias("a2"))


@query(_FIRST + _SWAPPED + "SELECT gene_id, snp, round(beta, 5) AS beta, flipped FROM first_pairs JOIN seen USING (snp)")
def besd_alleles(t):
    """Same, swapped and foreign alleles of BESD sets."""
    listed = P.export_study(study(t), "besd", folder(t, "besd"), parts=2)
    sets, _ = P.load_sets(spark_of(t), [r.name for r in listed.collect()], swapped(t))
    return sets["pairs"].select("gene_id", "snp", F.round("beta", 5).alias("beta"), "flipped")


@query(_FIRST + _SWAPPED + "SELECT gene_id, snp, round(beta, 5) AS beta, flipped FROM first_pairs JOIN seen USING (snp)")
def query_alleles(t):
    """Same, swapped and foreign alleles of a pair table."""
    at = folder(t, "query")
    P.export_study(study(t), "query", at)
    return P.load_study(spark_of(t), "query", at, reference=swapped(t))["pairs"].select("gene_id", "snp", F.round("beta", 5).alias("beta"), "flipped")


@query(_FIRST + "SELECT count(DISTINCT gene_id) AS genes, count(DISTINCT snp) AS snps, 1 AS failed FROM first_pairs")
def besd_sets_softly(t):
    listed = P.export_study(study(t), "besd", folder(t, "besd"), parts=2)
    sets, failed = P.load_studies(spark_of(t), [*[r.name for r in listed.collect()], folder(t, "absent") + "/none"])
    merged = H.merge_studies(sets)
    return merged["pairs"].agg(F.countDistinct("gene_id").alias("genes"), F.countDistinct("snp").alias("snps"), F.lit(len(failed)).alias("failed"))


@query(_FIRST + "SELECT gene_id, snp, round(beta, 5) AS beta, round(se, 5) AS se, n FROM first_pairs")
def query_round_trip(t):
    at = folder(t, "query")
    P.export_study(study(t), "query", at)
    return P.load_study(spark_of(t), "query", at)["pairs"].select("gene_id", "snp", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), "n")


@query(_FIRST + """
, m AS (SELECT gene_id, floor(avg(n)) AS n_mean, count(*) > 1 AS has_pairs FROM first_pairs GROUP BY gene_id)
SELECT gene_id, n_mean::BIGINT AS n_mean, round(sqrt(avg((n - n_mean) * (n - n_mean))), 5) AS n_sd, has_pairs FROM first_pairs JOIN m USING (gene_id) GROUP BY gene_id, n_mean, has_pairs
""")
def query_genes(t):
    at = folder(t, "query")
    P.export_study(study(t), "query", at)
    return P.load_study(spark_of(t), "query", at)["genes"].select("gene_id", "n_mean", F.round("n_sd", 5).alias("n_sd"), "has_pairs")


@query(_FIRST + "SELECT gene_id, count(*) AS pairs FROM first_pairs WHERE (beta / se) * (beta / se) > 6.634896601021214 GROUP BY gene_id HAVING count(*) >= 2")
def selected_study(t):
    out = P.select_study(study(t), max_p=0.01)
    return out["pairs"].join(out["genes"].select("gene_id"), "gene_id").groupBy("gene_id").agg(F.count("*").alias("pairs"))


@query(_FIRST + ", g AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS ord FROM (SELECT DISTINCT gene_id FROM first_pairs)) SELECT ord // 7 AS chunk, ord, ord || '-' || gene_id || '.ma' AS file FROM g")
def ma_manifests(t):
    return P.export_study(study(t), "ma", folder(t, "ma"), array_limit=7)


@query(_FIRST + "SELECT f.snp, round(beta, 6) AS b, round(se, 6) AS se, n::DOUBLE AS n, a1 FROM first_pairs f JOIN variants USING (snp)")
def ma_files(t):
    at = folder(t, "ma")
    P.export_study(study(t), "ma", at, array_limit=7)
    return R.read_table(spark_of(t), "ma", f"{at}/*.ma").select("snp", r6("b").alias("b"), r6("se").alias("se"), "n", "a1")


@query(_FIRST + "SELECT gene_id, snp, round(beta / se + 1e-7, 4) AS z FROM first_pairs")
def sumstats_file(t):
    at = folder(t, "sumstats")
    P.export_study(study(t), "sumstats", at)
    rows = spark_of(t).read.csv(at, sep="\t", header=True)
    return rows.select(F.col("GENE").alias("gene_id"), F.col("SNP").alias("snp"), F.round(F.col("Z").cast("double") + 1e-7, 4).alias("z"))


@query(_FIRST + """
, g AS (SELECT list(DISTINCT gene_id ORDER BY gene_id) AS names FROM first_pairs)
SELECT snp, count(*) AS own, (SELECT len(names) FROM g) + 2 AS columns FROM first_pairs GROUP BY snp UNION ALL SELECT 'SNP', len(names), len(names) + 2 FROM g
""")
def annotation_file(t):
    at = folder(t, "annotation")
    P.export_study(study(t), "annotation", at, binary=True, gzip=True)
    first = F.substring_index("value", "\t", 2)
    cells = F.concat(F.substr("value", F.length(first) + 1), F.lit("\t"))
    rows = spark_of(t).read.text(at).select(F.substring_index("value", "\t", 1).alias("snp"), cells.alias("all"))
    # counted without an array of all cells: runs of zeros go, and each cell that is left gets tabs of its own
    rows = rows.withColumn("left", F.replace("all", F.lit("\t" + "0\t" * 64), F.lit("\t")))
    rows = rows.withColumn("apart", F.replace("left", F.lit("\t"), F.lit("\t\t")))
    gone = (F.octet_length("all") - F.octet_length("left")) / 2
    kept = F.octet_length("apart") - F.octet_length("left") - 1
    zeros = (F.octet_length("apart") - F.octet_length(F.replace("apart", F.lit("\t0\t")))) / 3
    return rows.select("snp", (kept - zeros).cast("long").alias("own"), (gone + kept + 2).cast("long").alias("columns"))


@query("SELECT snp AS \"SNP\", 1 AS \"Intercept\", CAST(snp IN (SELECT snp FROM pairs WHERE n > 49) AS INTEGER) AS member FROM variants")
def annotation_members_of_reference(t):
    return K.annotation_membership(pairs(t).filter("n > 49"), variants(t))


# ---- genotypes


_DOSE = "CASE WHEN x > 0.22 THEN NULL WHEN x < -0.08 THEN 0 WHEN x < 0.05 THEN 1 ELSE 2 END"
_DOSES = f"""
, d AS (SELECT vec_id AS idx, 'v' || vec_id AS snp, list_transform(embedding::DOUBLE[], lambda x: {_DOSE}) AS dosage FROM embeddings),
k AS (SELECT *, list_filter(dosage, lambda x: x IS NOT NULL) AS known FROM d)
"""


def doses(t) -> DataFrame:
    cut = F.transform("dosage", lambda x: F.when(x.cast("double") > 0.22, None).when(x.cast("double") < -0.08, 0).when(x.cast("double") < 0.05, 1).otherwise(2))
    rows = genotypes(t).select("idx", "snp", "region", cut.alias("dosage"))
    return rows.withColumns({"chrom": F.lit(1), "pos": F.col("idx") * 100, "gen_pos": F.col("idx") / 100, "a1": F.lit("A"), "a2": F.lit("G")})


def bed(t, parts: int = 3) -> list[str]:
    people = spark_of(t).range(64).select(F.concat(F.lit("f"), "id").alias("fid"), F.concat(F.lit("i"), "id").alias("iid"), F.col("id").alias("ord"))
    return [r.name for r in K.write_bed(doses(t), people, folder(t, "bed"), parts).collect()]


def read_back(t, names: list[str], **chosen) -> DataFrame:
    return H.stack([P.load_genotypes(spark_of(t), n, **chosen) for n in names])


@query(_DOSES + "SELECT snp, len(known) AS known, round(list_avg(known) / 2, 6) AS af, round(list_sum(list_transform(known, lambda x: pow(x - list_avg(known), 2))) / (2 * list_avg(known) / 2 * (1 - list_avg(known) / 2)), 5) AS sum_squares FROM k WHERE list_avg(known) BETWEEN 0.00001 AND 1.99999")
def bed_round_trip(t):
    rows = B.genotype_stats(read_back(t, bed(t))).filter("af > 0.000005 and af < 0.999995")
    return rows.select("snp", F.size(F.array_compact("dosage")).cast("long").alias("known"), r6("af").alias("af"), F.round("sum_squares", 5).alias("sum_squares"))


@query(_DOSES + """
, m AS (SELECT snp, dosage, list_avg(known) AS mean FROM k WHERE list_avg(known) BETWEEN 0.00001 AND 1.99999)
SELECT snp, round(list_sum(list_transform(range(1, 65), lambda i: pow(coalesce(dosage[i], mean) - mean, 2) / (mean * (1 - mean / 2)) / i)), 5) AS sum_squares FROM m
""")
def weighted_genotypes(t):
    """A3: genotypes weighted by residual variances, the i-th person's being i."""
    rows = read_back(t, bed(t))
    people = spark_of(t).range(64).select(F.col("id").alias("idx"), (1 / F.sqrt(F.col("id") + 1)).alias("root_weight"))
    out = P.weighted_genotypes(rows, people).filter("af > 0.000005 and af < 0.999995")
    return out.select("snp", F.round("sum_squares", 5).alias("sum_squares"))


@query(_DOSES + "SELECT snp, len(known) AS known, list_sum(known)::BIGINT AS total FROM k")
def bed_source(t):
    """A3: the source by itself."""
    register(spark_of(t))
    known = F.array_compact("dosage")
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x))
    return H.stack([spark_of(t).read.format("locus_bed").load(n) for n in bed(t)]).select("snp", F.size(known).cast("long").alias("known"), total.alias("total"))


@query(_DOSES + "SELECT snp, list_sum(list_filter(dosage[1:10], lambda x: x IS NOT NULL))::BIGINT AS total FROM k WHERE idx % 3 <> 0")
def bed_kept_people(t):
    keep = spark_of(t).range(10).select(F.concat(F.lit("f"), "id").alias("fid"), F.concat(F.lit("i"), "id").alias("iid"))
    exclude = genotypes(t).filter("idx % 3 = 0").select("snp")
    rows = read_back(t, bed(t), keep=keep, exclude=exclude)
    return rows.select("snp", F.when(F.size(F.array_compact("dosage")) > 0, F.aggregate(F.array_compact("dosage"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query(_DOSES + "SELECT snp FROM k WHERE idx % 2 = 0 AND list_max(known) <> list_min(known)")
def cis_genotypes(t):
    listed = genotypes(t).filter("idx % 2 = 0").select("snp")
    return B.cis_genotypes(doses(t), listed).select("snp")


@query(_DOSES + "SELECT snp FROM k WHERE list_max(known[1:3]) > list_min(known[1:3])")
def varying_genotypes(t):
    few = doses(t).withColumn("dosage", F.slice(F.array_compact("dosage"), 1, 3))
    return C.drop_constant(few).select("snp")


# ---- correlation sets


_BANDED = ", p AS (SELECT a.idx AS i, b.idx AS j, list_dot_product(a.g, b.g) AS r FROM z a JOIN z b ON b.idx BETWEEN a.idx - 6 AND a.idx + 6)"


def described(t) -> DataFrame:
    return genotypes(t).select("idx", "snp", F.lit(1).alias("chrom"), (F.col("idx") / 100).alias("gen_pos"), (F.col("idx") * 100).alias("pos"), F.lit("A").alias("a1"), F.lit("G").alias("a2"), F.lit(0.3).alias("af"))


def banded(t) -> DataFrame:
    return L.mirrored(L.ld_pairs(genotypes(t), tile=64, band=6))


def ld_set(t, kind: str, parts: int) -> list[str]:
    rows = banded(t) if kind == "full" else L.sparse(banded(t), 64, least_r=0.2)
    return [r.name for r in K.write_ld(rows, described(t), 64, folder(t, "ld"), kind, parts).orderBy("part").collect()]


@query(_BANDED + "SELECT i, j, round(r, 6) AS r FROM p")
def ld_set_round_trip(t):
    return B.read_ld_set(spark_of(t), ld_set(t, "full", 1))[1].select("i", "j", r6("r").alias("r"))


@query(_BANDED + "SELECT i, j, round(r, 6) AS r FROM p WHERE i = j OR abs(r) >= 0.2")
def ld_shards_round_trip(t):
    names = ld_set(t, "sparse", 4)
    listed = spark_of(t).createDataFrame([(k, n) for k, n in enumerate(names)], "part int, name string")
    path = folder(t, "list") + ".mldm"
    K.write_list(listed, path)
    return P.load_ld(spark_of(t), path)[1].select("i", "j", r6("r").alias("r"))


@query(_BANDED + """
, q AS (SELECT i // 2 AS i, j // 2 AS j, r FROM p WHERE i % 2 = 0 AND j % 2 = 0)
SELECT i AS idx, count(*) AS window_size, min(j) AS window_start, max(j) AS window_end, round(sum(r), 5) AS ld_sum, round(sum(r * r), 5) AS ldsc, round(sum(pow(1 - r * r, 2) / 64), 5) AS sampling_var FROM q GROUP BY i
""")
def ld_set_subset(t):
    keep = genotypes(t).filter("idx % 2 = 0").select("snp")
    info, _ = B.read_ld_set(spark_of(t), ld_set(t, "full", 3), keep=keep)
    return info.select("idx", "window_size", "window_start", "window_end", *[F.round(c, 5).alias(c) for c in ("ld_sum", "ldsc", "sampling_var")])


@query(_BANDED + """
, h AS (SELECT 1 / (ln(365) + 0.5772156649015329 + 1 / (2 * 365.0) - 1 / (12 * 365.0 ^ 2) + 1 / (120 * 365.0 ^ 4)) AS x), c AS (SELECT x / (366 + x) AS theta FROM h)
SELECT i, j, round((r * 0.42 * exp(-4 * 100 * abs(i - j) / 100.0 / 100 / 366) * pow(1 - theta, 2) + CASE WHEN i = j THEN 0.5 * theta * (1 - 0.5 * theta) ELSE 0 END) / (0.42 * pow(1 - theta, 2) + 0.5 * theta * (1 - 0.5 * theta)), 6) AS r FROM p, c
""")
def ld_set_shrunk(t):
    moved = described(t).select("snp", (F.col("idx") / 100).alias("gen_pos"))
    return P.load_ld(spark_of(t), ld_set(t, "full", 2), shrink=moved, ne=100)[1].select("i", "j", r6("r").alias("r"))


@query("SELECT snp, CASE WHEN ord % 4 = 0 THEN NULL ELSE 0.25::DOUBLE END AS af, ord AS idx, 9::BIGINT AS window_size, CASE WHEN ord % 4 >= 2 THEN 1.5::DOUBLE END AS ld_sum, CASE WHEN ord % 4 = 3 THEN 1 END AS skeleton FROM variants")
def ld_info_layouts(t):
    place, rest = F.concat_ws(" ", "chrom", "snp", "gen_pos", "pos", "a1", "a2"), F.concat_ws(" ", "ord", F.lit("3 11 9 800 64"))
    layout = F.col("ord") % 4
    line = F.when(layout == 0, F.concat_ws(" ", place, rest)).when(layout == 1, F.concat_ws(" ", place, F.lit("0.25"), rest, F.lit("0.1")))
    line = line.when(layout == 2, F.concat_ws(" ", place, F.lit("0.25"), rest, F.lit("0.1 1.5"))).otherwise(F.concat_ws(" ", place, F.lit("0.25"), rest, F.lit("0.1 1.5 1")))
    path = lines(variants(t), folder(t, "info"), line)
    return R.read_ld_info(spark_of(t), path).select("snp", "af", "idx", "window_size", "ld_sum", "skeleton")


@query(_BANDED + "SELECT 'v' || i AS snp, count(*) AS window_size, round(sum(r), 6) AS ld_sum FROM p GROUP BY i")
def ld_info_on_variants(t):
    info = R.read_ld_info(spark_of(t), *[n + ".info" for n in ld_set(t, "full", 2)])
    return R.with_ld_info(described(t), info).select("snp", "window_size", r6("ld_sum").alias("ld_sum"))


@query("SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.g, b.g), 6) AS r FROM z a JOIN z b ON a.idx < 40 AND b.idx < 40")
def ld_text_matrix(t):
    rows = L.dense_rows(L.mirrored(L.ld_pairs(genotypes(t).filter("idx < 40"))))
    path = one_file(rows, folder(t, "ldtxt"), "matrix.full.txt", "i", F.array_join(F.transform("values", lambda x: F.format_string("%.12f", x)), " "))
    return B.read_ld_text(spark_of(t), path).select("i", "j", r6("r").alias("r"))


@query(_BANDED + "SELECT i + 1 AS i, 'v' || i AS id_i, j + 1 AS j, 'v' || j AS id_j, round(r, 6) AS r FROM p")
def ld_as_text(t):
    return K.ld_text(banded(t), described(t)).withColumn("r", r6("r"))


@query("SELECT round(avg(k), 6) AS mean_size, round(stddev_samp(k), 6) AS sd_size FROM (SELECT count(*) AS k FROM z a JOIN z b ON b.idx BETWEEN a.idx - 6 AND a.idx + 6 GROUP BY a.idx)")
def window_sizes(t):
    sizes = banded(t).groupBy("i").agg(F.count("*").alias("size"))
    return A.window_size_summary(sizes).select(r6("mean_size").alias("mean_size"), r6("sd_size").alias("sd_size"))


@query("""
, v AS (SELECT *, row_number() OVER (ORDER BY chrom, pos) - 1 AS idx FROM variants WHERE ord % 3 <> 0)
SELECT snp, min(idx) OVER w AS window_start, count(*) OVER w AS window_size FROM v WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 199999 PRECEDING AND 199999 FOLLOWING)
""")
def resized_windows(t):
    first = W.window_info(C.reindex(variants(t), "chrom", "pos"), 400_000)
    left = C.reindex(first.filter("ord % 3 <> 0").drop("idx", "window_start", "window_size", "window_end"), "chrom", "pos")
    return W.window_info(left, 400_000).select("snp", "window_start", "window_size")


# ---- eigen sets


_PAIRS_OF_TWO = """
, two AS (SELECT a.idx // 2 AS region, a.idx AS i, list_dot_product(a.g, b.g) AS r, 63 / 64.0::DOUBLE AS c FROM z a JOIN z b ON a.idx % 2 = 0 AND b.idx = a.idx + 1)
"""
_TOP = _PAIRS_OF_TWO + "SELECT region::VARCHAR AS region, 2 AS m, 2 AS k, round(c + abs(r), 4) AS top, 'v' || i AS first FROM two"


def members(t) -> DataFrame:
    return two(t).select("region", F.lit(1).alias("chrom"), (F.col("region") * 200).alias("start"), (F.col("region") * 200 + 100).alias("end"), F.lit(0.5).alias("window"), "snp", "idx", F.col("region").alias("block"))


def rounded(eigen: DataFrame) -> DataFrame:
    return eigen.select(F.col("region").cast("string").alias("region"), "m", "k", F.round(F.element_at("values", -1), 4).alias("top"), F.element_at("snps", 1).alias("first"))


def eigen_sets(t, kind: str, parts: int) -> list[str]:
    e = L.region_eigen(two(t), 0.9999999)
    return [r.name for r in K.write_eigen_set(e, members(t), described(t), 64, folder(t, "eigen"), kind, parts).collect()]


@query(_TOP)
def eigen_set_round_trip(t):
    return rounded(P.load_eigen(spark_of(t), eigen_sets(t, "ldblock", 3), 1.0)[0])


@query(_PAIRS_OF_TWO + "SELECT region::VARCHAR AS region, 2 AS m, CASE WHEN (c + abs(r)) / (2 * c) > 0.55 THEN 1 ELSE 2 END AS k, round(c + abs(r), 4) AS top, 'v' || i AS first FROM two WHERE region % 5 <> 0")
def eigen_gene_set(t):
    reference = described(t).filter("idx % 10 <> 1").withColumn("a1", F.when(F.col("idx") % 4 == 0, "G").otherwise("A")).withColumn("a2", F.when(F.col("idx") % 4 == 0, "A").otherwise("G"))
    return rounded(P.load_eigen(spark_of(t), eigen_sets(t, "gene", 3), 0.55, "gene", reference)[0])


@query("SELECT 'v' || idx AS snp, (idx % 4 = 0) AS flipped FROM z WHERE idx % 10 <> 1")
def eigen_gene_variants(t):
    reference = described(t).filter("idx % 10 <> 1").withColumn("a1", F.when(F.col("idx") % 4 == 0, "G").otherwise("A")).withColumn("a2", F.when(F.col("idx") % 4 == 0, "A").otherwise("G"))
    return R.read_eigen_info(spark_of(t), eigen_sets(t, "gene", 2), "gene", reference)[1].select("snp", "flipped")


@query(_PAIRS_OF_TWO + "SELECT region::VARCHAR AS region, 2 AS m, 2 AS k, round(c + abs(r), 4) AS top, 'v' || i AS first FROM two WHERE region % 3 <> 1")
def eigen_sets_merged(t):
    """Two sets that share regions, and one that is not there, written again without the shared ones and read."""
    e = L.region_eigen(two(t), 0.9999999)
    parts = [e.filter("region % 3 <> 2"), e.filter("region % 3 <> 0")]
    names = [r.name for rows in parts for r in K.write_eigen_set(rows, members(t), described(t), 64, folder(t, "eigen"), "gene").collect()]
    listed, failed = P.merge_eigen_sets(spark_of(t), [*names, folder(t, "none") + "/none"], folder(t, "merged"), cutoff=1.0)
    if len(failed) != 1:
        raise ValueError(f"{failed}")
    return rounded(P.load_eigen(spark_of(t), [r.name for r in listed.collect()], 1.0, "gene")[0])


@query("SELECT idx // 64 AS region, count(*)::INTEGER AS m FROM z WHERE idx // 64 % 2 = 1 GROUP BY 1 HAVING count(*) > 8")
def gene_eigen_of_reference(t):
    """Genes of which at most three tenths of the variants are missing; every other gene lacks half."""
    g = genotypes(t)
    e = L.region_eigen(g.join(g.groupBy("region").count().filter("count > 8").select("region"), "region"), 0.9999)
    about = g.select("region", F.lit(1).alias("chrom"), (F.col("region") * 6400).alias("start"), (F.col("region") * 6400 + 6300).alias("end"), F.lit(0.5).alias("window")).distinct()
    names = [r.name for r in K.write_eigen_set(e, about, described(t), 64, folder(t, "eigen"), "gene", 2).collect()]
    lacking = "(floor(idx / 64) % 2 = 0 and idx % 2 = 1) or idx % 8 = 1"
    rows = P.load_gene_eigen(spark_of(t), names, described(t).filter(f"not ({lacking})").select("snp", "pos", "a1", "a2"))[0]
    return rows.select(F.col("region").cast("long").alias("region"), "m")


def block_folder(t, from_ld: bool) -> str:
    """A folder of blocks: eigen files, or matrices and the eigen files made from them."""
    at = folder(t, "blockdir")
    rows = members(t).join(described(t).drop("idx", "chrom"), "snp")
    info, snps = K.block_folder_info(rows, 64)
    if from_ld:
        K.write_block_ld(L.region_ld(two(t)), members(t), at).count()
        listed = members(t).select(F.col("region").cast("string").alias("region"), "snp", F.col("idx").alias("ord"))
        K.write_eigen(B.read_block_ld(spark_of(t), at, listed, 0.9999999), at).count()
    else:
        K.write_eigen(L.region_eigen(two(t), 0.9999999), at).count()
    one_file(info, at, "ldm.info", "Block", *info.columns, header=" ".join(info.columns))
    one_file(snps, at, "snp.info", "Index", *snps.columns, header=" ".join(snps.columns))
    return at


@query(_TOP)
def block_folder_round_trip(t):
    return rounded(P.load_eigen(spark_of(t), block_folder(t, False), 1.0)[0])


@query(_TOP)
def block_ld_to_eigen(t):
    return rounded(P.load_eigen(spark_of(t), block_folder(t, True), 1.0)[0])


@query("SELECT block::VARCHAR AS block, min(idx) AS start_idx, arg_min(snp, idx) AS start_snp, max(idx) AS end_idx, count(*) AS n_snps FROM (SELECT idx, idx // 2 AS block, 'v' || idx AS snp FROM z) GROUP BY block")
def block_folder_blocks(t):
    return R.read_block_folder_info(spark_of(t), block_folder(t, False))[0].select("block", "start_idx", "start_snp", "end_idx", "n_snps")


@query("SELECT idx // 64 AS region, count(*)::INTEGER AS m, round(count(*) * 63 / 64.0::DOUBLE + 0.00001, 4) AS sum_pos FROM z WHERE idx % 3 = 0 GROUP BY 1")
def gene_eigen_from_pairs(t):
    wanted = genotypes(t).filter("idx % 3 = 0").select("snp", F.col("region").alias("gene_id"))
    out = P.build_gene_eigen(genotypes(t).drop("region"), wanted)
    return out.select("region", "m", F.round(F.col("sum_pos") + 0.00001, 4).alias("sum_pos"))


@query("SELECT block_id, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n_snps FROM (SELECT ord AS idx, 'b' || brand AS block_id FROM variants) WHERE block_id <> 'bBrand#13' GROUP BY block_id")
def matched_blocks(t):
    v = variants(t).select(F.col("ord").alias("idx"), "snp", F.concat(F.lit("b"), "brand").alias("block_id"))
    known = v.filter("block_id <> 'bBrand#13'").select("block_id").distinct()
    empty = known.limit(1).select(F.lit("nobody").alias("block_id"))
    return C.include_matched_blocks(v, known.unionAll(empty))[1].select("block_id", "start_idx", "end_idx", "n_snps")


@query("SELECT snp FROM variants WHERE brand = 'Brand#22'")
def block_by_name(t):
    v = variants(t).withColumnRenamed("brand", "block_id")
    named = v.select("block_id").distinct().withColumn("ord", F.when(F.col("block_id") == "Brand#22", 6).otherwise(0))
    spans = named.select("ord", "block_id", F.lit(1).alias("chrom"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    return C.include_block(v, spans, 7).select("snp")


@query("SELECT snp, pos FROM variants WHERE brand = 'Brand#22'")
def one_block_id(t):
    return C.include_one(variants(t), "brand", "Brand#22").select("snp", "pos")


@query("SELECT c_custkey AS iid FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey LIMIT 40")
def first_people(t):
    people = t("customer").select(F.lit("f").alias("fid"), F.col("c_custkey").alias("iid"), F.col("c_custkey").alias("ord"))
    had = t("orders").select(F.lit("f").alias("fid"), F.col("o_custkey").alias("iid"))
    return C.keep_individuals(people, had, most=40).select("iid")


@query("SELECT snp FROM variants ORDER BY ord LIMIT 25")
def first_listed(t):
    return W.first_rows(variants(t), 25).select("snp")


@query("SELECT count(*) AS n, true AS moved, true AS again, true AS seeded FROM variants")
def shuffled_variants(t):
    """Nearly all rows elsewhere than before, at the same place each time, and at another one by another seed."""
    v = variants(t).select("snp", "ord")

    def places(rows: DataFrame, seed: int, name: str) -> DataFrame:
        key = F.xxhash64(F.lit(seed), *rows.columns)
        # the order of shuffled, as a column
        return C.reindex(W.shuffled(rows, seed).withColumn("key", key), "key", *rows.columns, name=name).drop("key")

    both = places(v, 2023, "one").join(places(v.repartition(3), 2023, "two"), ["snp", "ord"]).join(places(v, 1, "other"), ["snp", "ord"])
    same = F.avg((F.col("one") == F.col("other")).cast("int"))
    return both.agg(F.count("*").alias("n"), (F.avg((F.col("one") + 1 != F.col("ord")).cast("int")) > 0.9).alias("moved"), F.every(F.col("one") == F.col("two")).alias("again"), (same < 0.1).alias("seeded"))


# ---- scalars, projections, samples


@query("""
SELECT p_partkey AS part, array_to_string(list_filter(string_split(replace(replace(p_name, ',', ' '), chr(9), ' '), ' '), lambda x: x <> ''), '|') AS words, p_brand || '.' || p_size AS stem, 'gz' AS suffix, p_size % 3 = 0 AS missing,
  CASE WHEN p_size % 5 = 0 THEN 23 WHEN p_size % 5 = 1 THEN 24 WHEN p_size = 7 THEN NULL ELSE p_size END AS chrom FROM part
""")
def text_functions(t):
    path = F.concat(F.lit("/a/b/"), "p_brand", F.lit("."), "p_size", F.lit(".gz"))
    code = F.when(F.col("p_size") % 5 == 0, "x").when(F.col("p_size") % 5 == 1, "Y").when(F.col("p_size") == 7, "0").otherwise(F.col("p_size").cast("string"))
    absent = S.is_missing(F.when(F.col("p_size") % 3 != 0, "1").when(F.col("p_size") % 2 == 0, "na"))
    return t("part").select(F.col("p_partkey").alias("part"), F.array_join(S.tokens(F.col("p_name")), "|").alias("words"), S.file_stem(path).alias("stem"), S.file_suffix(path).alias("suffix"), absent.alias("missing"), S.chromosome(code).alias("chrom"))


@query("SELECT ord, chrom, 'f' || ord || ':' || snp AS person, chrom IN (1, 11) AND ord % 2 = 0 OR chrom = 1 AND ord % 2 = 1 AS named, round(pow(10.0::DOUBLE, -(ord % 5)), 8) AS p, round(pow(10.0::DOUBLE, ord % 5), 8) AS up FROM variants")
def id_functions(t):
    v = variants(t)
    own = S.of_chromosome_file(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("x_chr"), "chrom", F.lit("_y"))).otherwise(F.lit("x_chr1_y")), F.when(F.col("ord") % 2 == 0, F.when(F.col("chrom").isin(1, 11), F.col("chrom")).otherwise(0)).otherwise(F.col("chrom")))
    log = (F.col("ord") % 5).cast("double")
    return v.select(
        "ord", S.chromosome_of_id(F.concat_ws(":", "chrom", "pos", "a1")).alias("chrom"), S.person_id(F.concat(F.lit("f"), "ord"), F.col("snp")).alias("person"), own.alias("named"),
        F.round(S.p_from_log10(log), 8).alias("p"), F.round(S.p_from_log10(log, False), 8).alias("up"),
    )


@query("SELECT ord, chrom > 9 OR chrom % 3 <> 0 AS whole, true AS digits, pos::DOUBLE AS named, abs(pos - 500000) < 90000 AS near FROM variants")
def predicates(t):
    written = F.when((F.col("chrom") <= 9) & (F.col("chrom") % 3 == 0), F.concat(F.lit("0"), "chrom")).otherwise(F.col("chrom").cast("string"))
    names, values = F.array(F.lit("chrom"), F.lit("pos")), F.array(F.col("chrom").cast("double"), F.col("pos").cast("double"))
    near = C.is_proximal(F.col("chrom"), F.col("pos"), F.col("chrom"), F.lit(500_000), 90_000)
    return variants(t).select("ord", S.positive_integer(written).alias("whole"), S.is_number(written).alias("digits"), S.named_value(names, values, "pos").alias("named"), near.alias("near"))


@query("SELECT gene_id, snp, line_order, line, round(1 / sqrt(n * se * se + beta * beta) * se, 6) AS se_scaled, round(n * (n * se * se + beta * beta) + 3e-9, 6) AS tss, round(n * beta + 3e-9, 6) AS zy FROM pairs")
def scaled_effects(t):
    out = S.scaled_effects(F.col("beta"), F.col("se"), F.col("n"))
    return pairs(t).select("gene_id", "snp", "line_order", "line", r6(out["se_scaled"]).alias("se_scaled"), *[r6(out[c] + 3e-9).alias(c) for c in ("tss", "zy")])


@query("SELECT snp, round((ord % 97 + 1) / 99.0::DOUBLE, 7) AS p, round((ord % 97 + 1) / 99.0::DOUBLE, 7) AS lower, round(1 - abs(1 - 2 * (ord % 97 + 1) / 99.0::DOUBLE), 7) AS two_sided FROM variants")
def normal_functions(t):
    p = (F.col("ord") % 97 + 1) / 99
    z = S.normal_quantile(p)
    # the lower tail at the square of |beta| / se is the p that se was made from
    ratio = 0.3 / S.se_from_p(F.lit(-0.3), p)
    back = 1 - S.chi2_tail(ratio * ratio)
    return variants(t).select("snp", F.round(S.normal_cdf(z), 7).alias("p"), F.round(back, 7).alias("lower"), F.round(S.p_from_z(z), 7).alias("two_sided"))


@query("SELECT snp, round(2 * af * (1 - af), 6) AS het, round(least(af, 1 - af), 6) AS maf FROM variants")
def frequencies(t):
    return variants(t).select("snp", r6(S.heterozygosity(F.col("af"))).alias("het"), r6(S.minor_frequency(F.col("af"))).alias("maf"))


@query("""
, m AS (SELECT gene_id, 100 * var_pop(beta) AS a, 120 * covar_pop(beta, n) AS b, var_pop(n) / 40 AS d FROM pairs GROUP BY gene_id),
e AS (SELECT *, (a + d) / 2 AS mid, sqrt(pow(a - d, 2) / 4 + b * b) AS half FROM m),
l AS (SELECT *, CASE WHEN mid + half > 0 THEN mid + half ELSE 1e-6 END AS high, CASE WHEN mid - half > 0 THEN mid - half ELSE 1e-6 END AS low FROM e)
SELECT gene_id, true AS symmetric, a > 0 AND a * d - b * b > 0 AS definite, round(high, 5) AS trace_high, round(low, 5) AS low, round((high + low) / 2 + (high - low) * (a - d) / (4 * half), 5) AS a, round((high - low) * b / (2 * half), 5) AS b FROM l
""")
def definite_matrices(t):
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    m = pairs(t).groupBy("gene_id").agg((100 * F.var_pop("beta")).alias("a"), (120 * F.covar_pop("beta", "n")).alias("b"), (F.var_pop("n") / 40).alias("d"))
    out = m.select("gene_id", X.is_symmetric(b, b).alias("symmetric"), X.is_positive_definite(a, b, b, d).alias("definite"), *[c.alias(f"n_{k}") for k, c in X.make_positive_definite(a, b, b, d).items()])
    middle, half = (F.col("n_a") + F.col("n_d")) / 2, F.sqrt(F.pow(F.col("n_a") - F.col("n_d"), 2) / 4 + F.col("n_b") * F.col("n_b"))
    return out.select("gene_id", "symmetric", "definite", F.round(middle + half, 5).alias("trace_high"), F.round(middle - half, 5).alias("low"), F.round("n_a", 5).alias("a"), F.round("n_b", 5).alias("b"))


@query("SELECT gene_id, snp, line_order, line, chrom FROM pairs JOIN variants USING (snp)")
def id_lookup(t):
    return D.lookup(pairs(t), variants(t).select("snp", "chrom"), "snp", strict=True).select("gene_id", "snp", "line_order", "line", "chrom")


@query("SELECT snp, kind AS label, round(2 * af * (1 - af), 6) AS twopq, round(count(*) OVER (PARTITION BY kind) / (SELECT count(*) FROM variants WHERE ord % 3 <> 0)::DOUBLE, 6) AS fraction FROM variants WHERE ord % 3 <> 0")
def annotation_shares(t):
    out = C.annotation_members(variants(t).select("snp", F.col("kind").alias("label")), variants(t).filter("ord % 3 <> 0"))
    return out.select("snp", "label", r6("twopq").alias("twopq"), r6("fraction").alias("fraction"))


@query("""
, s AS (SELECT snp, sum(beta) / 100 AS mean, sum(beta * beta) / 100 AS square, count(*) / 100.0::DOUBLE AS pip, coalesce(max(CASE WHEN line_order % 100 = 7 THEN beta END), 0) AS last FROM pairs GROUP BY snp)
SELECT snp, CASE WHEN ord % 3 = 0 THEN a2 ELSE a1 END AS a1, round(CASE WHEN ord % 3 = 0 THEN 1 - af ELSE af END, 4) AS af, round(CASE WHEN ord % 3 = 0 THEN -1 ELSE 1 END * mean / sqrt(2 * af * (1 - af)), 5) AS effect,
  round(sqrt(greatest(0, square - mean * mean)) / sqrt(2 * af * (1 - af)), 5) AS se, round(pip, 5) AS pip, round(CASE WHEN ord % 3 = 0 THEN -1 ELSE 1 END * last / sqrt(2 * af * (1 - af)), 5) AS last_effect FROM s JOIN variants USING (snp) WHERE af > 0
""")
def posterior_table(t):
    samples = pairs(t).select((F.col("line_order") % 100).alias("draw"), "snp", F.col("beta").alias("effect"))
    v = variants(t).filter("af > 0").withColumn("flipped", F.col("ord") % 3 == 0)
    out = K.posterior_summary(samples, 100, v, last=7)
    return out.select("snp", "a1", F.round("af", 4).alias("af"), *[F.round(c, 5).alias(c) for c in ("effect", "se", "pip", "last_effect")])


@query("SELECT * FROM (SELECT 'beta' AS name, round(avg(beta), 6) AS mean, round(stddev_pop(beta), 6) AS sd, 1.0::DOUBLE AS pip FROM pairs UNION ALL SELECT 'line', round(avg(line - 1), 6), round(stddev_pop(line - 1), 6), round(avg((line > 1)::INTEGER), 6) FROM pairs)")
def column_means(t):
    rows = pairs(t).select("beta", (F.col("line") - 1).alias("line"))
    return K.column_summary(rows, ["beta", "line"]).select("name", *[r6(c).alias(c) for c in ("mean", "sd", "pip")])


@query("SELECT (line_order // 3 - 34)::BIGINT AS draw, snp, round(beta, 6) AS effect FROM pairs WHERE line_order >= 100 AND line_order % 3 = 0 AND beta <> 0")
def thinned_draws(t):
    samples = pairs(t).select(F.col("line_order").alias("draw"), "snp", F.col("beta").alias("effect"))
    return K.thinned_samples(samples, 100, 3).select("draw", "snp", r6("effect").alias("effect"))


@query("SELECT max(p_retailprice) AS cutoff FROM part")
def largest_cutoff(t):
    few = [r.c for r in t("part").groupBy((F.col("p_partkey") % 20).alias("k")).agg(F.max("p_retailprice").alias("c")).collect()]
    return spark_of(t).range(1).select(F.lit(S.largest(few)).alias("cutoff"))


@query("SELECT snp FROM variants WHERE ord % 2 = 0")
def same_positions(t):
    some = variants(t).filter("ord % 2 = 0")
    return D.check_positions(some, variants(t)).select("snp")


@query("SELECT brand, round(sum(af * ord) / sum(ord), 6) AS af FROM variants GROUP BY brand")
def merged_frequency(t):
    return variants(t).groupBy("brand").agg(r6(A.weighted_frequency(F.col("af"), F.col("ord"))).alias("af"))
