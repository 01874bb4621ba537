"""Every operator as a query over the star-schema tables, with the same question in SQL.

Roles: supplier is the gene, part the variant, lineitem the gene-variant pair, customer the individual,
embeddings the genotypes (a row is a variant, its entries the individuals), label the LD block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import filters as C
from ..operators import joins as D
from ..operators import ld as L
from ..operators import merges as H
from ..operators import windows as W
from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL; the function gets a reader of the tables by name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = _VIEWS + sql
        return f

    return add


def r6(x):
    return F.round(x, 6)


def variants(t) -> DataFrame:
    key = F.col("p_partkey")
    letter = "ACGT"
    return t("part").select(
        F.concat(F.lit("rs"), key).alias("snp"), key.alias("ord"), F.col("p_size").alias("chrom"), (key * 1000).alias("pos"),
        F.substr(F.lit(letter), (key % 4 + 1).cast("int"), F.lit(1)).alias("a1"),
        F.substr(F.lit(letter), (F.floor(key / 4) % 4 + 1).cast("int"), F.lit(1)).alias("a2"),
        ((key * 37 % 100) / 100).alias("af"), (key / 50.0).alias("gen_pos"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
    )


def genes(t) -> DataFrame:
    key = F.col("s_suppkey")
    return t("supplier").select(
        key.alias("gene_id"), key.alias("ord"), (key % 50 + 1).cast("int").alias("chrom"), (key * 97 % 2000 * 1000).alias("mid"), F.col("s_acctbal").alias("balance")
    )


def pairs(t) -> DataFrame:
    return t("lineitem").select(
        F.col("l_suppkey").alias("gene_id"), F.concat(F.lit("rs"), "l_partkey").alias("snp"), F.col("l_orderkey").alias("line_order"), F.col("l_linenumber").alias("line"),
        (F.col("l_discount") - 0.0501).alias("beta"), (F.col("l_tax") + 0.01).alias("se"), F.col("l_quantity").alias("n"),
    )


def blocks(t) -> DataFrame:
    """Blocks of 40 positions of each chromosome, next ones sharing a border."""
    rows = t("nation").select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("chrom"), F.col("n_nationkey").cast("long").alias("k"))
    return rows.select(
        (F.col("chrom") * 100 + F.col("k")).alias("ord"), F.concat_ws("_", "chrom", "k").alias("block_id"), "chrom",
        (F.col("k") * 80_000).alias("start"), ((F.col("k") + 1) * 80_000).alias("end"),
    )


def genotypes(t) -> DataFrame:
    """Regions are runs of 64 variants, so they stay small however many variants there are."""
    idx = F.col("vec_id").cast("long")
    return t("embeddings").select(idx.alias("idx"), F.concat(F.lit("v"), idx).alias("snp"), F.floor(idx / 64).alias("region"), F.col("embedding").alias("dosage"))


_VIEWS = """
WITH RECURSIVE variants AS (SELECT 'rs' || p_partkey AS snp, p_partkey AS ord, p_size AS chrom, p_partkey * 1000 AS pos,
  substr('ACGT', CAST(p_partkey % 4 + 1 AS INTEGER), 1) AS a1, substr('ACGT', CAST((p_partkey // 4) % 4 + 1 AS INTEGER), 1) AS a2,
  (p_partkey * 37 % 100) / 100.0::DOUBLE AS af, p_partkey / 50.0::DOUBLE AS gen_pos, p_brand AS brand, p_type AS kind FROM part),
genes AS (SELECT s_suppkey AS gene_id, s_suppkey AS ord, CAST(s_suppkey % 50 + 1 AS INTEGER) AS chrom, s_suppkey * 97 % 2000 * 1000 AS mid, s_acctbal AS balance FROM supplier),
pairs AS (SELECT l_suppkey AS gene_id, 'rs' || l_partkey AS snp, l_orderkey AS line_order, l_linenumber AS line,
  l_discount - 0.0501::DOUBLE AS beta, l_tax + 0.01::DOUBLE AS se, l_quantity AS n FROM lineitem),
blocks AS (SELECT c * 100 + n_nationkey AS ord, c || '_' || n_nationkey AS block_id, c AS chrom, n_nationkey * 80000 AS start, (n_nationkey + 1) * 80000 AS "end"
  FROM nation, (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS c)),
z AS (SELECT vec_id AS idx, vec_id // 64 AS region, list_transform(e, lambda x: (x - list_avg(e)) / sqrt(list_var_samp(e) * len(e))) AS g
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))
"""


# ---- filters


@query("SELECT snp, chrom FROM variants WHERE snp IN (SELECT snp FROM pairs WHERE n > 49)")
def extract_semi(t):
    return C.include_ids(variants(t), pairs(t).filter("n > 49")).select("snp", "chrom")


@query("SELECT snp, chrom FROM variants WHERE snp NOT IN (SELECT snp FROM pairs WHERE n > 49)")
def exclude_anti(t):
    return C.exclude_ids(variants(t), pairs(t).filter("n > 49")).select("snp", "chrom")


@query("SELECT gene_id, mid FROM genes WHERE gene_id IN (SELECT o_custkey FROM orders)")
def keep_gene(t):
    return C.include_ids(genes(t), t("orders").select(F.col("o_custkey").alias("gene_id")), "gene_id").select("gene_id", "mid")


@query("SELECT snp, pos FROM variants WHERE chrom = 22")
def chromosome_filter(t):
    return C.include_chromosome(variants(t), 22).select("snp", "pos")


@query("SELECT snp, round(least(af, 1 - af), 6) AS maf FROM variants WHERE least(af, 1 - af) >= 0.0501 AND least(af, 1 - af) <= 0.4001")
def maf_filter(t):
    return C.within_maf(variants(t), 0.0501, 0.4001).select("snp", r6(S.minor_frequency(F.col("af"))).alias("maf"))


@query("SELECT snp, a1, a2 FROM variants WHERE a1 || a2 NOT IN ('AT', 'TA', 'CG', 'GC')")
def ambiguous_filter(t):
    return C.exclude_ambiguous(variants(t)).select("snp", "a1", "a2")


@query("SELECT v.snp FROM variants v WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE g.chrom = v.chrom AND v.pos > g.mid - 300000 AND v.pos < g.mid + 300000)")
def region_anti(t):
    regions = genes(t).select("chrom", (F.col("mid") - 300_000).alias("start"), (F.col("mid") + 300_000).alias("end"))
    return C.exclude_regions(variants(t), regions, 200_000).select("snp")


@query("SELECT snp FROM variants WHERE NOT (chrom = 6 AND pos > 280000 AND pos < 1340000)")
def mhc_strict(t):
    return C.exclude_mhc(variants(t), 6, 280_000, 1_340_000).select("snp")


@query("""
SELECT snp, chrom, pos FROM variants v WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.ord = 701 AND v.chrom = b.chrom AND v.pos BETWEEN b.start AND b."end")
""")
def block_filter(t):
    return C.include_block(variants(t), blocks(t), 702).select("snp", "chrom", "pos")


@query("SELECT snp, count_if FROM (SELECT v.snp, bool_or(p.snp IS NOT NULL) AS count_if FROM variants v LEFT JOIN (SELECT DISTINCT snp FROM pairs WHERE n > 49) p ON v.snp = p.snp GROUP BY v.snp)")
def skeleton_tag(t):
    return C.tag_skeleton(variants(t), pairs(t).filter("n > 49")).select("snp", F.col("skeleton").alias("count_if"))


@query("""
, s AS (SELECT *, count(*) OVER (PARTITION BY gene_id) AS k FROM pairs WHERE (beta / se) * (beta / se) > 10.8275661706627)
SELECT gene_id, snp, line_order, line, round(beta, 6) AS beta, round(se, 6) AS se FROM s WHERE k >= 2
""")
def pvalue_filter_min2(t):
    kept = C.filter_pairs_by_p(pairs(t), 0.001)
    return kept.select("gene_id", "snp", "line_order", "line", r6("beta").alias("beta"), r6("se").alias("se"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def keep_individuals(t):
    people = t("customer").select(F.col("c_custkey").alias("fid"), F.col("c_custkey").alias("iid"))
    orders = t("orders").select(F.col("o_custkey").alias("fid"), F.col("o_custkey").alias("iid"), "o_orderstatus")
    kept = C.keep_individuals(people, orders.filter("o_orderstatus = 'F'"), keep=orders.filter("o_orderstatus = 'O'"))
    return kept.select(F.col("fid").alias("c_custkey"))


@query("SELECT snp, row_number() OVER (ORDER BY chrom, pos) - 1 AS idx FROM variants")
def row_reindex(t):
    return C.reindex(variants(t), "chrom", "pos").select("snp", "idx")


@query("SELECT snp, CAST(row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS INTEGER) AS idx FROM variants")
def row_reindex_by_chromosome(t):
    return C.reindex(variants(t), "pos", group=("chrom",)).select("snp", "idx")


@query("""
, g AS (SELECT snp, beta AS b, se, n, CAST(line_order * 31 % 100 AS DOUBLE) / 100 AS af, line_order, line,
          CASE WHEN line_order % 7 = 0 THEN 'N' ELSE substr('ACGT', CAST(CAST(substr(snp, 3) AS BIGINT) % 4 + 1 AS INTEGER), 1) END AS a1,
          substr('ACGT', CAST((CAST(substr(snp, 3) AS BIGINT) // 4) % 4 + 1 AS INTEGER), 1) AS a2 FROM pairs),
j AS (SELECT g.*, v.af AS ref_af, g.a1 = v.a1 AND g.a2 = v.a2 AS same, g.a1 = v.a2 AND g.a2 = v.a1 AS swapped FROM g JOIN variants v USING (snp)),
k AS (SELECT *, CASE WHEN NOT same AND NOT swapped THEN 'allele' WHEN abs(ref_af - CASE WHEN NOT same THEN 1 - af ELSE af END) > 0.2001 THEN 'af_diff'
        WHEN (CASE WHEN NOT same THEN 1 - af ELSE af END) IN (0.0, 1.0) THEN 'fixed' END AS reason FROM j),
m AS (SELECT median(n) AS med, stddev_samp(n) AS sd FROM k WHERE reason IS NULL)
SELECT coalesce(reason, CASE WHEN abs(n - med) > 1.5 * sd THEN 'n_outlier' END, 'kept') AS reason, count(*) AS rows FROM k, m GROUP BY 1
""")
def gwas_quality(t):
    number = F.substring("snp", 3, 18).cast("long")
    letter = F.lit("ACGT")
    a1 = F.when(F.col("line_order") % 7 == 0, "N").otherwise(F.substr(letter, (number % 4 + 1).cast("int"), F.lit(1)))
    gwas = pairs(t).select("snp", F.col("beta").alias("b"), "se", "n", (F.col("line_order") * 31 % 100 / 100).alias("af"), a1.alias("a1"), F.substr(letter, (F.floor(number / 4) % 4 + 1).cast("int"), F.lit(1)).alias("a2"), F.lit(0.5).alias("p"))
    out = C.gwas_qc(gwas, variants(t), max_af_diff=0.2001, outlier_sd=1.5)
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


# ---- joins


@query("""
, o AS (SELECT snp, a1 AS o1, a2 AS o2, round(af, 6) AS af FROM variants),
s AS (SELECT snp, CASE WHEN ord % 3 = 0 THEN a2 WHEN ord % 11 = 0 THEN 'N' ELSE a1 END AS b1, CASE WHEN ord % 3 = 0 THEN a1 ELSE a2 END AS b2 FROM variants)
SELECT snp, CAST(CASE WHEN b1 = o1 AND b2 = o2 THEN 1 ELSE -1 END AS INTEGER) AS orient, round(CASE WHEN b1 = o1 AND b2 = o2 THEN af ELSE 1 - af END, 6) AS af
FROM s JOIN o USING (snp) WHERE (b1 = o1 AND b2 = o2) OR (b1 = o2 AND b2 = o1)
""")
def allele_join(t):
    v = variants(t)
    odd, third = F.col("ord") % 11 == 0, F.col("ord") % 3 == 0
    study = v.select("snp", F.when(third, F.col("a2")).when(odd, "N").otherwise(F.col("a1")).alias("a1"), F.when(third, F.col("a1")).otherwise(F.col("a2")).alias("a2"), "af")
    ref = v.select("snp", F.col("a1").alias("ref_a1"), F.col("a2").alias("ref_a2"))
    return D.align_alleles(study.join(ref, "snp")).select("snp", "orient", r6("af").alias("af"))


@query("""
, m AS (SELECT v.snp, min(b.ord) AS ord FROM variants v JOIN blocks b ON v.chrom = b.chrom AND v.pos >= b.start AND v.pos <= b."end" GROUP BY v.snp),
k AS (SELECT b.block_id, m.snp, count(*) OVER (PARTITION BY b.block_id) AS n FROM m JOIN blocks b USING (ord))
SELECT block_id, count(*) AS n_snps, min(snp) AS first_snp FROM k WHERE n >= 2 GROUP BY block_id
""")
def block_interval_join(t):
    mapped = D.map_to_blocks(variants(t), blocks(t))
    return mapped.groupBy("block_id").agg(F.count("*").alias("n_snps"), F.min("snp").alias("first_snp"))


@query("""
, m AS (SELECT g.gene_id, v.snp, count(*) OVER (PARTITION BY g.gene_id) AS n FROM genes g JOIN variants v ON v.chrom = g.chrom AND v.pos BETWEEN g.mid - 400000 AND g.mid + 400000)
SELECT gene_id, snp FROM m WHERE n >= 2
""")
def cis_window_join(t):
    return D.map_to_genes(variants(t), genes(t), 0.4).select("gene_id", "snp")


@query("""
, m AS (SELECT g.gene_id, v.snp, count(*) OVER (PARTITION BY g.gene_id) AS n FROM genes g JOIN variants v ON v.chrom = g.chrom AND v.pos BETWEEN g.mid - 400000 AND g.mid + 400000)
SELECT p.gene_id, p.snp, p.line_order, p.line FROM pairs p WHERE EXISTS (SELECT 1 FROM m WHERE m.n >= 2 AND m.gene_id = p.gene_id AND m.snp = p.snp)
""")
def cis_window_filter(t):
    return D.filter_pairs_by_window(pairs(t), variants(t), genes(t), 0.4).select("gene_id", "snp", "line_order", "line")


@query("""
SELECT g.gene_id, coalesce(min(v.pos), -1) AS pos, coalesce(arg_min(v.snp, v.pos), 'none') AS snp FROM genes g LEFT JOIN variants v ON v.chrom = g.chrom AND v.pos >= g.mid GROUP BY g.gene_id
""")
def nearest_right(t):
    asked = genes(t).select(F.col("gene_id").alias("qid"), "chrom", F.col("mid").alias("at"))
    return D.nearest_at_or_after(asked, variants(t), 100_000).select(F.col("qid").alias("gene_id"), F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("snp", F.lit("none")).alias("snp"))


_CIS = ", c AS (SELECT g.gene_id, v.snp FROM genes g JOIN variants v ON v.chrom = g.chrom AND v.pos BETWEEN g.mid - 400000 AND g.mid + 400000)"


def cis(t) -> DataFrame:
    spans = genes(t).select("gene_id", "chrom", (F.col("mid") - 400_000).alias("start"), (F.col("mid") + 400_000).alias("end"))
    return D.interval_join(variants(t).select("snp", "chrom", "pos"), spans).select("gene_id", "snp")


@query(_CIS + "SELECT v.snp, count(DISTINCT m.gene_id) AS n_genes FROM variants v LEFT JOIN (SELECT c.snp, c.gene_id FROM c JOIN pairs p ON p.snp = c.snp AND p.gene_id = c.gene_id) m USING (snp) GROUP BY v.snp")
def genes_per_variant(t):
    return D.gene_variant_maps(pairs(t), variants(t), cis(t))["genes_per_variant"].select("snp", "n_genes")


@query(_CIS + "SELECT gene_id, count(*) AS untyped FROM c WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.gene_id = c.gene_id AND p.snp = c.snp) GROUP BY gene_id")
def interval_complement(t):
    return D.gene_variant_maps(pairs(t), variants(t), cis(t))["without_effect"].groupBy("gene_id").agg(F.count("*").alias("untyped"))


@query(_CIS + "SELECT snp FROM variants v WHERE NOT EXISTS (SELECT 1 FROM c JOIN pairs p ON p.snp = c.snp AND p.gene_id = c.gene_id WHERE c.snp = v.snp)")
def intergenic_variants(t):
    """Variants of no gene."""
    return D.gene_variant_maps(pairs(t), variants(t), cis(t))["intergenic"]


@query("""
, e AS (SELECT chrom, min(pos) AS low, max(pos) AS high FROM variants GROUP BY chrom)
SELECT gene_id, greatest(mid - 400000, low)::BIGINT AS start, least(mid + 400000, high)::BIGINT AS "end" FROM genes LEFT JOIN e USING (chrom)
""")
def gene_ranges(t):
    """C14: windows of genes, clipped to their chromosome."""
    return D.gene_windows(genes(t), variants(t), 0.4).select("gene_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""
, r AS (SELECT o_custkey AS fid, o_orderstatus AS gene_id, o_totalprice AS value FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT gene_id, count(*) AS rows, round(var_samp(value) / 1e6, 4) AS variance FROM r GROUP BY gene_id
""")
def gene_phenotype_join(t):
    people = t("customer").select(F.col("c_custkey").alias("fid"), F.lit("1").alias("iid"))
    values = t("orders").select(F.col("o_custkey").alias("fid"), F.lit("1").alias("iid"), F.col("o_orderstatus").alias("gene_id"), F.col("o_totalprice").alias("value"))
    return D.gene_phenotypes(people, values).groupBy("gene_id").agg(F.count("*").alias("rows"), F.round(F.max("variance") / 1e6, 4).alias("variance"))


@query("""
, ref AS (SELECT DISTINCT l_suppkey AS gene_id, 'rs' || l_partkey AS snp FROM lineitem),
has AS (SELECT gene_id, snp, count(*) AS k FROM pairs WHERE n > 15 GROUP BY 1, 2),
j AS (SELECT r.gene_id, r.snp, coalesce(k, 1) AS k, h.k IS NOT NULL AS typed FROM ref r LEFT JOIN has h USING (gene_id, snp)),
m AS (SELECT gene_id, sum(CASE WHEN typed THEN 0 ELSE 1 END)::DOUBLE / sum(k) AS missing FROM j GROUP BY gene_id)
SELECT gene_id, sum(k)::BIGINT AS rows, sum(CASE WHEN typed THEN k ELSE 0 END)::BIGINT AS typed FROM j WHERE gene_id IN (SELECT gene_id FROM m WHERE missing <= 0.27) GROUP BY gene_id
""")
def align_missing_rate(t):
    out = D.align_to_reference_genes(pairs(t).select("gene_id", "snp").distinct(), pairs(t).filter("n > 15"), 0.27)
    return out.groupBy("gene_id").agg(F.count("*").alias("rows"), F.count_if("typed").alias("typed"))


# ---- aggregates


@query("SELECT gene_id, round(sum(n * abs(beta)) / sum(n), 6) AS af FROM pairs GROUP BY gene_id")
def weighted_af(t):
    return pairs(t).groupBy("gene_id").agg(r6(A.weighted_frequency(F.abs("beta"), F.col("n"))).alias("af"))


@query("""
, m AS (SELECT gene_id, floor(avg(n)) AS n_mean FROM pairs GROUP BY gene_id)
SELECT gene_id, n_mean::BIGINT AS n_mean, round(sqrt(avg((n - n_mean) * (n - n_mean))), 6) AS n_sd FROM pairs JOIN m USING (gene_id) GROUP BY gene_id, n_mean
""")
def n_mean_sd(t):
    return A.sample_size_stats(pairs(t)).select("gene_id", "n_mean", r6("n_sd").alias("n_sd"))


@query("SELECT gene_id, round(median(n), 6) AS true_median, list_sort(list(n))[count(*) // 2 + 1] AS upper_median FROM pairs GROUP BY gene_id")
def medians(t):
    return pairs(t).groupBy("gene_id").agg(r6(F.median("n")).alias("true_median"), A.upper_median("n").alias("upper_median"))


@query("""
SELECT gene_id, round(covar_pop(n, se) / sqrt(var_samp(n) * var_samp(se)), 6) AS corr, round(covar_pop(n, se) / var_samp(n), 6) AS slope,
  round(avg(se), 6) AS mean_se, round(var_samp(se), 6) AS var_se FROM pairs GROUP BY gene_id
""")
def biased_statistics(t):
    n, se = F.col("n"), F.col("se")
    return pairs(t).groupBy("gene_id").agg(
        r6(A.biased_correlation(n, se)).alias("corr"), r6(A.biased_slope(n, se)).alias("slope"), r6(F.avg(se)).alias("mean_se"), r6(F.var_samp(se)).alias("var_se")
    )


@query("SELECT gene_id, trunc(-1 / regr_slope(se * se, beta * beta - se * se))::BIGINT AS n FROM pairs GROUP BY gene_id")
def ols_sample_size(t):
    return pairs(t).groupBy("gene_id").agg(A.regressed_sample_size(F.col("beta"), F.col("se")).alias("n"))


@query("""
SELECT chrom, count(*) AS size, min(ord) AS first_idx, max(ord) AS last_idx, arg_min(pos, ord) AS first_pos, arg_max(pos, ord) AS last_pos,
  arg_min(snp, ord) AS first_snp, arg_max(snp, ord) AS last_snp FROM variants GROUP BY chrom
""")
def chromosome_ranges(t):
    return A.chromosome_ranges(variants(t))


@query("SELECT o_orderstatus AS gene_id, round(var_samp(o_totalprice) * 0.5 / 1e6, 4) AS v_genetic, round(var_samp(o_totalprice) * 0.5 / 1e6, 4) AS v_residual, round(var_samp(o_totalprice) * 0.05 / 1e6, 4) AS v_random FROM orders GROUP BY 1")
def variance_parts(t):
    rows = t("orders").groupBy(F.col("o_orderstatus").alias("gene_id")).agg((F.var_samp("o_totalprice") / 1e6).alias("v"))
    return rows.select("gene_id", *[F.round(x, 4).alias(n) for n, x in A.variance_parts(F.col("v"), 0.5, 0.05).items()])


@query("SELECT * FROM (SELECT 'beta' AS name, round(avg(beta), 4) AS mean, round(stddev_samp(beta), 4) AS sd FROM pairs UNION ALL SELECT 'se', round(avg(se), 4), round(stddev_samp(se), 4) FROM pairs UNION ALL SELECT 'n', round(avg(n), 4), round(stddev_samp(n), 4) FROM pairs)")
def input_summary(t):
    return A.input_summary(pairs(t), ["beta", "se", "n"]).select("name", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("""
SELECT * FROM (SELECT 'beta' AS "left", 'beta' AS "right", round(sum(beta * beta), 3) AS value FROM pairs UNION ALL SELECT 'beta', 'n', round(sum(beta * n), 3) FROM pairs
UNION ALL SELECT 'se', 'beta', round(sum(se * beta), 3) FROM pairs UNION ALL SELECT 'se', 'n', round(sum(se * n), 3) FROM pairs)
""")
def cross_products(t):
    return A.cross_products(pairs(t), ["beta", "se"], ["beta", "n"]).select("left", "right", F.round("value", 3).alias("value"))


# ---- windows, sorting, merging


@query("""
, v AS (SELECT *, row_number() OVER (ORDER BY chrom, pos) - 1 AS idx FROM variants)
SELECT snp, min(idx) OVER w AS window_start, count(*) OVER w AS window_size, max(idx) OVER w AS window_end FROM v
WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 199999 PRECEDING AND 199999 FOLLOWING)
""")
def window_info(t):
    indexed = C.reindex(variants(t), "chrom", "pos")
    return W.window_info(indexed, 400_000).select("snp", "window_start", "window_size", "window_end")


@query("SELECT gene_id, count(*) AS n_pairs, coalesce(sum(count(*)) OVER (ORDER BY gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM pairs GROUP BY gene_id")
def prefix_offsets(t):
    return W.running_offsets(pairs(t).groupBy("gene_id").agg(F.count("*").alias("n_pairs")), "n_pairs", "gene_id")


@query("SELECT snp, dense_rank() OVER (ORDER BY brand) - 1 AS code FROM variants")
def rank_bins(t):
    return W.dense_codes(variants(t), "brand").select("snp", "code")


@query("""
, f AS (SELECT brand, row_number() OVER (ORDER BY min(ord), brand) AS code FROM variants GROUP BY brand)
SELECT snp, code FROM variants JOIN f USING (brand)
""")
def first_seen_codes(t):
    return W.first_seen_codes(variants(t), "brand", "ord").select("snp", "code")


@query("""
, p AS (SELECT DISTINCT chrom, pos FROM variants),
w AS (SELECT chrom, min(pos) AS s FROM p GROUP BY chrom UNION ALL SELECT w.chrom, (SELECT min(p.pos) FROM p WHERE p.chrom = w.chrom AND p.pos > w.s + 300000) AS s FROM w
  WHERE EXISTS (SELECT 1 FROM p WHERE p.chrom = w.chrom AND p.pos > w.s + 300000)),
n AS (SELECT chrom, s, row_number() OVER (ORDER BY chrom, s) - 1 AS number FROM w)
SELECT snp, v.chrom, pos, CAST(max(number) AS INTEGER) AS "window" FROM variants v JOIN n ON n.chrom = v.chrom AND n.s <= v.pos GROUP BY snp, v.chrom, pos
""")
def tumbling_greedy(t):
    return W.tumbling_windows(variants(t).select("snp", "chrom", "pos"), 300_000)


@query("""
, a AS (SELECT 0 AS part, gene_id, ord, mid FROM genes WHERE gene_id % 2 = 0 UNION ALL SELECT 1, gene_id, ord, mid + 1 FROM genes WHERE gene_id % 3 = 0)
SELECT gene_id, arg_min(mid, part) AS mid FROM a GROUP BY gene_id
""")
def merge_first_wins(t):
    g = genes(t).select("gene_id", "ord", "mid")
    both = H.stack([g.filter("gene_id % 2 = 0"), g.filter("gene_id % 3 = 0").withColumn("mid", F.col("mid") + 1)])
    return H.first_of_each(both, ["gene_id"], ["part", "ord"]).select("gene_id", "mid")


@query("SELECT gene_id FROM genes WHERE (gene_id % 2 = 0) <> (gene_id % 3 = 0)")
def merge_drop_repeated(t):
    g = genes(t).select(F.col("gene_id").alias("region"))
    return H.merge_eigen([g.filter("region % 2 = 0"), g.filter("region % 3 = 0")]).select(F.col("region").alias("gene_id"))


@query("""
, s AS (SELECT 'block' || chrom AS block, chrom AS block_number, chrom, count(*) AS n_snps, arg_min(snp, ord) AS first_snp, arg_max(snp, ord) AS last_snp FROM variants GROUP BY chrom)
SELECT block, block_number::BIGINT AS block_number, chrom, coalesce(sum(n_snps) OVER (ORDER BY block_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_idx, first_snp,
  (sum(n_snps) OVER (ORDER BY block_number) - 1)::BIGINT AS end_idx, last_snp, n_snps FROM s
""")
def block_merge_order(t):
    rows = variants(t).select(F.concat(F.lit("block"), "chrom").alias("block"), "chrom", "snp", F.col("ord").alias("index"))
    return H.merge_blocks(rows)


@query("SELECT snp, line_order, line FROM pairs p WHERE line = (SELECT max(line) FROM pairs q WHERE q.line_order = p.line_order)")
def merge_last_listed(t):
    return H.merge_by_block(pairs(t), "line_order", "line").select("snp", "line_order", "line")


@query("""
, c AS (SELECT count(*) AS n, (count(*) + 14) // 15 AS size FROM variants)
SELECT k AS part, (k - 1) * size + 1 AS first, least(n, k * size) AS last FROM (SELECT unnest(range(1, 16))::BIGINT AS k), c WHERE (k - 1) * size + 1 <= n
""")
def split_ranges(t):
    v = variants(t)
    return H.split_ranges(v.sparkSession, v.count(), 15).select("part", "first", F.col("last").cast("long").alias("last"))


# ---- exports


@query("SELECT snp, count(*) FILTER (WHERE n < 10) AS \"low\", count(*) FILTER (WHERE n >= 10 AND n < 40) AS \"mid\", count(*) FILTER (WHERE n >= 40) AS \"high\" FROM pairs GROUP BY snp")
def annotation_pivot(t):
    label = F.when(F.col("n") < 10, "low").when(F.col("n") < 40, "mid").otherwise("high")
    return pairs(t).withColumn("label", label).groupBy("snp").pivot("label", ["low", "mid", "high"]).count().fillna(0)


@query("SELECT gene_id, snp, line_order, line, CASE WHEN abs(se) > 0.0150001 THEN round(beta / se, 6) END AS z FROM pairs")
def zscore_export(t):
    return pairs(t).select("gene_id", "snp", "line_order", "line", r6(S.z_score(F.col("beta"), F.col("se"), 0.0150001)).alias("z"))


@query("""
SELECT gene_id, snp, line_order, line, CASE WHEN abs(beta) < 0.01 THEN printf('%.5e', beta) ELSE printf('%.15f', beta) END AS beta, round(1 / sqrt(n * se * se + beta * beta) * beta, 6) AS b_scaled FROM pairs
""")
def number_formats(t):
    scaled = S.scaled_effects(F.col("beta"), F.col("se"), F.col("n"))
    return pairs(t).select("gene_id", "snp", "line_order", "line", S.number_text(F.col("beta"), switch=0.01).alias("beta"), r6(scaled["b_scaled"]).alias("b_scaled"))


#: erfc(x) for x >= 0 by Simpson's rule over [x, x + 8].
_ERFC = "2 / sqrt(pi()) * 0.01 / 3 * list_sum(list_transform(range(0, 801), lambda k: (CASE WHEN k = 0 OR k = 800 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({x} + k * 0.01, 2))))"


@query(f"SELECT gene_id, snp, line_order, line, round({_ERFC.format(x='sqrt(pow(beta / se, 2) / 2)')}, 6) AS p FROM pairs")
def pair_pvalues(t):
    z2 = (F.col("beta") / F.col("se")) * (F.col("beta") / F.col("se"))
    return pairs(t).select("gene_id", "snp", "line_order", "line", r6(S.chi2_tail(z2)).alias("p"))


# ---- LD


@query("""
SELECT a.region, a.idx AS i, b.idx AS j, round(CASE WHEN k = 1 THEN 1 ELSE list_dot_product(a.g, b.g) END, 6) AS r
FROM z a JOIN z b ON a.region = b.region AND a.idx <= b.idx JOIN (SELECT region, count(*) AS k FROM z GROUP BY region) c ON c.region = a.region
""")
def ld_blocks(t):
    return L.region_ld(genotypes(t)).select("region", "i", "j", r6("r").alias("r"))


@query("SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.g, b.g), 6) AS r FROM z a JOIN z b ON a.idx <= b.idx WHERE a.idx = b.idx OR pow(list_dot_product(a.g, b.g), 2) * 64 >= 10")
def ld_sparse(t):
    rows = L.ld_pairs(genotypes(t), tile=256, least_r2=10 / 64.0001)
    return L.sparse(rows, 64).select("i", "j", r6("r").alias("r"))


@query("SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.g, b.g), 6) AS r FROM z a JOIN z b ON b.idx BETWEEN a.idx AND a.idx + 20")
def ld_banded(t):
    return L.ld_pairs(genotypes(t), tile=64, band=20).select("i", "j", r6("r").alias("r"))


@query("""
, p AS (SELECT a.idx AS i, list_dot_product(a.g, b.g) AS r FROM z a JOIN z b ON b.idx BETWEEN a.idx - 20 AND a.idx + 20)
SELECT i, round(sum(r), 5) AS ld_sum, round(sum(r * r), 5) AS ldsc, round(sum(pow(1 - r * r, 2) / 64), 5) AS sampling_var FROM p GROUP BY i
""")
def ld_scores(t):
    out = A.ld_row_stats(L.mirrored(L.ld_pairs(genotypes(t), tile=64, band=20)), 64)
    return out.select("i", *[F.round(c, 5).alias(c) for c in ("ld_sum", "ldsc", "sampling_var")])


@query("""
, p AS (SELECT a.idx AS i, b.idx AS j, list_dot_product(a.g, b.g) AS r, exp(-4 * 100 * abs(a.idx / 50.0 - b.idx / 50.0) / 100 / 366) AS s FROM z a JOIN z b ON b.idx BETWEEN a.idx AND a.idx + 20),
h AS (SELECT 1 / (ln(365) + 0.5772156649015329 + 1 / (2 * 365.0) - 1 / (12 * 365.0 ^ 2) + 1 / (120 * 365.0 ^ 4)) AS x), c AS (SELECT x / (366 + x) AS theta FROM h)
SELECT i, j, round((r * 0.4 * s * pow(1 - theta, 2) + CASE WHEN i = j THEN 0.5 * theta * (1 - 0.5 * theta) ELSE 0 END) / (0.4 * pow(1 - theta, 2) + 0.5 * theta * (1 - 0.5 * theta)), 6) AS r FROM p, c
""")
def shrink_ld(t):
    g = genotypes(t)
    v = g.select("idx", (F.col("idx") / 50).alias("gen_pos"), F.lit(0.4).alias("twopq"))
    return L.shrink(L.ld_pairs(g, tile=64, band=20), v, ne=100).select("i", "j", r6("r").alias("r"))


@query("SELECT region, count(*)::INTEGER AS m, round(count(*) * CASE WHEN count(*) = 1 THEN 1 ELSE 63 / 64.0::DOUBLE END + 0.00001, 4) AS sum_pos FROM z GROUP BY region")
def eigen_trace(t):
    return L.region_eigen(genotypes(t)).select("region", "m", F.round(F.col("sum_pos") + 0.00001, 4).alias("sum_pos"))


def two(t) -> DataFrame:
    """Genotypes in regions of two variants, whose decomposition SQL can write down."""
    return genotypes(t).withColumn("region", F.floor(F.col("idx") / 2))


def effects(t) -> DataFrame:
    return genotypes(t).select("idx", "snp", ((F.col("idx") % 9 - 4.5) / 100).alias("b"), (0.02 + F.col("idx") % 7 / 100).alias("se"), (1000 + F.col("idx") % 50 * 10.0).alias("n"), ((F.col("idx") % 40 + 5) / 100).alias("af"))


#: Regions of two variants: r, the diagonal c, and each one's effect, error, size and frequency as x and y; eff as effects().
_TWO = """
, eff AS (SELECT idx, (idx % 9 - 4.5::DOUBLE) / 100 AS b, 0.02::DOUBLE + idx % 7 / 100.0::DOUBLE AS se, 1000 + idx % 50 * 10.0::DOUBLE AS n, (idx % 40 + 5) / 100.0::DOUBLE AS af FROM z),
two AS (SELECT a.idx // 2 AS region, a.idx AS i, b.idx AS j, list_dot_product(a.g, b.g) AS r, 63 / 64.0::DOUBLE AS c, x, y
  FROM z a JOIN z b ON a.idx % 2 = 0 AND b.idx = a.idx + 1 JOIN eff x ON x.idx = a.idx JOIN eff y ON y.idx = b.idx)
"""


@query(_TWO + """
SELECT region, 2 AS m, CASE WHEN (c + abs(r)) / (2 * c) > 0.55 THEN 1 ELSE 2 END AS k, round(2 * c, 5) AS sum_pos, 0.55::DOUBLE AS cutoff,
  round(c + abs(r), 6) AS top, round(CASE WHEN (c + abs(r)) / (2 * c) > 0.55 THEN c + abs(r) ELSE c - abs(r) END, 6) AS least FROM two
""")
def eigen_rank(t):
    e = L.retruncate(L.region_eigen(two(t), 0.9999999), 0.55)
    return e.select("region", "m", "k", F.round("sum_pos", 5).alias("sum_pos"), "cutoff", r6(F.element_at("values", -1)).alias("top"), r6(F.element_at("values", 1)).alias("least"))


@query(_TWO + """
, l AS (SELECT region, c + abs(r) AS v, c FROM two UNION ALL SELECT region, c - abs(r), c FROM two)
SELECT region, round(v, 5) AS value, round(sum(v) OVER (PARTITION BY region ORDER BY v DESC) / (2 * c), 5) AS share FROM l
""")
def eigen_shares(t):
    e = L.region_eigen(two(t), 0.9999999).select("region", F.explode("values").alias("lambda"))
    return W.eigen_shares(e).select("region", F.round("lambda", 5).alias("value"), F.round("share", 5).alias("share"))


_IMPUTED = """
, imp AS (SELECT two.*, r / (c + 0.1) * x.b / x.se AS zi, 2 * x.af * (1 - x.af) * (x.n * x.se * x.se + x.b * x.b) AS v, 2 * y.af * (1 - y.af) AS tpq FROM two),
filled AS (SELECT i AS idx, x.b AS beta, x.se AS se, x.n AS n, false AS imputed FROM imp
  UNION ALL SELECT j, zi * sqrt(v) / sqrt(tpq * (x.n + zi * zi)), sqrt(v) / sqrt(tpq * (x.n + zi * zi)), x.n, true FROM imp)
"""


#: Regions of 64 variants: r of each pair, and of each variant with its region's first, which gives effects whose solution is known.
_WHOLE = """
, q AS (SELECT a.region, a.idx AS i, b.idx AS j, list_dot_product(a.g, b.g) AS r FROM z a JOIN z b ON a.region = b.region),
lone AS (SELECT region FROM z GROUP BY region HAVING count(*) > 1),
f AS (SELECT q.* FROM q JOIN lone USING (region) WHERE j % 64 = 0)
"""


def with_first(t, delta: float) -> DataFrame:
    """Variants of regions of more than one, with z = r with the region's first, plus delta for the first itself: then
    (R + delta I)^-1 z is 1 at the first and 0 elsewhere, and the first's r is what z of any other follows from."""
    r = L.region_ld(genotypes(t)).filter("i % 64 = 0").select("region", F.col("j").alias("idx"), "r")
    size = r.groupBy("region").agg(F.count("*").alias("m")).filter("m > 1")
    return r.join(size, "region").withColumn("z", F.col("r") + F.when(F.col("idx") % 64 == 0, F.lit(delta)).otherwise(F.lit(0.0)))


@query(_WHOLE + "SELECT 'v' || i AS snp, round(CASE WHEN i = j THEN r + 0.1 ELSE r END, 4) AS z, i % 64 % 3 = 2 AS imputed FROM f")
def impute_z(t):
    """J9 over whole regions: every third variant has no effect of its own."""
    known = with_first(t, 0.1).select("region", F.concat(F.lit("v"), "idx").alias("snp"), F.lit(0.3).alias("af"), F.when(F.col("idx") % 64 % 3 != 2, F.col("z")).alias("beta"), F.lit(1.0).alias("se"), F.lit(1000.0).alias("n"))
    out = L.impute_summary(known, L.region_eigen(genotypes(t), 1.0))
    return out.select("snp", F.round(F.col("beta") / F.col("se"), 4).alias("z"), "imputed")


@query(_TWO + _IMPUTED + "SELECT 'v' || idx AS snp, round(beta, 5) AS beta, round(se, 5) AS se, n, imputed FROM filled")
def impute_effects(t):
    """Effects and errors, in regions of two variants."""
    g = two(t)
    known = effects(t).join(g.select("snp", "region"), "snp")
    stats = known.select("region", "snp", "af", F.when(F.col("idx") % 2 == 0, F.col("b")).alias("beta"), "se", "n")
    return L.impute_summary(stats, L.region_eigen(g, 0.9999999)).select("snp", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), "n", "imputed")


@query(_WHOLE + "SELECT 'v' || i AS snp, round(r, 5) AS z FROM f WHERE i <> j")
def resample_left_out_whole(t):
    """J10 over whole regions: all but the first are predicted as they are."""
    known = with_first(t, 0.1).select("region", F.concat(F.lit("v"), "idx").alias("snp"), F.lit(0.3).alias("af"), F.col("z").alias("beta"), F.lit(1.0).alias("se"), F.lit(1000.0).alias("n"))
    out = L.resample_effects(known, L.region_eigen(genotypes(t), 1.0), 5000).filter("cast(substr(snp, 2) as long) % 64 <> 0")
    return out.select("snp", F.round(F.col("beta_new") / F.col("se_new"), 5).alias("z"))


@query(_WHOLE + """
, e AS (SELECT idx, (idx % 9 - 4.5::DOUBLE) / 100 / (0.02::DOUBLE + idx % 7 / 100.0::DOUBLE) AS z, 1000 + idx % 50 * 10.0::DOUBLE AS n FROM z),
s AS (SELECT i, sum(r) AS total, count(*) AS m FROM q JOIN lone USING (region) GROUP BY i)
SELECT 'v' || i AS snp, round((sqrt(n * 5000) * (total + 0.1) / m + least(n, 5000) / sqrt(n * 5000)) / z, 4) AS z FROM s JOIN e ON e.idx = s.i
""")
def resample_by_score_whole(t):
    """J10 by LD scores over whole regions."""
    g = genotypes(t)
    size = g.groupBy("region").count().filter("count > 1").select("region")
    known = effects(t).join(g.select("snp", "region"), "snp").join(size, "region")
    out = L.resample_effects(known.select("region", "snp", "af", F.col("b").alias("beta"), "se", "n"), L.region_eigen(g, 1.0), 5000, by_score=True)
    return out.select("snp", F.round(F.col("beta_new") / F.col("se_new"), 4).alias("z"))


@query(_WHOLE + "SELECT region, round(r, 4) AS total FROM f WHERE i = j")
def project_effects_whole(t):
    """J13 over whole regions: b is a column of R, so that the squares of its projection add up to its diagonal entry."""
    known = with_first(t, 0.0).select("region", F.concat(F.lit("v"), "idx").alias("snp"), F.col("z").alias("b"))
    w = L.project_effects(known, L.region_eigen(genotypes(t), 1.0))
    return w.groupBy("region").agg(F.round(F.sum(F.col("w") * F.col("w")), 4).alias("total"))


#: Of half the people there are more variants than people in a region.
_HALF = """
, y AS (SELECT vec_id AS idx, vec_id // 64 AS region, list_transform(e, lambda x: (x - list_avg(e)) / sqrt(list_var_samp(e) * len(e))) AS g
  FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings)), many AS (SELECT region FROM y GROUP BY region HAVING count(*) > 1)
"""


@query(_HALF + "SELECT a.region, a.idx AS i, b.idx AS j, round(list_dot_product(a.g, b.g), 5) AS r FROM y a JOIN y b ON a.region = b.region AND a.idx <= b.idx JOIN many ON many.region = a.region")
def eigen_reconstruction(t):
    """Vectors and values of regions of 64 variants and 32 people put together again."""
    g = genotypes(t).withColumn("dosage", F.slice("dosage", 1, 32))
    q = L.projection_matrix(L.region_eigen(g.join(g.groupBy("region").count().filter("count > 1").select("region"), "region"), 1.0))
    q = q.select("region", "component", F.substring("snp", 2, 18).cast("long").alias("idx"), "q")
    a, b = (q.withColumnsRenamed({"idx": x, "q": f"q{x}"}) for x in ("i", "j"))
    both = a.join(b, ["region", "component"]).filter("i <= j")
    return both.groupBy("region", "i", "j").agg(F.round(F.sum(F.col("qi") * F.col("qj")) + 1e-12, 5).alias("r"))


@query(_TWO + _IMPUTED + "SELECT idx // 2 AS gene_id, 'v' || idx AS snp, round(beta, 5) AS beta, round(se, 5) AS se, n, imputed FROM filled WHERE idx // 2 % 10 <> 3")
def aligned_pairs_imputed(t):
    g = two(t)
    known = effects(t).join(g.select("snp", F.col("region").alias("gene_id")), "snp")
    own = known.filter("idx % 2 = 0 and gene_id % 10 <> 3").select("gene_id", "snp", F.col("b").alias("beta"), "se", "n", "af")
    out = L.align_and_impute(known.select("gene_id", "snp", "af"), own, L.region_eigen(g, 0.9999999), 0.6)
    return out.select("gene_id", "snp", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), "n", "imputed")


@query(_TWO + "SELECT region, round((x.b + sign(r) * y.b) ^ 2 / 2 / (c + abs(r)), 6) AS top, round((x.b + sign(r) * y.b) ^ 2 / 2 / (c + abs(r)) + (x.b - sign(r) * y.b) ^ 2 / 2 / (c - abs(r)), 6) AS total FROM two")
def project_effects(t):
    known = effects(t).join(two(t).select("snp", "region"), "snp")
    w = L.project_effects(known.select("region", "snp", "b"), L.region_eigen(two(t), 0.9999999))
    square = F.col("w") * F.col("w")
    return w.groupBy("region").agg(r6(F.max_by(square, "component")).alias("top"), r6(F.sum(square)).alias("total"))


@query(_TWO + "SELECT region, round(c * 2 * x.af * (1 - x.af), 5) AS first, round(r * sqrt(4 * x.af * (1 - x.af) * y.af * (1 - y.af)), 5) AS both FROM two")
def projection_matrix(t):
    variances = effects(t).select("snp", (2 * F.col("af") * (1 - F.col("af"))).alias("twopq"))
    q = L.projection_matrix(L.region_eigen(two(t), 0.9999999), variances).withColumn("second", F.substring("snp", 2, 18).cast("long") % 2)
    cells = q.groupBy("region", "component").agg(F.max(F.when(F.col("second") == 0, F.col("q"))).alias("a"), F.max(F.when(F.col("second") == 1, F.col("q"))).alias("b"))
    return cells.groupBy("region").agg(F.round(F.sum(F.col("a") * F.col("a")), 5).alias("first"), F.round(F.sum(F.col("a") * F.col("b")), 5).alias("both"))


@query(_TWO + "SELECT 'v' || idx AS snp, round(b, 6) AS whole FROM eff")
def pseudo_summary(t):
    known = effects(t).join(two(t).select("snp", "region"), "snp")
    out = L.pseudo_summary(known.select("region", "snp", "b"), L.region_eigen(two(t), 0.9999999), 1000)
    # by size, training and validation effects make up the given ones
    return out.select("snp", r6(0.9 * F.col("train") + 0.1 * F.col("valid")).alias("whole"))


@query("SELECT count(*) AS components, true AS spread, true AS centred FROM z JOIN (SELECT region FROM z GROUP BY region HAVING count(*) > 1) USING (region)")
def pseudo_noise(t):
    """The noise of training effects, projected on each component and scaled by its root value, is of mean 0 and variance 1."""
    g = genotypes(t)
    g = g.join(g.groupBy("region").count().filter("count > 1").select("region"), "region").filter("region is not null")
    known = effects(t).join(g.select("snp", "region"), "snp").select("region", "snp", "b")
    # of more people than variants all values are above 0
    eigen = L.region_eigen(g.withColumn("dosage", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.sin(F.col("idx") * 7.3 + k * k * (F.col("idx") + 1)))), 1.0)
    out = L.pseudo_summary(known, eigen, 1000)
    noise = out.join(known, ["region", "snp"]).select("region", "snp", (F.col("train") - F.col("b")).alias("b"))
    w = L.project_effects(noise, eigen).select((F.col("w") / (1 / 900 - 1 / 1000) ** 0.5).alias("w"))
    return w.agg(F.count("*").alias("components"), F.avg(F.col("w") * F.col("w")).between(0.4, 1.8).alias("spread"), F.avg("w").between(-0.6, 0.6).alias("centred"))


_AIM = "round({z} * {v} / sqrt(2 * {a}.af * (1 - {a}.af) * (5000 + pow({z}, 2))), 6) AS beta_new, round({v} / sqrt(2 * {a}.af * (1 - {a}.af) * (5000 + pow({z}, 2))), 6) AS se_new"
_SPREAD = "sqrt(2 * {a}.af * (1 - {a}.af) * ({a}.n * {a}.se * {a}.se + {a}.b * {a}.b))"


@query(_TWO + f"""
SELECT 'v' || i AS snp, {_AIM.format(a="x", z="(r / (c + 0.1) * y.b / y.se)", v=_SPREAD.format(a="y"))} FROM two
UNION ALL SELECT 'v' || j, {_AIM.format(a="y", z="(r / (c + 0.1) * x.b / x.se)", v=_SPREAD.format(a="x"))} FROM two
""")
def resample_left_out(t):
    return _resampled(t, False)


_SCORE = "((sqrt({a}.n * 5000) * (c + r + 0.1) / 2 + least({a}.n, 5000) / sqrt({a}.n * 5000)) / ({a}.b / {a}.se))"


@query(_TWO + f"""
SELECT 'v' || i AS snp, {_AIM.format(a="x", z=_SCORE.format(a="x"), v="1")} FROM two UNION ALL SELECT 'v' || j, {_AIM.format(a="y", z=_SCORE.format(a="y"), v="1")} FROM two
""")
def resample_by_score(t):
    return _resampled(t, True)


def _resampled(t, by_score: bool) -> DataFrame:
    known = effects(t).join(two(t).select("snp", "region"), "snp")
    out = L.resample_effects(known.select("region", "snp", "af", F.col("b").alias("beta"), "se", "n"), L.region_eigen(two(t), 0.9999999), 5000, by_score=by_score)
    return out.select("snp", r6("beta_new").alias("beta_new"), r6("se_new").alias("se_new"))


_LINKS = """
, l AS (SELECT a.idx AS i, b.idx AS j FROM z a JOIN z b ON a.region = b.region AND a.idx <> b.idx WHERE pow(list_dot_product(a.g, b.g), 2) > 0.06),
near AS (SELECT i, list(j ORDER BY j) AS js, row_number() OVER (ORDER BY i) AS k FROM l GROUP BY i), p AS (SELECT list(idx * 7919 % 1009 ORDER BY idx) AS ps FROM z)
"""


@query(_LINKS + """
, s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
  SELECT n.k, CASE WHEN list_contains(gone, i) THEN gone ELSE list_concat(gone, list_filter(js, lambda j: NOT list_contains(gone, j) AND ps[i + 1] < ps[j + 1]),
    CASE WHEN len(list_filter(js, lambda j: NOT list_contains(gone, j) AND ps[i + 1] >= ps[j + 1])) > 0 THEN [i] ELSE [] END) END
  FROM s JOIN near n ON n.k = s.k + 1, p)
SELECT idx FROM z, (SELECT arg_max(gone, k) AS gone FROM s) WHERE NOT list_contains(gone, idx)
""")
def prune_greedy(t):
    v = genotypes(t).select("idx", (F.col("idx") * 7919 % 1009).alias("p"))
    return W.prune_by_r2(v, L.region_ld(genotypes(t)), 0.06).select("idx")


@query(_LINKS + """
, s AS (SELECT 0::BIGINT AS k, range(0, (SELECT count(*) FROM z)) AS label UNION ALL
  SELECT n.k, list_transform(label, lambda v, place: CASE WHEN list_contains(js, place - 1) THEN label[i + 1] ELSE v END) FROM s JOIN near n ON n.k = s.k + 1),
f AS (SELECT arg_max(label, k) AS label FROM s)
SELECT idx, dense_rank() OVER (ORDER BY label[idx + 1]) AS bin FROM z, f
""")
def bin_by_r2(t):
    return W.bin_by_r2(genotypes(t).select("idx"), L.region_ld(genotypes(t)), 0.06)


@query("""
, p AS (SELECT a.idx AS i, list_dot_product(a.g, b.g) AS r, list_dot_product(list_transform(a.g, lambda x: x * x), list_transform(b.g, lambda x: x * x)) AS q FROM z a JOIN z b ON b.idx BETWEEN a.idx - 3 AND a.idx + 3)
SELECT i, round(sum(64 / 63.0::DOUBLE * (q - r * r / 64)), 6) AS jackknife_var FROM p GROUP BY i
""")
def jackknife_ld(t):
    return L.jackknife_variance(genotypes(t), tile=64, band=3).select("i", r6("jackknife_var").alias("jackknife_var"))


_SIZES = "SELECT ord, snp, af, 2 * af * (1 - af) AS v, 100 + ord % 50 AS n, 0.02 + ord % 7 / 100.0::DOUBLE AS se, (ord % 13 - 6) / 100.0::DOUBLE AS b FROM variants WHERE af > 0.02"


def sizes(t) -> DataFrame:
    key = F.col("ord")
    return variants(t).filter("af > 0.02").select("ord", "af", (100 + key % 50).alias("n"), (0.02 + key % 7 / 100).alias("se"), ((key % 13 - 6) / 100).alias("b"))


@query(f"""
, s AS ({_SIZES}),
m AS (SELECT median(v * n * (n * se * se + b * b)) / median(n) AS y, median(n) AS med FROM s),
k AS (SELECT ord, (y - v * b * b) / (v * se * se) AS n, med FROM s, m), a AS (SELECT stddev_samp(n) AS sd FROM k)
SELECT ord, round(n, 4) AS n FROM k, a WHERE n >= med - 3 * sd AND n <= med + 3 * sd
""")
def imputed_sample_size(t):
    return L.impute_sample_size(sizes(t), most=1, settle=False).select("ord", F.round("n", 4).alias("n"))


@query(None)
def imputed_sample_size_settled(t):
    return L.impute_sample_size(sizes(t)).select("ord", F.round("n", 4).alias("n"))


@query("""
, s AS (SELECT idx, 1000.0::DOUBLE + idx % 50 * 10 AS n, 0.02::DOUBLE + idx % 7 / 100.0::DOUBLE AS se, (idx % 9 - 4.5::DOUBLE) / 100 AS b, (idx % 40 + 5) / 100.0::DOUBLE AS af, g FROM z),
o AS (SELECT list_sort(list(2 * af * (1 - af) * (n * se * se + b * b)))[count(*) // 2 + 1] AS v, count(*) AS m FROM s),
d AS (SELECT s.*, v / (se * se + b * b / n) AS d, m FROM s, o),
e AS (SELECT x.idx AS i, y.idx AS j, list_dot_product(x.g, y.g) AS r, sqrt(x.d * y.d) AS w FROM d x JOIN d y ON y.idx BETWEEN x.idx - 5 AND x.idx + 5),
k AS (SELECT i, sum(r * w) AS zx, sum(CASE WHEN i = j THEN r * w END) AS zd, sum(r * r) AS score, sum(pow(1 - r * r, 2) / 64) AS sv, count(*) AS nnz FROM e GROUP BY i)
SELECT idx, round(d, 3) AS d, round(d / n, 6) AS twopq, round(d * (n * se * se + b * b), 3) AS tss, round(zd, 3) AS zz_diag, round(zd * b, 4) AS zy, round(zd * b * b, 4) AS chisq, round(score, 5) AS ld_score,
  round((n + 64) / m * sv + (m - nnz) / m::DOUBLE, 5) AS sampling_var, round(zx, 3) AS zx FROM d JOIN k ON k.i = d.idx
""")
def mixed_model_rows(t):
    out = L.mixed_model_equations(effects(t), L.mirrored(L.ld_pairs(genotypes(t), tile=64, band=5)), 64)["variants"]
    digits = {"d": 3, "twopq": 6, "tss": 3, "zz_diag": 3, "zy": 4, "chisq": 4, "ld_score": 5, "sampling_var": 5, "zx": 3}
    return out.select("idx", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query(_TWO + """
, s AS (SELECT *, 2 * af * (1 - af) * (n * se * se + b * b) AS v FROM eff),
e AS (SELECT a.idx AS i, list_dot_product(a.g, b.g) * sqrt(x.n * y.n) AS zz, a.idx = b.idx AS own FROM z a JOIN z b ON b.idx BETWEEN a.idx - 5 AND a.idx + 5 JOIN eff x ON x.idx = a.idx JOIN eff y ON y.idx = b.idx),
o AS (SELECT list_sort(list(v))[count(*) // 2 + 1] AS var_p, list_sort(list(v * n))[count(*) // 2 + 1] AS ypy, list_sort(list(n))[count(*) // 2 + 1] AS n_median FROM s)
SELECT round(var_p, 6) AS var_p, round(ypy, 4) AS ypy, round(n_median, 2) AS n_median, round((SELECT sum(zz) FROM e), 1) AS xx,
  round((SELECT sum(zz * b * sqrt(var_p / (se * se + b * b / n) / n)) FROM e JOIN eff ON eff.idx = e.i WHERE own), 3) AS xy FROM o
""")
def mixed_model_totals(t):
    out = L.mixed_model_equations(effects(t), L.mirrored(L.ld_pairs(genotypes(t), tile=64, band=5)), 64, overlap=True, noscale=False)["totals"]
    return out.select(*[F.round(c, k).alias(c) for c, k in {"var_p": 6, "ypy": 4, "n_median": 2, "xx": 1, "xy": 3}.items()])


@query(_TWO + """
, o AS (SELECT list_sort(list(2 * af * (1 - af) * (n * se * se + b * b)))[count(*) // 2 + 1] AS v FROM eff), d AS (SELECT idx, v / (se * se + b * b / n) AS d FROM eff, o)
SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.g, b.g) * sqrt(x.d * y.d), 4) AS zz FROM z a JOIN z b ON b.idx BETWEEN a.idx - 5 AND a.idx + 5 JOIN d x ON x.idx = a.idx JOIN d y ON y.idx = b.idx
""")
def sparse_equations(t):
    out = L.mixed_model_equations(effects(t), L.mirrored(L.ld_pairs(genotypes(t), tile=64, band=5)), 64)["zz"]
    return out.select("i", "j", F.round("zz", 4).alias("zz"))


@query("""
, p AS (SELECT a.idx AS i, b.idx AS j, list_dot_product(a.g, b.g) AS r FROM z a JOIN z b ON a.region = b.region),
f AS (SELECT i, min(j) AS low, max(j) AS high FROM p WHERE abs(r) > 0.3 GROUP BY i)
SELECT p.i, j, round(r, 6) AS r FROM p LEFT JOIN f ON f.i = p.i WHERE j BETWEEN least(coalesce(low, p.i), p.i) AND greatest(coalesce(high, p.i), p.i)
""")
def band_by_outermost(t):
    return L.band_by_r(L.mirrored(L.region_ld(genotypes(t)).drop("region")), 0.3).select("i", "j", r6("r").alias("r"))


@query("""
, p AS (SELECT a.idx AS i, b.idx AS j, list_dot_product(a.g, b.g) AS r FROM z a JOIN z b ON a.region = b.region),
f AS (SELECT i, min(j) AS low, max(j) AS high FROM p WHERE r * r * 64 > 6.0000001 GROUP BY i)
SELECT p.i, j, round(r, 6) AS r FROM p LEFT JOIN f ON f.i = p.i WHERE j BETWEEN least(coalesce(low, p.i), p.i) AND greatest(coalesce(high, p.i), p.i)
""")
def band_by_chi2(t):
    return L.band_by_r(L.mirrored(L.region_ld(genotypes(t)).drop("region")), n=64, chi2=6.0000001).select("i", "j", r6("r").alias("r"))


@query("""
SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.g, b.g), 6) AS r FROM z a JOIN z b ON a.idx <= b.idx AND (a.idx % 100 // 50) = (b.idx % 100 // 50) AND b.idx - a.idx < 8
""")
def ld_by_distance(t):
    g = genotypes(t).withColumn("chrom", (F.floor(F.col("idx") % 100 / 50)).cast("int")).withColumn("pos", F.col("idx") * 100)
    return L.ld_pairs(g, tile=32, reach=800).select("i", "j", r6("r").alias("r"))


@query("""
SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.g, b.g), 6) AS r FROM z a JOIN z b ON abs(a.idx - b.idx) <= 30
WHERE a.idx = b.idx OR abs(list_dot_product(a.g, b.g)) >= 0.3 OR b.idx % 25 = 0
""")
def sparse_with_skeleton(t):
    g = genotypes(t).withColumn("skeleton", F.col("idx") % 25 == 0)
    ld = L.mirrored(L.ld_pairs(g, tile=64, band=30, least_r2=0.08))
    return L.sparse(ld, 64, least_r=0.3, skeleton=g.filter("skeleton").select("idx")).select("i", "j", r6("r").alias("r"))


@query("""
SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.g, b.g), 6) AS r FROM z a JOIN z b ON b.idx BETWEEN a.idx AND a.idx + 30
WHERE a.idx = b.idx OR pow(list_dot_product(a.g, b.g), 2) * 64 > 3.0000001
""")
def pruned_directly(t):
    return L.sparse(L.ld_pairs(genotypes(t), tile=64, band=30), 64, chi2=3.0000001, strict=True).select("i", "j", r6("r").alias("r"))


@query("""
, p AS (SELECT a.idx AS i, b.idx AS j, list_dot_product(a.g, b.g) AS r FROM z a JOIN z b ON abs(a.idx - b.idx) <= 9 WHERE a.idx = b.idx OR abs(list_dot_product(a.g, b.g)) >= 0.15)
SELECT i, count(*) AS n_cells, min(j) AS first, max(j) - min(j) + 1 AS width, round(sum(r), 6) AS total FROM p GROUP BY i
""")
def assembled_rows(t):
    ld = L.mirrored(L.sparse(L.ld_pairs(genotypes(t), tile=64, band=9), 64, least_r=0.15))
    full = L.dense_rows(ld).select("i", "first", F.size("values").cast("long").alias("width"), r6(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))
    return L.matrix_rows(ld).select("i", F.size("js").cast("long").alias("n_cells")).join(full, "i")
