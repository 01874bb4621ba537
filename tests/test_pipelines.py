import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.errors import EngineError
from locusframe.plans import pipelines as P
from locusframe.sinks import writers as K


@pytest.fixture(scope="module")
def study(spark):
    genes = spark.createDataFrame([(f"g{i}", 1, float(100 * i), i, 500) for i in range(4)], "gene_id string, chrom int, mid double, ord long, n long")
    variants = spark.createDataFrame([(f"s{i}", 1, 30 * i, "A", "G", 0.25, i) for i in range(12)], "snp string, chrom int, pos int, a1 string, a2 string, af double, ord long")
    pairs = spark.createDataFrame([(f"g{i}", f"s{j}", 0.5 * (j % 3), 0.1, 500) for i in range(4) for j in range(i, 12, 2)], "gene_id string, snp string, beta double, se double, n long")
    return {"genes": genes, "variants": variants, "pairs": pairs}


def test_select_and_export(spark, study, tmp_path):
    strong = P.select_study(study, max_p=1e-5, without_genes=study["genes"].filter("gene_id = 'g0'"))
    assert {r.gene_id for r in strong["genes"].collect()} == {"g1", "g2", "g3"}
    assert strong["pairs"].filter("beta = 0").count() == 0
    listed = P.export_study(strong, "besd", str(tmp_path / "b"), parts=2)
    back = P.merge_study_files(spark, [r.name for r in listed.collect()])
    assert sorted((r.gene_id, r.snp, r.beta) for r in back["pairs"].collect()) == sorted((r.gene_id, r.snp, r.beta) for r in strong["pairs"].collect())
    for kind in ("query", "sumstats", "annotation"):
        P.export_study(strong, kind, str(tmp_path / kind))
    assert P.load_study(spark, "query", str(tmp_path / "query"))["pairs"].count() == strong["pairs"].count()
    assert P.export_study(strong, "ma", str(tmp_path / "ma"), array_limit=2).agg(F.max("chunk")).first()[0] == 1
    with pytest.raises(EngineError):
        P.select_study(study, gene="nobody")
    with pytest.raises(EngineError):
        P.export_study(study, "nothing", "")


def test_genotypes_to_eigen(spark, tmp_path):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, (20, 30))
    (tmp_path / "x.bed").write_bytes(K.bed_bytes(g.tolist()))
    (tmp_path / "x.bim").write_text("".join(f"1 s{i} {i / 10} {100 * i} A G\n" for i in range(20)))
    (tmp_path / "x.fam").write_text("".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(30)))
    rows = P.load_genotypes(spark, str(tmp_path / "x"), exclude=spark.createDataFrame([("s3",)], "snp string"))
    assert rows.count() == 19
    few = P.load_genotypes(spark, str(tmp_path / "x"), keep=spark.createDataFrame([("f2", "i2"), ("f5", "i5")], "fid string, iid string"))
    assert few.orderBy("idx").first().dosage == g[0, [2, 5]].tolist()
    blocks = spark.createDataFrame([(0, "a", 1, 0, 900), (1, "b", 1, 900, 5000)], "ord long, block_id string, chrom int, start long, end long")
    eigen = {r.region: r for r in P.build_block_eigen(rows, blocks, 0.999999).collect()}
    assert eigen["a"].m == 9 and eigen["b"].m == 10
    u = np.array(eigen["b"].vectors).reshape(eigen["b"].k, 10)
    assert np.allclose(u.T * eigen["b"]["values"] @ u, np.corrcoef(g[10:]) * 29 / 30, atol=1e-4)
    full = P.build_ld(rows).count()
    assert full == 19 * 20 / 2
    assert 19 <= P.build_ld(rows, "sparse", 30, chi2=4).count() < full
    assert P.build_ld(rows, "band", width=500).count() == sum(1 for i in range(20) for j in range(i, 20) if 3 not in (i, j) and j - i <= 2)
    assert P.build_ld(rows, "shrunk").filter("i = j and abs(r - 1) > 0.05").count() == 0
    pairs = spark.createDataFrame([("g", f"s{i}") for i in range(5)], "gene_id string, snp string")
    assert P.build_gene_eigen(rows, pairs).first().m == 4
