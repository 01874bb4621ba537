import gzip

import numpy as np
import pytest

from locusframe.errors import EngineError
from locusframe.operators import ld as L
from locusframe.sinks import writers as K
from locusframe.sources import binary as B
from locusframe.sources import text as R
from pyspark.sql import functions as F


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text(text)
    return str(path)


def test_people_and_variants(spark, tmp_path):
    fam = put(tmp_path, "a.fam", "f1 i1 0 0 1 -9\nf2\ti2 0 0 2 1.5\n")
    assert [tuple(r) for r in R.read_fam(spark, fam).orderBy("ord").select("iid", "sex", "phen").collect()] == [("i1", 1, None), ("i2", 2, "1.5")]
    bim = put(tmp_path, "a.bim", "22 rs1 0.1 100 A G\n22 rs1 0.2 200 C T\n")
    with pytest.raises(EngineError):
        R.read_bim(spark, bim)
    pheno = put(tmp_path, "p.txt", "FID IID a b\nf1 i1 1.5 NA\nf2 i2 -9 2\n")
    assert [tuple(r) for r in R.read_phenotype(spark, pheno).collect()] == [("f1", "i1", 1.5)]
    assert [tuple(r) for r in R.read_phenotype(spark, pheno, 2).collect()] == [("f2", "i2", 2.0)]
    names, rows = R.read_covariates(spark, pheno)
    assert names == ["intercept", "a", "b"] and rows.count() == 2


def test_pair_list(spark, tmp_path):
    head = "Chr SNP Bp A1 A2 Freq Beta se p\n"
    put(tmp_path, "gene/g1.esd", head + "1 s1 10 A G 0.2 0.1 0.05  0.04\n1 s2 20 C T 0.3 0.2 0.05 0.01\n")
    put(tmp_path, "gene/g2.esd", head + "1 s2 21 T C 0.7 0.4 0.05 0.01\n")
    flist = put(tmp_path, "x.flist", "Chr ProbeID GeneticDistance ProbeBp Gene N Orientation PathOfEsd\n1 G1 -999 15 N1 100 NA gene/g1.esd\n1 G2 0 20 N2 200 + gene/g2.esd\n")
    out = R.read_flist(spark, flist, str(tmp_path))
    assert out["pairs"].count() == 3
    first = out["variants"].filter("snp = 's2'").first()
    assert (first.pos, first.a1, first.af) == (20, "C", 0.3)
    assert {r.gene_id: r.gen_dist for r in out["genes"].collect()} == {"G1": None, "G2": 0.0}
    put(tmp_path, "gene/g2.esd", head + "1 s2 21 T C\n")
    with pytest.raises(EngineError):
        R.read_flist(spark, flist, str(tmp_path))


def test_esi_epi_sizes(spark, tmp_path):
    esi = R.read_esi(spark, put(tmp_path, "a.esi", "X s1 NA 10 a g 0.5\n0 s2 0 -9 NA t NA 100\n")).orderBy("ord").collect()
    assert (esi[0].chrom, esi[0].gen_pos, esi[0].a1, esi[0].n) == (23, None, "A", None)
    assert (esi[1].chrom, esi[1].pos, esi[1].a1, esi[1].af, esi[1].n) == (None, None, None, None, 100)
    epi = R.read_epi(spark, put(tmp_path, "a.epi", "22 G1 -999 500 P1 NA\n22 G2 0.5 600 P2 1000 +\n")).orderBy("ord").collect()
    assert [(r.gen_dist, r.n, r.orientation) for r in epi] == [(None, None, "NA"), (0.5, 1000, "+")]
    sizes = R.read_gene_sizes(spark, put(tmp_path, "g.gsam", "G1 100\nG2 200\n"))
    assert {r.gene_id: r.n for r in sizes.collect()} == {"G1": 100, "G2": 200}


def test_query_round_trip(spark, tmp_path):
    variants = spark.createDataFrame([("s1", 1, 10, "A", "G", 0.25), ("s2", 1, 20, "C", "T", 0.5)], "snp string, chrom int, pos int, a1 string, a2 string, af double")
    genes = spark.createDataFrame([("g", 1, 15.0, 300)], "gene_id string, chrom int, mid double, n long")
    pairs = spark.createDataFrame([("g", "s1", 0.1, 0.05, None), ("g", "s2", 0.0000002, 0.5, 70)], "gene_id string, snp string, beta double, se double, n long")
    K.write_query(pairs, variants, genes, str(tmp_path / "q"))
    back = R.read_query(spark, str(tmp_path / "q"))
    got = {r.snp: r for r in back["pairs"].collect()}
    assert got["s1"].n == 300 and got["s2"].n == 70 and got["s2"].beta == pytest.approx(2e-7) and got["s1"].p == pytest.approx(0.0455, abs=1e-4)
    gene = back["genes"].first()
    assert gene.n_mean == 185 and gene.n_sd == pytest.approx(115) and gene.has_pairs
    with gzip.open(tmp_path / "bad.gz", "wt") as f:
        f.write("GeneID\tX\n1\t2\n")
    with pytest.raises(EngineError):
        R.read_query(spark, str(tmp_path / "bad.gz"))


def test_bed_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    g = rng.integers(-1, 3, (9, 13))
    (tmp_path / "a.bed").write_bytes(K.bed_bytes(g.tolist()))
    v = spark.createDataFrame([(f"s{i}", i) for i in range(9)], "snp string, file_idx long")
    got = B.read_bed(str(tmp_path / "a.bed"), v, 13).orderBy("file_idx").collect()
    assert [[-1 if x is None else x for x in r.dosage] for r in got] == g.tolist()
    stats = B.genotype_stats(B.read_bed(str(tmp_path / "a.bed"), v, 13)).orderBy("file_idx").first()
    known = g[0][g[0] >= 0]
    assert stats.af == pytest.approx(known.mean() / 2)
    (tmp_path / "b.bed").write_bytes(b"abc")
    with pytest.raises(EngineError):
        B.read_bed(str(tmp_path / "b.bed"), v, 13)


def test_besd_round_trip(spark, tmp_path):
    variants = spark.createDataFrame([(f"s{i}", 1, i * 10, "A", "G", 0.25) for i in range(6)], "snp string, chrom int, pos int, a1 string, a2 string, af double")
    genes = spark.createDataFrame([(f"g{i}", 1, 15.0, i) for i in range(3)], "gene_id string, chrom int, mid double, ord long")
    pairs = spark.createDataFrame([(f"g{i}", f"s{j}", i + j / 8, 0.5) for i in range(3) for j in range(i, 6, 2)], "gene_id string, snp string, beta double, se double")
    names = [r.name for r in K.write_besd(pairs, variants, genes, str(tmp_path / "out"), 2).collect()]
    got = set()
    for n in names:
        rows = B.read_besd(spark, n + ".besd", R.read_esi(spark, n + ".esi"), R.read_epi(spark, n + ".epi"))
        got |= {tuple(r) for r in rows.collect()}
    assert got == {tuple(r) for r in pairs.collect()}


def test_besd_dense(spark, tmp_path):
    data = np.array([[1, 2, 3, 0.1, -9, 0.3], [4, 5, 6, 0.4, 0.5, 0.6]], "<f4")
    (tmp_path / "d.besd").write_bytes(np.array([0], "<u4").tobytes() + data.tobytes())
    esi = spark.createDataFrame([(f"s{i}", i) for i in range(3)], "snp string, ord long")
    epi = spark.createDataFrame([("g0", 0), ("g1", 1)], "gene_id string, ord long")
    got = B.read_besd(spark, str(tmp_path / "d.besd"), esi, epi)
    assert sorted((r.gene_id, r.snp, r.beta) for r in got.collect()) == [("g0", "s0", 1), ("g0", "s2", 3), ("g1", "s0", 4), ("g1", "s1", 5), ("g1", "s2", 6)]


def test_eigen_round_trip(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, f"s{i}", "ab"[i % 2], rng.normal(size=30).tolist()) for i in range(10)]
    g = spark.createDataFrame(rows, "idx long, snp string, region string, dosage array<double>")
    e = L.region_eigen(g, 0.9).persist()
    K.write_eigen(e, str(tmp_path / "e")).collect()
    members = g.select("region", F.lit(0).alias("region_ord"), "snp", F.col("idx").alias("ord"))
    back = {r.region: r for r in B.read_eigen(spark, str(tmp_path / "e"), members).collect()}
    for r in e.collect():
        assert back[r.region].snps == r.snps and np.allclose(back[r.region].vectors, r.vectors, atol=1e-6) and back[r.region].k == r.k


def test_ld_sets(spark, tmp_path):
    cells = [(0, 0, 1.0), (0, 1, 0.5), (1, 1, 1.0), (1, 2, 0.25), (2, 2, 0.9), (2, 4, 0.1), (3, 3, 1.0), (4, 4, 1.1)]
    ld = L.mirrored(spark.createDataFrame(cells, "i long, j long, r double"))
    v = spark.createDataFrame([(i, f"s{i}", 1, i / 10, 10 * i, "A", "G", 0.25) for i in range(5)], "idx long, snp string, chrom int, gen_pos double, pos int, a1 string, a2 string, af double")
    want = {tuple(r) for r in ld.collect()}
    for kind, parts in (("sparse", 1), ("sparse", 2), ("full", 3)):
        names = [r.name for r in K.write_ld(ld, v, 50, str(tmp_path / f"{kind}{parts}"), kind, parts).orderBy("part").collect()]
        info, back = B.read_ld_set(spark, names)
        got = {tuple(r) for r in back.collect()}
        assert len(names) == parts and {c for c in got if c[2]} == want and (kind == "full" or got == want)
        assert {(r.idx, r.window_start) for r in info.collect()} == {(0, 0), (1, 0), (2, 1), (3, 3), (4, 2)}
    # shards that begin at 0 again are moved behind one another
    both = [K.write_ld(ld.filter("i < 2 and j < 2"), v.filter("idx < 2"), 50, str(tmp_path / "again"), "sparse").first().name for _ in range(2)]
    assert {tuple(r) for r in B.read_ld_set(spark, both)[1].collect()} == {(i + k, j + k, r) for k in (0, 2) for i, j, r in want if i < 2 and j < 2}
    bad = K.write_ld(ld.withColumn("r", F.lit(0.1)), v, 50, str(tmp_path / "bad"), "sparse").first().name
    with pytest.raises(EngineError):
        B.read_ld_set(spark, [bad])


def test_ld_info_must_fit(spark, tmp_path):
    info = R.read_ld_info(spark, put(tmp_path, "x.info", "Chrom ID GenPos PhysPos A1 A2 A1Freq Index WindStart WindEnd WindSize WindWidth N SamplVar LDsum\n1 s1 0 5 A G 0.5 1 0 2 3 10 50 0.1 0.2\n"))
    v = spark.createDataFrame([("s0", 0), ("s1", 1)], "snp string, idx long")
    assert {r.snp: r.window_size for r in R.with_ld_info(v, info).collect()} == {"s0": None, "s1": 3}
    for wrong in (v.filter("idx = 0"), v.withColumn("idx", F.col("idx") + 1)):
        with pytest.raises(EngineError):
            R.with_ld_info(wrong, info)


def test_eigen_info_must_fit(spark, tmp_path):
    snps = "Chrom ID GenPos PhysPos A1 A2 A1Freq N\n1 s1 0 5 A G 0.5 50\n1 s2 0 6 A G 0.5 50\n"
    head = "Chrom LDBLOCK start end snpInLdBlock NumSnpInLdBlock\n"
    cases = {"good": "1 b 0 9 s1 2\n1 b 0 9 s2 2\n", "twice": "1 b 0 9 s1 2\n1 b 0 9 s1 2\n", "lost": "1 b 0 9 s1 2\n1 b 0 9 s3 2\n", "short": "1 b 0 9 s1 2\n"}
    for name, members in cases.items():
        put(tmp_path, f"{name}.eigen.ldblock.info", head + members)
        prefix = put(tmp_path, f"{name}.eigen.ldblock.snp.info", snps).removesuffix(".eigen.ldblock.snp.info")
        if name == "good":
            assert R.read_eigen_info(spark, [prefix])[0].count() == 2
        else:
            with pytest.raises(EngineError):
                R.read_eigen_info(spark, [prefix])


def test_maps(spark, tmp_path):
    kept, twice = R.read_rsid_map(spark, put(tmp_path, "m.txt", "ID A2 A1 RSID P19 P38\n1:5:A:G A G rs1 5 6\n1:7:A:G A G rs2 7 8\n1:9:A:C A C rs2 9 10\n"), 38)
    assert [(r.rsid, r.chrom, r.pos) for r in kept.collect()] == [("rs1", 1, 6)] and twice.count() == 2
    numbered, odd = R.read_protein_map(spark, put(tmp_path, "p.txt", "gene\tchr\tstart\tend\tdir\nA\t1\t5\t9\tx\nB\tX\t5\t9\ty\n"))
    assert numbered.first().gene_id == "A" and odd.first().gene_id == "B"
