import math
import statistics

import numpy as np
import pandas as pd
import pytest

from locusframe.errors import EngineError, require_rows, require_unique
from locusframe.functions import matrices as X
from locusframe.functions import scalar as S
from locusframe.operators import aggregates as A
from locusframe.operators import filters as C
from locusframe.operators import ld as L
from locusframe.operators import merges as H
from locusframe.operators import windows as W
from locusframe.operators.joins import map_to_blocks, nearest_at_or_after
from pyspark.sql import functions as F


def test_chi2_cut_and_tail_agree(spark):
    cut = S.chi2_cut(1e-5)
    assert cut == pytest.approx(19.511421, abs=1e-5)
    got = spark.createDataFrame([(cut,), (0.0,), (1400.0,), (None,)], "x double").select(S.chi2_tail(F.col("x")).alias("p")).toPandas()["p"]
    assert got[0] == pytest.approx(1e-5) and got[1] == 1 and 0 < got[2] < 1e-300 and math.isnan(got[3])


def test_scalars(spark):
    rows = spark.createDataFrame([("a b,,c", "/x/y.tar.gz", "x", "0.00000012"), ("", "plain", "NA", "1.5")], "t string, f string, c string, v string")
    out = rows.select(S.tokens(F.col("t")), S.file_stem(F.col("f")), S.file_suffix(F.col("f")), S.chromosome(F.col("c")), S.number_text(F.col("v").cast("double"), 3, 2)).collect()
    assert [tuple(r) for r in out] == [(["a", "b", "c"], "y.tar", "gz", 23, "1.20e-07"), ([], "plain", "", None, "1.500")]
    assert S.elapsed_text(3725) == "1:2:5"


@pytest.mark.parametrize("n", [1000, 300_000])
def test_reindex_is_dense_over_partitions(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        key = F.col("id") * 7919 % n
        rows = spark.range(n).select(F.floor(key / 100).alias("a"), (key % 100).alias("b"), F.sha2(key.cast("string"), 256).alias("text"), F.array(key).alias("k")).repartition(16)
        out = C.reindex(rows, "a", "b")
        assert out.count() == n and out.filter(F.col("idx") != F.get("k", F.lit(0))).isEmpty()
        sums = C.running_sum(rows, ("a", "b"), F.col("b"), "before")
        late = sums.orderBy(F.desc("a"), F.desc("b")).first()
        assert late.before == sum(range(100)) * (n // 100) - 99
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_medians(spark):
    rng = np.random.default_rng(11)
    for n in (1, 2, 5, 1000):
        x = rng.normal(size=n)
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
        assert A.exact_median(rows, "x") == pytest.approx(np.median(x)) and A.exact_median(rows, "x", upper=True) == np.sort(x)[n // 2]
        assert rows.agg(A.upper_median("x")).first()[0] == np.sort(x)[n // 2]
    assert A.exact_median(spark.createDataFrame([], "x double"), "x") is None


def test_guards(spark):
    rows = spark.createDataFrame([("a",), ("a",)], "snp string")
    with pytest.raises(EngineError):
        require_unique(rows, "snp")
    with pytest.raises(EngineError):
        require_rows(rows.filter("snp = 'b'"), "variants")


def test_block_border_goes_to_the_first(spark):
    blocks = spark.createDataFrame([(0, "x", 1, 0, 10), (1, "y", 1, 10, 20)], "ord long, block_id string, chrom int, start long, end long")
    variants = spark.createDataFrame([(f"v{p}", 1, p) for p in (0, 10, 11, 20, 21)], "snp string, chrom int, pos long")
    got = {r.snp: r.block_id for r in map_to_blocks(variants, blocks).collect()}
    assert got == {"v0": "x", "v10": "x", "v11": "y", "v20": "y"}


def test_nearest_looks_beyond_empty_bins(spark):
    asked = spark.createDataFrame([(1, 1, 5), (2, 1, 950), (3, 2, 1), (4, 1, 5001)], "qid long, chrom int, at long")
    points = spark.createDataFrame([("a", 1, 3), ("b", 1, 900), ("c", 1, 5000)], "snp string, chrom int, pos long")
    got = {r.qid: r.snp for r in nearest_at_or_after(asked, points, 100).collect()}
    assert got == {1: "b", 2: "c", 3: None, 4: None}


def test_ld_tiles_equal_one_product(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (23, 40)).astype(float)
    rows = spark.createDataFrame([(i, g[i].tolist()) for i in range(23)], "idx long, dosage array<double>")
    got = L.ld_pairs(rows, tile=5).toPandas()
    want = np.corrcoef(g) * 39 / 40
    assert len(got) == 23 * 24 / 2
    assert np.allclose(got["r"], want[got["i"], got["j"]])
    band = L.ld_pairs(rows, tile=4, band=6).toPandas()
    assert len(band) == sum(min(7, 23 - i) for i in range(23))


def test_ld_missing_and_constant(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0, None, 2.0]), (1, [1.0] * 4)], "idx long, dosage array<double>")
    got = L.ld_pairs(rows).toPandas().set_index(["i", "j"])["r"]
    assert got[0, 0] == pytest.approx(0.75) and got[0, 1] == 0 and got[1, 1] == 0


def test_truncation_keeps_the_fewest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        values = np.sort(rng.exponential(size=rng.integers(1, 9)))
        cutoff = rng.uniform(0.1, 1)
        k = L.truncate(values, values.sum(), cutoff)
        assert values[-k:].sum() / values.sum() > cutoff or k == len(values)
        assert k == 1 or values[-(k - 1) :].sum() / values.sum() <= cutoff


def test_decompose_rebuilds():
    rng = np.random.default_rng(3)
    r = np.corrcoef(rng.normal(size=(6, 50)))
    values, vectors, total = L.decompose(r, 0.999999)
    assert total == pytest.approx(6) and np.allclose(vectors * values @ vectors.T, r, atol=1e-5)


def test_imputation_recovers_a_copy():
    r = np.array([[1, 0.999, 0.1], [0.999, 1, 0.1], [0.1, 0.1, 1]])
    rows = pd.DataFrame({"beta": [0.5, np.nan, 0.0], "se": [0.1, np.nan, 0.1], "n": [1e3, np.nan, 1e3], "af": [0.3] * 3, "typed": [True, False, True], "p": np.nan})
    out = L.impute_region(rows, np.linalg.cholesky(r).T, delta=1e-6)
    assert out["imputed"].tolist() == [False, True, False]
    assert out["beta"][1] / out["se"][1] == pytest.approx(5, rel=0.02)


def test_leave_one_out_matches_the_long_way():
    rng = np.random.default_rng(4)
    r = np.corrcoef(rng.normal(size=(5, 30)))
    rows = pd.DataFrame({"beta": rng.normal(size=5), "se": 0.1, "n": 500.0, "af": 0.4})
    z = (rows["beta"] / rows["se"]).to_numpy()
    out = L.resample_region(rows, np.linalg.cholesky(r).T, 1000)
    for k in range(5):
        o = [i for i in range(5) if i != k]
        want = r[k, o] @ np.linalg.solve(r[np.ix_(o, o)] + 0.1 * np.eye(4), z[o])
        v = np.sort(0.48 * (500 * 0.01 + rows["beta"].to_numpy()[o] ** 2))[2]
        assert out["beta_new"][k] / out["se_new"][k] == pytest.approx(want)
        assert out["se_new"][k] == pytest.approx(np.sqrt(v / 0.48 / (1000 + want**2)))


@pytest.mark.parametrize("people", [120, 900])
def test_eigen_basis_equals_dense_solutions(people):
    """Regions of 300 variants, of fewer and of more components than typed variants."""
    rng = np.random.default_rng(people)
    g = rng.normal(size=(300, people)) + rng.normal(size=(1, people))
    values, vectors, total = L.decompose_genotypes(list(g), 0.999999999)
    r = L.correlation(list(g))
    dense, _ = np.linalg.eigh(r)
    k = len(values)
    assert np.allclose(values, dense[-k:]) and total == pytest.approx(dense[dense > 1e-10].sum())
    assert np.allclose(vectors @ vectors.T @ r, r, atol=1e-8) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-8)
    a = np.sqrt(values)[:, None] * vectors.T
    typed = rng.random(300) < 0.6
    rows = pd.DataFrame({"beta": np.where(typed, rng.normal(size=300), np.nan), "se": 0.1, "n": 500.0, "af": 0.4, "typed": typed, "p": np.nan})
    out = L.impute_region(rows, a)
    z = (rows["beta"] / rows["se"]).to_numpy()[typed]
    want = r[np.ix_(~typed, typed)] @ np.linalg.solve(r[np.ix_(typed, typed)] + 0.1 * np.eye(typed.sum()), z)
    assert np.allclose((out["beta"] / out["se"])[~typed], want)
    rows["beta"] = rng.normal(size=300)
    z, inverse = (rows["beta"] / rows["se"]).to_numpy(), np.linalg.inv(r + 0.1 * np.eye(300))
    out = L.resample_region(rows, a, 1000)
    assert np.allclose(out["beta_new"] / out["se_new"], z - inverse @ z / np.diag(inverse))
    score = np.sqrt(500 * 1000) * (r.sum(axis=0) + 0.1) / 300 + 500 / np.sqrt(500 * 1000)
    assert np.allclose(L.rescale_region(rows, a, 1000)["beta_new"] / L.rescale_region(rows, a, 1000)["se_new"], score / z)


def test_few_typed_variants_of_many_components():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 60)) / 7
    r, typed = a.T @ a, np.arange(60) < 8
    rows = pd.DataFrame({"beta": np.where(typed, 0.3, np.nan), "se": 0.1, "n": 500.0, "af": 0.4, "typed": typed, "p": np.nan})
    out = L.impute_region(rows, a)
    want = r[np.ix_(~typed, typed)] @ np.linalg.solve(r[np.ix_(typed, typed)] + 0.1 * np.eye(8), np.full(8, 3.0))
    assert np.allclose((out["beta"] / out["se"])[~typed], want)


def brute_prune(p, r, threshold):
    n = len(p)
    stands = [True] * n
    for i in range(n):
        if not stands[i]:
            continue
        for j in range(n):
            if stands[j] and i != j and r[i, j] ** 2 > threshold:
                if p[i] < p[j]:
                    stands[j] = False
                else:
                    stands[i] = False
    return [i for i in range(n) if stands[i]]


def brute_bins(r, threshold):
    n = len(r)
    label = list(range(n))
    for i in range(n):
        for j in range(n):
            if r[i, j] ** 2 > threshold:
                label[j] = label[i]
    place = {v: k + 1 for k, v in enumerate(sorted(set(label)))}
    return [place[v] for v in label]


def test_greedy_scans(spark):
    rows = spark.createDataFrame([(f"v{p}", c, p) for c in (1, 2) for p in (0, 5, 10, 11, 21, 22)], "snp string, chrom int, pos long")
    assert [r.window for r in W.tumbling_windows(rows, 10).orderBy("chrom", "pos").collect()] == [0, 0, 0, 1, 1, 2, 3, 3, 3, 4, 4, 5]
    v = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.9)], "idx long, p double")
    chain = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9)], "i long, j long, r double")
    assert sorted(r.idx for r in W.prune_by_r2(v, chain, 0.5).collect()) == [0, 2]
    fork = spark.createDataFrame([(0, 2, 0.9), (1, 2, 0.9)], "i long, j long, r double")
    assert {r.bin for r in W.bin_by_r2(v, fork, 0.5).collect()} == {1}


def test_greedy_scans_brute_force(spark):
    rng = np.random.default_rng(12)
    r = np.corrcoef(rng.normal(size=(40, 12)))
    p = rng.integers(0, 15, 40) / 15
    rows = spark.createDataFrame([(i, float(p[i])) for i in range(40)], "idx long, p double")
    ld = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(40) for j in range(i, 40)], "i long, j long, r double")
    for threshold in (0.2, 0.35, 0.9):
        assert sorted(x.idx for x in W.prune_by_r2(rows, ld, threshold).collect()) == brute_prune(p, r, threshold)
        assert [x.bin for x in W.bin_by_r2(rows, ld, threshold).orderBy("idx").collect()] == brute_bins(r, threshold)


def test_window_bins_meet_at_their_borders(spark):
    rng = np.random.default_rng(13)
    pos = np.sort(rng.integers(-3000, 20_000, 300))
    rows = spark.createDataFrame([(1, int(p), k) for k, p in enumerate(pos)], "chrom int, pos long, idx long")
    for r in W.window_info(rows, 900).collect():
        near = np.flatnonzero(np.abs(pos - r.pos) < 450)
        assert (r.window_start, r.window_end, r.window_size) == (near[0], near[-1], len(near))


def test_jackknife_brute_force(spark):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(3, 12))
    rows = spark.createDataFrame([(i, g[i].tolist()) for i in range(3)], "idx long, dosage array<double>")
    z = L.standardised(list(g))
    want = np.zeros(3)
    for i in range(3):
        for j in range(3):
            left = (z[i] @ z[j] - z[i] * z[j]) * 12 / 11
            want[i] += ((left - left.mean()) ** 2).sum() * 11 / 12
    got = L.jackknife_variance(rows, tile=2).orderBy("i").toPandas()["jackknife_var"]
    assert np.allclose(got, want)


def test_sample_sizes_settle_as_by_hand(spark):
    rng = np.random.default_rng(14)
    k = 200
    af, n, se, b = rng.uniform(0.1, 0.9, k), rng.integers(500, 600, k).astype(float), rng.uniform(0.04, 0.06, k), rng.normal(0, 0.02, k)
    rows = spark.createDataFrame([(i, float(af[i]), float(n[i]), float(se[i]), float(b[i])) for i in range(k)], "i long, af double, n double, se double, b double")
    left, size, sd = np.arange(k), n.copy(), 0.0
    while True:
        tpq = 2 * af[left] * (1 - af[left])
        b2, var = b[left] ** 2, se[left] ** 2
        new = (np.median(tpq * size**2 * var + tpq * size * b2) / np.median(size) - tpq * b2) / (tpq * var)
        middle, before, sd = np.median(size), sd, new.std(ddof=1)
        stay = (new >= middle - 3 * sd) & (new <= middle + 3 * sd)
        left, size = left[stay], new[stay]
        if abs(sd - before) <= 0.01:
            break
    got = L.impute_sample_size(rows).orderBy("i").toPandas()
    assert got["i"].tolist() == left.tolist() and np.allclose(got["n"], size)
    with pytest.raises(EngineError):
        L.impute_sample_size(rows, most=1)


def test_tiles_by_distance(spark):
    rng = np.random.default_rng(15)
    n = 90
    g, chrom, pos = rng.normal(size=(n, 20)), np.repeat([1, 2], 45), np.concatenate([np.sort(rng.integers(0, 3000, 45)) for _ in range(2)])
    rows = spark.createDataFrame([(i, int(chrom[i]), int(pos[i]), g[i].tolist()) for i in range(n)], "idx long, chrom int, pos long, dosage array<double>")
    for reach in (1, 200, 10_000):
        got = {(r.i, r.j) for r in L.ld_pairs(rows, tile=7, reach=reach).collect()}
        assert got == {(i, j) for i in range(n) for j in range(i, n) if chrom[i] == chrom[j] and abs(pos[i] - pos[j]) < reach}


def test_region_tiles_equal_one_product(spark):
    rng = np.random.default_rng(16)
    g = rng.normal(size=(31, 15))
    rows = spark.createDataFrame([("b" if i else "a", i, g[i].tolist()) for i in range(31)], "region string, idx long, dosage array<double>")
    got = L.region_ld(rows, tile=6).toPandas()
    want = np.corrcoef(g) * 14 / 15
    assert got[got["region"] == "a"]["r"].tolist() == [1.0]
    rest = got[got["region"] == "b"]
    assert len(rest) == 30 * 31 / 2 and (rest["i"] <= rest["j"]).all() and np.allclose(rest["r"], want[rest["i"], rest["j"]])


def test_no_variation_is_an_error(spark):
    rows = spark.createDataFrame([("a", [0, 1]), ("b", [1, 1])], "snp string, dosage array<int>")
    with pytest.raises(EngineError, match="b"):
        C.require_polymorphic(rows)
    assert C.require_polymorphic(rows.filter("snp = 'a'")).count() == 1


def test_functions_against_the_standard_library(spark):
    x = [-30.0, -5.0, -0.4, 0.0, 1e-9, 0.3, 0.46875, 0.5, 2.0, 3.99, 4.0, 4.01, 10.0, 26.0, 30.0]
    p = [1e-300, 1e-12, 0.01, 0.075, 0.2, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(v, p[k % len(p)]) for k, v in enumerate(x)], "x double, p double")
    normal = statistics.NormalDist()
    for r in rows.select("x", "p", S.erfc(F.col("x")).alias("e"), S.normal_cdf(F.col("x")).alias("c"), S.normal_quantile(F.col("p")).alias("q"), S.p_from_z(F.col("x")).alias("z"), S.se_from_p(F.lit(2.0), F.col("p")).alias("s")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-13) and r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-13)
        assert r.q == pytest.approx(normal.inv_cdf(r.p), rel=1e-12, abs=1e-14) and r.z == pytest.approx(math.erfc(abs(r.x) / math.sqrt(2)), rel=1e-13)
        # near 0 the quantile is p sqrt(pi / 2)
        assert r.s == pytest.approx(2 / normal.inv_cdf((1 + r.p) / 2) if r.p > 1e-3 else 2 / (r.p * math.sqrt(math.pi / 2)), rel=1e-4)
    odd = spark.createDataFrame([(0.0,), (1.0,), (None,), (2.0,)], "p double").select(S.se_from_p(F.lit(1.0), F.col("p")).alias("s"), S.normal_quantile(F.col("p")).alias("q")).collect()
    assert [r.s for r in odd] == [None, 1e10, None, None] and [r.q for r in odd] == [None] * 4


def test_matrices(spark):
    m = spark.createDataFrame([(1.0, 2.0, 2.0, 1.0), (2.0, 0.5, 0.5, 1.0), (1.0, 2.0, 0.0, 1.0), (-1.0, 0.0, 0.0, -1.0)], "a double, b double, c double, d double")
    cells = [F.col(c) for c in "abcd"]
    fixed = X.make_positive_definite(*cells)
    out = m.select(X.is_symmetric(cells[1], cells[2]), X.is_positive_definite(*cells), *fixed.values()).collect()
    assert [tuple(r)[:2] for r in out] == [(True, False), (True, True), (False, False), (True, False)]
    for r, row in zip(out, m.collect(), strict=True):
        whole = np.array([[row.a, (row.b + row.c) / 2], [(row.b + row.c) / 2, row.d]])
        values, vectors = np.linalg.eigh(whole)
        want = vectors * np.where(values > 0, values, 1e-6) @ vectors.T
        assert np.allclose([r[2], r[3], r[4]], [want[0, 0], want[0, 1], want[1, 1]], atol=1e-12)


def test_merge_keeps_first(spark):
    g = spark.createDataFrame([("a", 1, 10)], "gene_id string, ord long, mid long")
    v = spark.createDataFrame([("s", 1)], "snp string, ord long")
    p = spark.createDataFrame([("a", "s", 0.1)], "gene_id string, snp string, beta double")
    other = {"genes": g.withColumn("mid", F.lit(20)), "variants": v, "pairs": p.withColumn("beta", F.lit(0.2))}
    out = H.merge_studies([{"genes": g, "variants": v, "pairs": p}, other])
    assert out["genes"].first().mid == 10 and out["pairs"].first().beta == 0.1 and out["pairs"].count() == 1


def test_selection_by_passes(spark, monkeypatch):
    """Ranks by few passes with few values taken: spread, skewed, equal and signed values, nulls and NaN."""
    from locusframe.operators import aggregates as A

    monkeypatch.setattr(A, "SELECT_ROWS", 20)
    rng = np.random.default_rng(5)
    columns = {
        "even": rng.normal(size=4001), "skew": np.exp(rng.normal(size=4001) * 40), "two": rng.integers(1, 3, 4001).astype(float), "same": np.full(4001, 2.5),
        "half": np.where(rng.random(4001) < 0.6, 7.0, rng.normal(size=4001)), "tiny": rng.normal(size=4001) * 1e-300,
    }
    data = pd.DataFrame(columns)
    rows = spark.createDataFrame(data).repartition(3)
    assert A.exact_medians(rows, *columns) == [float(np.median(v)) for v in columns.values()]
    assert A.exact_medians(rows.limit(4000), "even", upper=True)[0] == sorted(r.even for r in rows.limit(4000).collect())[2000]
    for ranks in ([0], [4000], [17, 18], [0, 4000]):
        assert A.select_ranks(rows, "even", ranks, 4001) == [float(np.sort(columns["even"])[r]) for r in ranks]
    odd = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "x double")
    assert A.exact_median(odd.filter("not isnan(x)"), "x") == 2.0 and A.exact_median(odd, "x") == 3.0
    assert A.exact_median(odd.limit(0), "x") is None


def test_bins_of_long_chains(spark):
    """10,000 links in a row, with some between, against the loop."""
    rng = np.random.default_rng(9)
    n = 10_001
    pairs = {(k, k + 1) for k in range(n - 1) if k % 997} | {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(500)}
    near = [[] for _ in range(n)]
    for i, j in pairs:
        near[i].append(j)
        near[j].append(i)
    label = list(range(n))
    for i in range(n):
        for j in near[i]:
            label[j] = label[i]
    place = {v: k + 1 for k, v in enumerate(sorted(set(label)))}
    ld = spark.createDataFrame(pd.DataFrame([(i, j, 0.9) for i, j in pairs], columns=["i", "j", "r"]))
    got = {r.idx: r.bin for r in W.bin_by_r2(spark.range(n).withColumnRenamed("id", "idx"), ld, 0.5).collect()}
    assert got == {k: place[v] for k, v in enumerate(label)}


@pytest.mark.parametrize("width", [1, 40_000, 3_000_000])
def test_tumbling_windows_over_many_bins(spark, monkeypatch, width):
    """Chromosomes of some hundred bins, empty stretches among them, composed in groups of three."""
    monkeypatch.setattr(W, "_GROUP", 3)
    rng = np.random.default_rng(width)
    rows = [(f"v{c}_{k}", c, int(p)) for c, n, top in ((1, 900, 90_000_000), (2, 1, 5), (7, 300, 7_000_000), (9, 40, 2_000_000_000)) for k, p in enumerate(rng.integers(0, top, n))]
    rows += [("twice", 1, rows[0][2]), ("low", 3, 0), ("high", 3, 250_000_000)]
    want, number, last = {}, -1, (None, 0)
    for snp, chrom, pos in sorted(rows, key=lambda r: (r[1], r[2])):
        if chrom != last[0] or pos > last[1] + width:
            number, last = number + 1, (chrom, pos)
        want[snp] = number
    got = W.tumbling_windows(spark.createDataFrame(rows, "snp string, chrom int, pos long"), width)
    assert {r.snp: r.window for r in got.collect()} == want and got.count() == len(rows)
    assert W.tumbling_windows(spark.createDataFrame([], "snp string, chrom int, pos long"), width).count() == 0


def test_full_matrix_by_runs(spark, monkeypatch):
    """Runs of many tiles: all pairs once, whatever the runs, tiles and blocks; a variant is dealt to as many groups as there are runs."""
    assert L.run_length(1_000_000, 64, 256) == 32_768 and L.run_length(1_000, 64, 256) == 256 and L.run_length(120_000, 10, 256) == 10_000
    # many people: a run is no longer than its bytes, but for a tile
    assert L.run_length(1_000_000, 1_000_000, 512) == 512
    rng = np.random.default_rng(5)
    dosages = [[None if rng.random() < 0.05 else int(x) for x in rng.integers(0, 3, 9)] for _ in range(83)]
    rows = spark.createDataFrame([(2 * i + 1, f"v{i}", d, i % 20 == 3) for i, d in enumerate(dosages)], "idx int, snp string, dosage array<tinyint>, skeleton boolean").repartition(7)
    z = L.standardised([[np.nan if x is None else x for x in d] for d in dosages])
    r = z @ z.T
    monkeypatch.setattr(L, "_PRODUCTS", 64)
    monkeypatch.setattr(L, "_ENTRIES", 30)
    for length in (8, 30, 500):
        monkeypatch.setattr(L, "RUN_BYTES", 8 * 9 * length)
        monkeypatch.setattr(L, "RUNS", 1)
        got = L.ld_pairs(rows.drop("skeleton"), tile=8, jackknife=True).toPandas()
        assert len(got) == 83 * 84 // 2 == len(got[["i", "j"]].drop_duplicates()) and (got["i"] <= got["j"]).all()
        a, b = (got[c].to_numpy() // 2 for c in "ij")
        assert np.allclose(got["r"], r[a, b])
        assert np.allclose(got["jackknife_var"], 9 / 8 * (((z * z) @ (z * z).T) - r * r / 9)[a, b])
        got = {(x.i // 2, x.j // 2) for x in L.ld_pairs(rows, tile=8, least_r2=0.3).collect()}
        assert got == {(i, j) for i in range(83) for j in range(i, 83) if i == j or r[i, j] ** 2 >= 0.3 or i % 20 == 3 or j % 20 == 3}
