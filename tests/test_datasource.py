"""The data sources: rows equal to what was written, filters in the plan and in the bytes that are read."""

import contextlib
import io
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.errors import EngineError
from locusframe.sinks import writers as K
from locusframe.sources import datasource as S


@pytest.fixture
def bed(spark, tmp_path):
    rng = np.random.default_rng(3)
    g = rng.integers(-1, 3, (100, 13))
    prefix = str(tmp_path / "a")
    (tmp_path / "a.bed").write_bytes(K.bed_bytes(g.tolist()))
    (tmp_path / "a.fam").write_text("".join(f"f{i} i{i} 0 0 0 -9\n" for i in range(13)))
    (tmp_path / "a.bim").write_text("".join(f"{'X' if k >= 90 else 1 + k // 30}\ts{k}\t0.{k}\t{k * 10}\tA\tG\n" for k in range(100)))
    S.register(spark)
    return prefix, g


def plan(df):
    """(pushed filters, condition of Spark's own filter)."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    found = dict(re.findall(r"^(PushedFilters|Condition) ?: (.*)$", out.getvalue(), re.M))
    return found.get("PushedFilters", ""), found.get("Condition", "")


def test_bed_rows(spark, bed):
    prefix, g = bed
    rows = spark.read.format("locus_bed").option("part_bytes", 28).load(prefix)
    got = rows.orderBy("idx").collect()
    assert [[-1 if x is None else x for x in r.dosage] for r in got] == g.tolist()
    assert [(r.snp, r.chrom, r.pos, r.a1) for r in got[88:92]] == [("s88", 3, 880, "A"), ("s89", 3, 890, "A"), ("s90", 23, 900, "A"), ("s91", 23, 910, "A")]
    assert rows.rdd.getNumPartitions() > 1
    kept = spark.read.format("locus_bed").option("keep", S.keep_bits([0, 5, 12], 13)).load(prefix).orderBy("idx").collect()
    assert [[-1 if x is None else x for x in r.dosage] for r in kept] == g[:, [0, 5, 12]].tolist()


def test_bed_filters_are_pushed(spark, bed):
    prefix, g = bed
    rows = spark.read.format("locus_bed").load(prefix)
    some = rows.filter("chrom = 2 and idx >= 40 and idx < 50 and pos <> 450")
    pushed, left = plan(some)
    assert "EqualTo(chrom,2)" in pushed and "GreaterThanOrEqual(idx,40)" in pushed
    # what the source does not take stays with Spark
    assert "pos" in left and "chrom" not in left and "idx" not in left
    assert [r.idx for r in some.orderBy("idx").collect()] == [k for k in range(40, 50) if k != 45]
    assert {r.idx for r in rows.filter(F.col("snp").isin("s3", "s95", "none") & F.col("chrom").isNotNull()).collect()} == {3, 95}
    assert rows.filter("chrom = 99").count() == 0 and rows.filter("idx in (7, 1000)").count() == 1


def test_bed_reads_the_bytes_of_wanted_rows_only(bed):
    prefix, g = bed
    reader = S._BedReader(prefix, part_bytes=40)
    reader.wanted["idx"].values = frozenset([99])
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(90, 100)]
    (batch,) = reader.read(parts[0])
    assert batch.num_rows == 1 and [x if x is not None else -1 for x in batch.column("dosage").to_pylist()[0]] == g[99].tolist()


def test_bed_of_another_size_is_an_error(spark, bed, tmp_path):
    (tmp_path / "a.fam").write_text("f i 0 0 0 -9\n" * 25)
    with pytest.raises(EngineError):
        S._BedReader(bed[0])


def write_set(tmp_path, name, genes, columns):
    (tmp_path / f"{name}.besd").write_bytes(K.besd_bytes([tuple(map(np.array, c)) for c in columns]))
    (tmp_path / f"{name}.epi").write_text("".join(f"{1 + k}\t{g}\t0\t100\t{g}\tNA\n" for k, g in enumerate(genes)))
    (tmp_path / f"{name}.esi").write_text("".join(f"1\ts{k}\t0\t{k}\tA\tG\t0.5\n" for k in range(9)))
    return str(tmp_path / name)


def test_besd_sets_in_one_scan(spark, tmp_path):
    S.register(spark)
    one = write_set(tmp_path, "one", ["a", "b", "c"], [([0, 3], [0.5, 1.5], [1.0, -9.0]), ([1, 2, 8], [1, 2, 3], [1, 1, 1]), ([5], [0.25], [2])])
    two = write_set(tmp_path, "two", ["b"], [([7], [4], [1])])
    rows = spark.read.format("locus_besd").option("part_bytes", 16).option("prefixes", json.dumps([one, two])).load()
    want = {(0, 0, "a", 1, 0, 0.5, 1.0), (0, 1, "b", 2, 1, 1, 1), (0, 1, "b", 2, 2, 2, 1), (0, 1, "b", 2, 8, 3, 1), (0, 2, "c", 3, 5, 0.25, 2), (1, 0, "b", 1, 7, 4, 1)}
    assert {tuple(r) for r in rows.collect()} == want
    some = rows.filter("gene_id = 'b' and chrom = 2")
    assert "EqualTo(gene_id,b)" in plan(some)[0] and {tuple(r) for r in some.collect()} == {w for w in want if w[2:4] == ("b", 2)}
    assert {r.gene_id for r in spark.read.format("locus_besd").load(one).filter("gene_idx > 1").collect()} == {"c"}
    reader = S._BesdReader([one])
    reader.wanted["gene_id"].values = frozenset(["a", "c"])
    assert [(p.first, p.count) for p in reader.partitions()] == [(0, 1), (2, 1)]
    (tmp_path / "one.epi").write_text("1\ta\t0\t1\ta\tNA\n" * 50)
    with pytest.raises(EngineError):
        S._BesdReader([one]).partitions()
