"""The transactional sink: what a folder holds after failed attempts, and pair matrices of one file by many tasks."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from locusframe.errors import EngineError
from locusframe.sinks import sets as S
from locusframe.sinks import writers as K
from locusframe.sources import binary as B
from locusframe.sources import text as R

ROOT = Path(__file__).resolve().parent.parent

FAILS_ONCE = """
import sys
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from locusframe.session import build_session
from locusframe.sinks import writers as K

spark = build_session("local[2,3]", partitions=2, memory="1g", **{"spark.checkpoint.dir": "file://" + sys.argv[2]})
spark.sparkContext.setLogLevel("OFF")
rows = spark.range(60).select(F.col("id").alias("idx"), F.concat(F.lit("s"), "id").alias("snp"), F.lit(1).alias("chrom"), F.col("id").cast("int").alias("pos"), F.lit(0.5).alias("gen_pos"), F.lit("A").alias("a1"), F.lit("G").alias("a2"), F.array(*[(F.col("id") % 3).cast("tinyint")] * 5).alias("dosage"))

def breaks(batches):
    # the first attempt of a task stops after its first rows have been written
    for batch in batches:
        yield batch
        if TaskContext.get().attemptNumber() == 0 and batch.column(0)[0].as_py() < 30:
            raise RuntimeError("lost")

import locusframe.sinks.sets as S
dealt = rows.repartitionByRange(3, "idx").sortWithinPartitions("idx").mapInArrow(breaks, rows.schema)
people = sys.argv[1] + "-people"
open(people, "w").write("f i 0 0 0 -9\\n" * 5)
listed = S.save_sets(dealt, sys.argv[1], "bed", people=people)
print("LISTED", *sorted(r.name for r in listed.collect()), listed.agg(F.sum("n_variants")).first()[0])
"""


def test_a_lost_task_leaves_no_files(tmp_path):
    folder = tmp_path / "out"
    run = subprocess.run([sys.executable, "-c", FAILS_ONCE, str(folder), str(tmp_path / "shared")], capture_output=True, text=True, timeout=240, env={**os.environ, "PYTHONPATH": str(ROOT)}, cwd=tmp_path)
    line = [x for x in run.stdout.splitlines() if x.startswith("LISTED")]
    assert line, run.stderr[-2000:]
    *names, total = line[0].split()[1:]
    assert total == "60" and len(names) == 3
    want = {Path(n).name + x for n in names for x in (".bed", ".bim", ".fam")}
    assert {p.name for p in folder.iterdir() if not p.name.endswith(".written")} == want


def batches(n):
    schema = ["snp", "chrom", "pos", "gen_pos", "a1", "a2", "dosage"]
    yield pa.record_batch([pa.array([f"s{k}" for k in range(n)]), pa.array([1] * n), pa.array(range(n)), pa.array([0.5] * n), pa.array(["A"] * n), pa.array(["G"] * n), pa.array([[0, None, 2]] * n, pa.list_(pa.int8()))], schema)


def test_commit_and_abort(tmp_path):
    (tmp_path / "people").write_text("f i 0 0 0 -9\n" * 3)
    writer = S.SetsWriter({"path": str(tmp_path / "out"), "job": "j", "kind": "bed", "people": str(tmp_path / "people")})

    def lost():
        yield from batches(4)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    twice = writer.write(batches(4))
    kept = writer.write(batches(4))
    (tmp_path / "out" / "another.bed").write_bytes(b"")
    writer.commit([kept, None])
    assert twice.sets != kept.sets
    left = {p.name for p in (tmp_path / "out").iterdir()}
    assert left == {kept.sets[0]["name"] + x for x in (".bed", ".bim", ".fam")} | {"j.written", "another.bed"}
    writer.write(batches(2))
    writer.abort([])
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"j.written", "another.bed"}


def test_a_set_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "snp string, chrom int, pos int, gen_pos double, a1 string, a2 string, dosage array<tinyint>")
    assert S.save_sets(rows, str(tmp_path / "none"), "bed", people="x").count() == 0


def test_one_file_by_many_tasks(spark, tmp_path, monkeypatch):
    variants = spark.createDataFrame([(f"s{i}", 1 + i % 2, 1000 - i, "A", "G", 0.25) for i in range(50)], "snp string, chrom int, pos int, a1 string, a2 string, af double")
    genes = spark.createDataFrame([(f"g{i}", 1, 15.0, 100 - i) for i in range(20)], "gene_id string, chrom int, mid double, ord long")
    pairs = spark.createDataFrame([(f"g{i}", f"s{j}", i + j / 8, 0.5) for i in range(18) for j in range(i, 48, 1 + i % 5)], "gene_id string, snp string, beta double, se double").repartition(5)
    K.write_besd_file(pairs, variants, genes, str(tmp_path / "one"))
    monkeypatch.setattr(K, "COLUMN_BYTES", 100)
    K.write_besd_file(pairs, variants, genes, str(tmp_path / "many"))
    K.write_besd_file(pairs, variants, genes, str(tmp_path / "joined"), joined=True)
    for suffix in (".besd", ".esi", ".epi"):
        content = {(tmp_path / (n + suffix)).read_bytes() for n in ("one", "many", "joined")}
        assert len(content) == 1 and content.pop()
    # no part is left
    assert {p.name.split(".")[0] for p in tmp_path.iterdir() if "one" in p.name or "many" in p.name or "joined" in p.name} == {"one", "many", "joined"}
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("joined")]) == 3
    back = B.read_besd(spark, str(tmp_path / "many.besd"), R.read_esi(spark, str(tmp_path / "many.esi")), R.read_epi(spark, str(tmp_path / "many.epi")))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in pairs.collect()}
    with pytest.raises(EngineError):
        K.write_besd_file(pairs.limit(0), variants, genes, str(tmp_path / "empty"))


def test_annotation_lines_of_many_genes(spark, tmp_path, monkeypatch):
    from locusframe.plans import pipelines as P

    names = sorted(f"g{i}" for i in range(3000))
    genes = spark.createDataFrame([(g, k) for k, g in enumerate(names)], "gene_id string, ord long")
    held = {(f"s{j}", names[(j * 977 + k * k) % 3000]): (j - k) / 4 for j in range(40) for k in range(1 + j % 7)} | {("s9", names[0]): 0.5, ("s9", names[-1]): -0.5}
    pairs = spark.createDataFrame([(g, s, b) for (s, g), b in held.items()], "gene_id string, snp string, beta double").repartition(3)
    want = ["\t".join(["SNP", "Intercept", *names])] + ["\t".join([s, "1", *[str(held.get((s, g), 0)) for g in names]]) for s in sorted({s for s, _ in held})]
    monkeypatch.setattr(K, "LINE_BYTES", 50_000)
    lines = K.annotation_lines(pairs, genes)
    # no array with an entry for each column
    assert "sequence(" not in lines._jdf.queryExecution().toString()
    assert [r.line for r in lines.collect()] == want
    P.export_study({"genes": genes, "variants": None, "pairs": pairs}, "annotation", str(tmp_path / "a"), gzip=True)
    assert len(list((tmp_path / "a").glob("*.gz"))) > 1
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()].count(want[0]) == 1
    assert {r.value for r in spark.read.text(str(tmp_path / "a")).collect()} == set(want)


def test_besd_sets_follow_the_pairs(spark, tmp_path, monkeypatch):
    from locusframe.plans import pipelines as P
    from pyspark.sql import functions as F

    variants = spark.createDataFrame([(f"s{i}", 1 + i % 2, 1000 - i, "A", "G", 0.25) for i in range(50)], "snp string, chrom int, pos int, a1 string, a2 string, af double")
    genes = spark.createDataFrame([(f"g{i}", 1, 15.0, 100 - i) for i in range(20)], "gene_id string, chrom int, mid double, ord long")
    pairs = spark.createDataFrame([(f"g{i}", f"s{j}", i + j / 8, 0.5) for i in range(18) for j in range(i, 48, 1 + i % 5)], "gene_id string, snp string, beta double, se double").repartition(5)
    monkeypatch.setattr(K, "SET_PAIRS", 40)
    listed = K.write_besd(pairs, variants, genes, str(tmp_path / "out"), 2).collect()
    assert len(listed) > 4 and sum(r.n_genes for r in listed) == 18
    sets, failed = P.load_sets(spark, [r.name for r in listed])
    assert not failed and {tuple(r) for r in sets["pairs"].select("gene_id", "snp", "beta", "se").collect()} == {tuple(r) for r in pairs.collect()}
    # a set's pairs lie together
    stored = spark.read.parquet(*{f.rpartition("/")[0] for f in sets["pairs"].inputFiles()}).select("set", F.input_file_name().alias("f")).collect()
    for f in {r.f for r in stored}:
        own = [r["set"] for r in stored if r.f == f]
        assert own == sorted(own)


def test_besd_set_from_batches():
    """Names that come again in later batches, described once, places by chromosome and position."""
    import pyarrow as pa
    from locusframe.sinks.sets import _numbered

    numbers = {}
    own, first = _numbered(pa.array(["b", "a", "b"]), numbers)
    assert own.tolist() == [0, 1, 0] and first.to_pylist() == [0, 1]
    own, first = _numbered(pa.array(["a", "c", "b", "c"]), numbers)
    assert own.tolist() == [1, 2, 0, 2] and first.to_pylist() == [1] and list(numbers) == ["b", "a", "c"]


def test_release_lets_shuffle_files_go(spark, tmp_path):
    from locusframe.storage import materialise, release
    from pyspark.sql import functions as F

    release(spark)
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())

    def stored() -> set:
        return {p for f in folders for p in Path(str(f)).rglob("shuffle_*.data")}

    before = stored()
    rows = spark.range(5000).groupBy((F.col("id") % 997).alias("k")).agg(F.count("*").alias("n"))
    held = materialise(rows, "released")
    assert stored() - before
    release(spark)
    assert not stored() - before and held.count() == 997 == rows.count()
