"""The pipeline's stages, one by one, against what each has to keep."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402

from .test_text_rules import brute_contamination, brute_dedup  # noqa: E402

DATA = "/root/testdata/sf0.001"
#: Letters of alphabets that no document is in, and all Latin ones at random.
FOREIGN = ["αβγδεζηθικλμνοπρστυφχψω", "абвгдежзиклмнопрстуфхцчш", "漢字的一是不了人我在有他這", "abcdefghijklmnopqrstuvwxyz"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    prose = " ".join(reversed(docs.filter("lang = 'en' and n_chars > 500").orderBy("doc_id").first().text.split()))
    junk = spark.createDataFrame([(10**6, "123 456 !!", None, "src0", 10), (10**6 + 1, None, None, "src1", None), (None, prose, None, None, None)], docs.schema)
    rnd = random.Random(3)
    foreign = [(10**6 + 2 + k, " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(80)), None, "src0", 10) for k, letters in enumerate(FOREIGN)]
    out = [docs.unionAll(junk).unionAll(spark.createDataFrame(foreign, docs.schema))]
    for name, stage in P.STAGES:
        out.append(P.materialise(stage(spark, out[-1], DATA), "test-stage"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(before) - set(after) == {10**6 + k for k in range(2 + len(FOREIGN))}


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    known = sorted((i, r.text) for i, r in before.items() if i is not None)
    want = brute_dedup(known)
    assert {i: r.text for i, r in after.items() if i is not None} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_duplicates(stages):
    from .test_near_copies import brute_kept

    before, after = rows(stages[2]), rows(stages[3])
    assert {i for i in after if i is not None} == brute_kept(sorted((i, r.text) for i, r in before.items() if i is not None))


def test_contamination(stages, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, after = rows(stages[3]), rows(stages[4])
    short = {i: r for i, r in before.items() if len(r.text) < 3000}
    want = {i for i, r in short.items() if not brute_contamination(r.text, items)[3]}
    assert {i for i in after if i in short} == want


def test_codes(stages, spark):
    before, after = stages[4].count(), stages[5]
    assert after.count() == before and after.filter(F.col("n_tokens") < 1).count() == 0


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, DATA), "test-run")
    got, want = P.run(spark, DATA), docs
    assert got.columns == want.columns and got.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
