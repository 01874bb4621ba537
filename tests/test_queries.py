"""Every query against the same question in DuckDB, on the smallest tables."""

import numbers
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from locusframe.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]


    def plain(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([plain(x) for x in v])
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, numbers.Number) else str(v)

    return sorted((tuple(map(plain, row)) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    # that nothing agrees with nothing would prove nothing
    assert len(want) and normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_folders(tmp_path):
    """With the corpus operators and the pipeline taken out, whole or but for empty folders, the rest works."""
    root = Path(__file__).resolve().parents[1]
    script = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for k, hollow in enumerate((False, True)):
        copy = tmp_path / str(k)
        shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", "llm", "corpus_pipeline.py")])
        if hollow:
            (copy / "locusframe" / "llm" / "__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", script], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)}, timeout=120)


def test_besd_source_sums_that_lie_half_way(spark, tmp_path):
    """Five pairs a gene, whose sums of double precision round alike in any order, but not those of single precision."""
    for t in TABLES:
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
    con = duckdb.connect()
    halves = [(0, 0, 0, 0, k) for k in (0, 1, 4, 6, 7, 10)] + [(0, 0, 0, 1, 6)]
    rows = [(gene, k, cents / 100) for gene, of in enumerate(halves, 1) for k, cents in enumerate(of, 1)]
    con.execute("CREATE TABLE given (gene BIGINT, k BIGINT, discount DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?)", rows)
    some = f"SELECT * FROM '{DATA}/lineitem.parquet' LIMIT 1"
    replaced = "gene AS l_suppkey, k AS l_partkey, 10 * gene + k AS l_orderkey, 1 AS l_linenumber, discount AS l_discount"
    con.execute(f"CREATE TABLE made AS SELECT l.* REPLACE ({replaced}) FROM ({some}) l, given")
    types = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t, *_ in con.execute(f"DESCRIBE {some}").fetchall())
    con.execute(f"COPY (SELECT {types} FROM made) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(ORACLES["besd_source"]).df()
    assert len(want) == len(halves) and normal(QUERIES["besd_source"](spark, str(tmp_path)).toPandas()) == normal(want)
