"""Line dedup, decontamination and quality rules against plain Python."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from locusframe.llm import decontamination as D
from locusframe.llm import line_dedup as L
from locusframe.llm import quality_rules as Q
from locusframe.llm.queries import ORACLES, QUERIES

from .corpus import frame, odd_rows

DATA = "/root/testdata/sf0.001"


def brute_dedup(docs):
    """docs: (id, text) with different ids, in id order."""
    seen, out = set(), {}
    for i, t in docs:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_brute_force(spark):
    rnd = random.Random(1)
    docs = [(i, "\n".join(rnd.choices("abc", k=rnd.randint(1, 9)))) for i in range(120)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_dedup(docs)


def test_line_dedup_odd_rows(spark):
    rows = odd_rows()
    out = L.dedup_lines(frame(spark, rows), report=True)
    got = out.collect()
    assert len(got) == len(rows) and set(frame(spark, rows).columns) < set(out.columns)
    by = {(r.doc_id, r.n_lines): r for r in got}
    assert by[6, 3].text == "same\nthree\nlines" and by[7, 3].text == "" and by[7, 3].n_removed == 3
    assert by[1, 0].text is None and by[2, 1].text == ""
    assert sum(r.doc_id == 5 and r.text == "twice here" for r in got) == 2
    assert L.dedup_lines(frame(spark, [])).count() == 0
    named = frame(spark, rows).withColumns({"n_lines": F.lit("other"), "n_removed": F.lit("other")})
    assert sorted(map(str, L.dedup_lines(named, report=True).select("doc_id", "n_lines", "n_removed").collect())) == sorted(map(str, out.select("doc_id", "n_lines", "n_removed").collect()))


def brute_contamination(text, items):
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    ws = cut(text)
    hit, names = set(), set()
    for i, t in items:
        iw = cut(t)
        n = min(13, len(iw))
        for a in range(len(iw) - n + 1 if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == iw[a : a + n]:
                    hit |= set(range(p, p + n))
                    names.add(str(i))
    return len(ws), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(ws)


def test_contamination_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 7)  # so that several blocks are needed
    rnd = random.Random(2)
    items = [(k, " ".join(rnd.choices("abcÉ", k=n))) for k, n in enumerate([1, 2, 5, 13, 14, 20, 0, 13])] + [(9, None), (3, "b b")]
    docs = [(i, " ".join(rnd.choices("ABCabcÉ.", k=rnd.randint(0, 60)))) for i in range(60)] + [(100 + k, f"x {t} y") for k, (_, t) in enumerate(items) if t]
    bench = spark.createDataFrame(items + [(None, "a b")], "item_id long, text string")
    out = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in out.collect()}
    assert got == {i: brute_contamination(t, items) for i, t in docs}


def test_contamination_odd_rows(spark):
    rows = odd_rows()
    bench = spark.createDataFrame([(1, "twice here"), (2, "null")], "item_id long, text string")
    out = D.contamination(frame(spark, rows), bench).collect()
    assert len(out) == len(rows)
    assert [r.contaminated for r in out if r.doc_id == 5] == [True, True]
    assert [r.n_words for r in out if r.text is None] == [0, 0]
    assert not any(r.contaminated for r in D.contamination(frame(spark, rows), bench.limit(0)).collect())
    assert D.contamination(frame(spark, []), bench).count() == 0


def test_repeat_words_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        ws = rnd.choices("abc", k=rnd.randint(0, 25))
        seen = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {k + d for k in range(len(ws) - 2) if seen[tuple(ws[k : k + 3])] > 1 for d in range(3)}
        assert Q.repeat_words(ws) == len(hit)


def test_quality_rules(spark):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(200 + k, f"Common  LINE of all\n{' '.join(f'd{k}x{j}' for j in range(80))}") for k in range(12)]
    rows += [(50 + k, f"common line of ALL\n{body}") for k in range(12)]
    docs = frame(spark, rows + odd_rows())
    out = Q.judge(docs, max_docs=10)
    got = out.collect()
    assert len(got) == len(rows) + len(odd_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    # unique bodies stay, and those that twelve documents share are depleted
    assert all(by[200 + k].kept and by[200 + k].removed_words == 4 for k in range(12))
    assert not any(by[50 + k].kept for k in range(12)) and by[50].removed_words == 64
    assert by[2].base_failed and not by[2].kept and by[8].kept
    texts = {r.doc_id: r.text for r in Q.clean_text(docs, max_docs=10).collect()}
    assert texts[50] == "" and texts[200].startswith("d0x0") and texts[201].startswith("d1x0")
    assert Q.judge(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.execute(ORACLES[name]).df()
    key = "vec_id" if "vec_id" in want else "doc_id"
    got = got.toPandas()[sorted(want.columns)].sort_values(key).reset_index(drop=True)
    want = want[sorted(want.columns)].sort_values(key).reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))


def test_frequent_lines_count_every_salt(spark):
    rows = spark.range(500).select(F.lit(1).alias("host"), F.lit(2).alias("h"), (F.col("id") % 5).alias("salt"))
    assert Q.frequent_lines(rows, 499).count() == 5 and Q.frequent_lines(rows, 500).count() == 0


def test_quality_limit_follows_the_host(spark):
    body = lambda k: " ".join(f"d{k}x{j}" for j in range(60))
    notice = " ".join(f"notice{j}" for j in range(80))

    def table(times):
        # of 100 different texts a round, 20 carry the notice and 2 a short line; in every round, one text has 30 copies
        rows = []
        for r in range(times):
            for k in range(100):
                head = notice if k < 20 else "a short line" if k < 22 else f"own{r}x{k}"
                rows.append((1000 * r + k, f"{head}\n{body(1000 * r + k)}"))
            rows += [(1000 * r + 500 + c, f"copied\n{body('c')}") for c in range(30)]
        return frame(spark, rows)

    def verdicts(docs):
        return {r.doc_id: (r.kept, r.removed_words) for r in Q.judge(docs).collect()}

    small, large, copied = verdicts(table(1)), verdicts(table(60)), verdicts(table(1).crossJoin(spark.range(120).select()))
    assert all(small[k] == (False, 80) for k in range(20)) and all(small[k] == (True, 0) for k in small if k >= 20)
    assert {k: v for k, v in large.items() if k < 1000} == small == copied
    assert {v for k, v in large.items() if k % 1000 < 20} == {(False, 80)} and {v for k, v in large.items() if k % 1000 >= 20} == {(True, 0)}
    texts = {r.doc_id: r.text for r in Q.clean_text(table(1)).collect()}
    assert texts[0] == body(0) and texts[20].startswith("a short line") and texts[500].startswith("copied")


def test_contamination_in_blocks_of_items(spark, monkeypatch):
    """A window of many items, and items in several blocks, name the same items as one block does."""
    bench = spark.createDataFrame([(k, "one two three") for k in range(5)] + [(10 + k, f"four{k} five six") for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three y four3 five six"), (2, "nothing")], "doc_id long, text string")
    want = sorted(map(str, D.contamination(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 2)
    got = D.contamination(docs, bench)
    assert sorted(map(str, got.collect())) == want and got.filter("doc_id = 1").first().item_ids == ["0", "1", "13", "2", "3", "4"]
