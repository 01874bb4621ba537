"""Merkle manifests, byte-level BPE and product codes against brute force and the library they must equal."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from locusframe.errors import EngineError
from locusframe.llm import byte_bpe as B
from locusframe.llm import merkle as M
from locusframe.llm import vector_codes as V
from locusframe.llm.queries import QUERIES
from locusframe.llm.sentencepiece_codec import read_model

from .corpus import frame, odd_rows, words

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, for each leaf its steps (left siblings, right siblings))."""
    level, steps, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % 8
            steps[k].append((level[run:i], level[i + 1 : run + 8]))
            at[k] = i // 8
        level = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], steps


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def changed(r):
        hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        return leaf((*r[:4], r[4].translate(LOWER))) if hit else leaf(r)

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        subroot, steps = trees[g]
        for r, path in zip(groups[g], steps, strict=True):
            path = path + top
            node = changed(r)
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((r[0], leaf(r), subroot, root, sha(*[h for left, right in path for h in left + right]), node, node == root))
    return sorted(out, key=str)


@pytest.fixture
def manifest_of(spark, tmp_path):
    def run(rows):
        path = tmp_path / f"{random.random()}"
        shape = "doc_id long, source string, lang string, n_chars long, text string, pos int, h string, g string, path string, root string, item string, leaf string"
        full = [(*r, 1, "x", "x", "x", "x", "x", "x") for r in rows]
        spark.createDataFrame(full, shape).write.parquet(f"{path}/documents.parquet")
        got = QUERIES["op11_merkle_manifest"](spark, str(path))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return sorted([tuple(r) for r in got.collect()], key=str)

    return run


def test_manifest_brute_force(manifest_of):
    rnd = random.Random(4)
    # groups of one, of a run's size and one more, and of three levels; 10 groups need two levels above
    sizes = {None: 3, "": 1, "de": 8, "en": 9, "é": 64, "zz": 65, "fr": 70, "a": 2, "b": 1, "Z": 16}
    ids = iter(rnd.sample(range(10**6), 1000))
    rows = [(next(ids), rnd.choice([None, "s"]), g, rnd.choice([None, 5]), rnd.choice([None, "", "Abc 漢字 É", "plain", "X" * 999])) for g, n in sizes.items() for _ in range(n)]
    got = manifest_of(rows)
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_odd_rows(manifest_of):
    rows = [(i, None, None if k % 2 else "en", None, t) for k, (i, t) in enumerate(odd_rows())]
    assert manifest_of(rows) == brute_manifest(rows)
    # a lone leaf is all roots, with no siblings
    (lone,) = manifest_of([(5, None, None, None, "A")])
    assert lone[1] == lone[2] == lone[3] and lone[4] == sha()
    assert manifest_of([]) == []


def test_manifest_of_many_equal_rows(spark):
    rows = spark.range(700).select(F.lit(1).alias("doc_id"), F.lit("en").alias("lang"), M.leaf_hash(F.lit("t")).alias("leaf"))
    got = M.manifest(rows, "leaf", "lang", "doc_id")
    assert got.count() == 700 and got.select("root").distinct().collect()[0][0] == tree([sha("1:t")] * 700)[0]
    assert got.select(M.fold(M.hex_text(F.col("leaf")), F.col("path")).alias("x")).distinct().count() == 1


def test_sql_of_manifest_and_codes_with_odd_rows(spark, tmp_path):
    import duckdb

    from locusframe.llm.queries import ORACLES

    spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("label", F.when(F.col("label") > 3, F.col("label"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLES["op13_vector_codes"]).fetchall()
    got = [tuple(r) for r in QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and want


@pytest.fixture(scope="module")
def bpe():
    return B.Codec(read_model(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_is_the_library(bpe, library, monkeypatch):
    rnd = random.Random(6)
    kinds = [list(" \n\tab"), ["  ", "\n\n", " \n", "a", "'s", " '", "1", "²"], list("the ing er an on .,\n"), ["<|endoftext|>", "<|end", " a", "b "], list("éßñ漢字한🙂a \x00\x1c\x85\xa0　 "), list("etaoin")]
    texts = ["".join(rnd.choices(rnd.choice(kinds), k=rnd.randint(0, 60))) for _ in range(5000)]
    texts += [words(1, 3000), "x" * 30_000, "etaoin" * 5000, " " * 500, "".join(rnd.choices("etaoin", k=40_000)), ""]
    for most in (B.REMEMBERED, 50):
        # a small memory, in which generations change, gives the same
        monkeypatch.setattr(B, "REMEMBERED", most)
        monkeypatch.setattr(B, "TOGETHER", 40 * most)
        for t, i, e in zip(texts, bpe.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert i == e.ids and bpe.decode(e.ids) == t
    assert len(bpe.known.new) < 3000 and max(map(len, [*bpe.known.new, *bpe.words.new]), default=0) <= B.LONGEST
    # any ids, also those whose bytes are no UTF-8
    for _ in range(3000):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 9))]
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_every_character(bpe, library):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}\n {chr(c)}x" for c in range(0x3200) if not 0xD800 <= c < 0xE000]
    assert list(bpe.encode(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merges_brute_force(bpe):
    """The lowest rank first, the leftmost of equals, one at a time over the whole list."""
    rnd = random.Random(8)
    for n in [1, 2, 3, 4, 5, 8, 9, 17, 120] * 20:
        text = "".join(rnd.choices("aaaeinrst ", k=n))
        symbols = [bpe.first[b] for b in text.encode()]
        got, want = bpe.merge(list(symbols)), list(symbols)
        assert bpe.merge_all([text]) == [got]
        while True:
            ranks = [bpe.rank.get((a << 32) + b, B._NONE) for a, b in zip(want, want[1:], strict=False)]
            if not ranks or min(ranks) == B._NONE:
                break
            at = ranks.index(min(ranks))
            want[at : at + 2] = [bpe.made[min(ranks) >> 32]]
        assert got == want


def test_bpe_frames(spark, bpe, library):
    vocabulary = read_model(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*odd_rows(), (20, "a <|endoftext|>\nb")]
    out = B.encode_texts(frame(spark, rows), vocabulary).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    digests = B.digest_texts(frame(spark, rows), vocabulary).collect()
    for r in digests:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(r.text or ""))
    assert B.digest_texts(frame(spark, []), vocabulary).count() == 0
    with pytest.raises(EngineError):
        B.Codec(read_model(public_tokenizers.path("word_bpe_49k.json")))


def brute_codes(vectors, entries=64, rounds=2):
    """vectors: (id, whole components); (books, codes, errors) with all entries compared."""
    vectors = sorted(vectors, key=lambda v: (v[0] is None, v[0] or 0, v[1]))
    x = np.array([v for _, v in vectors], object).reshape(len(vectors), 16, -1)
    books = [[list(row[p]) for row in x[:entries]] for p in range(16)]

    def find(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        took = [[find(p, row[p])[1] for row in x] for p in range(16)]
        for p in range(16):
            for k in range(len(books[p])):
                mine = [row[p] for row, t in zip(x, took[p], strict=True) if t == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[find(p, row[p]) for p in range(16)] for row in x]
    return books, {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(vectors, found, strict=True)}


@pytest.mark.parametrize("n", [200, 40])
def test_codes_brute_force(spark, n):
    rnd = np.random.default_rng(n)
    # many ties: few different values
    raw = [(int(i), (rnd.integers(-3, 4, 32) / 8 + rnd.choice([0, 0.001])).tolist(), [None, 1, 2][i % 3]) for i in rnd.permutation(n)]
    odd = [(n + 1, None, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, [None] + [0.0] * 31, None), (n + 4, [float("-inf")] * 32, 2), (n + 5, [], 1), (n + 6, [0.5] * 31, 1)]
    shape = "vec_id long, embedding array<float>, label int, code string, error string, n int, v int, part int"
    df = spark.createDataFrame([(*r, "x", "x", 1, 1, 1) for r in raw + odd], shape).repartition(5)
    out = V.compress(df)
    assert out.columns == ["vec_id", "label", "n", "v", "part", "code", "error", "label_error", "codebooks_sha256"]
    whole = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, _ in raw]
    books, want = brute_codes(whole)
    rows = out.collect()
    assert {r.vec_id: (r.code, r.error) for r in rows} == want and len(rows) == n
    for label in (None, 1, 2):
        mine = [r for r in rows if r.label == label]
        assert {r.label_error for r in mine} == {sum(r.error for r in mine)}
    assert {r.codebooks_sha256 for r in rows} == {sha(",".join(str(c) for p in books for e in p for c in e))}
    trained = np.array(books, np.int64)
    for r in rows[:20]:
        gap = V.decode(r.code, trained) - np.array(dict(whole)[r.vec_id])
        assert (gap**2).sum() == r.error


def test_codes_odd_rows(spark):
    shape = "vec_id long, embedding array<double>, label string"
    assert V.compress(spark.createDataFrame([], shape)).count() == 0
    assert V.compress(spark.createDataFrame([(1, None, "a")], shape)).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    # repeated rows, a null id, another length than that of the smallest id
    rows = [(3, [0.1] * 16, None), (3, [0.1] * 16, None), (None, [0.2] * 16, "a"), (4, [0.1] * 32, "a")]
    out = V.compress(spark.createDataFrame(rows, shape)).collect()
    assert sorted((str(r.vec_id), r.code, r.error) for r in out) == [("3", "00" * 16, 0), ("3", "00" * 16, 0), ("None", "02" * 16, 0)]
    with pytest.raises(Exception, match="magnitude"):
        V.compress(spark.createDataFrame([(1, [1e30] * 16, None)], shape)).count()
    with pytest.raises(EngineError):
        V.compress(spark.createDataFrame([], shape), entries=257)


def test_equal_average_search_prunes_and_is_exact():
    rnd = np.random.default_rng(1)
    points, entries = rnd.integers(-500, 500, (3000, 8)), rnd.integers(-500, 500, (64, 8))
    code, best = V.nearest(points, entries)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (code == every.argmin(axis=1)).all()
    code, best = V.nearest(points[:0], entries)
    assert not len(code)
    big = np.array([[V.limit(64), -V.limit(64), 0, 0]])
    assert V.nearest(big, -big)[1][0] == 8 * V.limit(64) ** 2
