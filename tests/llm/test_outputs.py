"""Token files, shards and the SentencePiece codec: exact round trips and agreement with the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T

from locusframe.llm import sharding as H
from locusframe.llm import token_output as O
from locusframe.llm.sentencepiece_codec import Codec, digest_texts, encode_texts, read_model

from .corpus import frame, odd_rows, words


@pytest.fixture(scope="module")
def codec():
    return Codec(read_model(public_tokenizers.path("piece_bpe_32k.model")))


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    kinds = [" \n\tab", "abcdefghij ", "▁ a\n", "éßñ漢字한🙂a ", "  ", "the ing er an on .,\n", "  \x1c\x85\xa0a　", "abc'sdt ll "]
    return ["".join(rnd.choices(rnd.choice(kinds), k=rnd.randint(0, 60))) for _ in range(n)]


def test_codec_is_the_library(codec):
    texts = random_texts(4000) + [words(1, 3000), "x" * 3000, " " * 500]
    assert [codec.encode(t) for t in texts] == codec.library.encode(texts)


def test_codec_backtracks(codec):
    calls = []
    holds = codec.holds
    codec.holds = lambda a, b: calls.append(holds(a, b)) or calls[-1]
    codec.words.clear()
    codec.encode(words(3, 500, "aeinrst"))
    codec.holds = holds
    assert not all(calls)


def test_codec_frames(spark):
    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = encode_texts(frame(spark, odd_rows()), model).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        assert list(r.ids) == sp.encode(r.text or "") + [2] and r.decoded == sp.decode(sp.encode(r.text or ""))
    assert digest_texts(frame(spark, odd_rows()), model).filter("doc_id = 1 and n_tokens = 1").count() == 1
    assert digest_texts(frame(spark, []), model).count() == 0


def test_word_encoder_is_the_library():
    e = O.WordEncoder(read_model(public_tokenizers.path("byte_bpe_50k.json")))
    texts = random_texts(4000, 2) + [words(1, 3000), "<|endoftext|> a", "a <|endoftext|>\nb"]
    for t, x in zip(texts, e.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.encode(t), e.kind).tolist() == x.ids


def test_token_files_round_trip(spark):
    vocabulary = read_model(public_tokenizers.path("byte_bpe_50k.json"))
    files = O.write_sequences(frame(spark, odd_rows()), vocabulary, 2, seq_len=64, batch=4, file_tokens=10_000)
    assert files.count() > 1
    e = O.WordEncoder(vocabulary)
    got = O.read_documents(files, T.LongType()).orderBy("start").collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.append(np.frombuffer(e.encode(t or ""), e.kind), 2).astype("<u4").tobytes()) for _, t in rows)
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    first = O.SequenceFile(files.orderBy("part", "seq").first().path)
    ids, mask = first.sequence(0)
    assert len(ids) == 64 and ids.base is not None and ids.tolist() == first.tokens(0, 64).tolist() and mask.sum() == min(64, first.index.column("n").to_numpy().sum())
    assert O.read_documents(O.write_sequences(frame(spark, []), vocabulary, 2), T.LongType()).count() == 0


def brute_shards(rows, shards, points):
    """rows: (id, at, turn). Rows one round after the other, each shard filled in the order of turn."""
    n = len(rows)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    where = {}
    while rows:
        ring = sorted(p for p in points if room[p[1]])
        asked = {}
        for i, at, turn in rows:
            owner = next((s for p, s, _ in ring if at <= p), ring[0][1])
            asked.setdefault(owner, []).append((turn, i, at))
        rows = []
        for s, found in asked.items():
            found.sort()
            for _, i, _ in found[: room[s]]:
                where[i] = s
            rows += [(i, at, turn) for turn, i, at in found[room[s] :]]
            room[s] = max(0, room[s] - len(found))
    return where


def test_shards_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(H, "CELL_ROWS", 10)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    out = {r.doc_id: r.shard for r in H.assign_shards(docs, 7, virtual=5).collect()}
    hashed = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("at"), F.xxhash64(F.lit("turn"), "doc_id", "text").alias("turn"))
    points = [(r["at"], r.shard, r.node) for r in H._points(spark, 7, 5).collect()]
    assert out == brute_shards([tuple(r) for r in hashed.collect()], 7, points)


@pytest.mark.parametrize("n", [0, 1, 5, 24, 1000])
def test_shards_are_even(spark, n):
    docs = frame(spark, [(k, f"text {k}") for k in range(n)])
    got = H.assign_shards(docs).collect()
    sizes = [0] * 24
    for r in got:
        sizes[r.shard] += 1
    assert len(got) == n and max(sizes) - min(sizes) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shards_odd_rows(spark):
    rows = odd_rows() + [(None, f"n{k}") for k in range(200)] + [(77, "hot")] * 300
    got = H.assign_shards(frame(spark, rows)).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(24)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1


def test_shards_move_little(spark):
    docs = spark.createDataFrame([(i, "") for i in range(20_000)], "doc_id long, text string")
    a = H.assign_shards(docs, 24).toPandas().set_index("doc_id")["shard"]
    b = H.assign_shards(docs, 25).toPandas().set_index("doc_id")["shard"]
    assert (a != b[a.index]).mean() < 0.25
