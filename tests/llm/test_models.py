"""Language ID, LM scoring and toxicity: held-out quality, calibration, and agreement with direct computation."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from locusframe.llm import language_id as I
from locusframe.llm import lm_scoring as M
from locusframe.llm import toxicity as X
from locusframe.llm.queries import QUERIES
from locusframe.llm.sentencepiece_codec import read_model

from .corpus import fold, frame, odd_rows, words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def test_language_query_is_right_on_held_out_rows(spark):
    out = QUERIES["op2_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out["held_out"] == out["doc_id"].map(lambda i: fold(i) == 0)).all()
    held = out[out["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and out["score"].between(0, 1).all()


def test_language_odd_rows(spark):
    one, other = [(k, words(k, 30, "abcde")) for k in range(60)], [(k, words(k, 30, "vwxyz")) for k in range(60, 120)]
    docs = frame(spark, one, "aa").unionAll(frame(spark, other, "zz")).unionAll(frame(spark, odd_rows(), None))
    model = I.fit(docs)
    assert model.labels == ["aa", "zz"]
    out = I.identify(docs, model).collect()
    assert len(out) == 120 + len(odd_rows())
    assert all(r.lang_pred == ("aa" if r.lang == "aa" else "zz") for r in out if r.lang)
    assert {(r.lang_pred, r.score) for r in out if not (r.text or "").strip()} == {("und", 0.0)}
    nobody = I.identify(frame(spark, one), I.fit(frame(spark, [])))
    assert {r.lang_pred for r in nobody.collect()} == {"und"} and I.identify(frame(spark, []), model).count() == 0


def test_document_frequencies_cover_all_rows(spark):
    docs = frame(spark, [(k, f"ab {k}") for k in range(50)])
    df, n = I.document_frequencies(docs, "text")
    found, _ = I.ngram_counts("ab ")
    assert n == 50 and (df[found] == 50).all()


def test_temperature_smooths_certainty():
    scores = np.array([[9.0, 0], [0, 9.0]] * 5)
    t = I.fit_temperature(scores, np.array([0, 1] * 5))
    assert I.softmax(scores / t).max() == pytest.approx(11 / 12, abs=0.01)


def brute_lattice(text, scores, sp):
    """Sum over all segmentations, by recursion over prefixes."""
    total = [1.0] + [0.0] * len(text)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in ids:
                total[end] += total[start] * 10 ** scores[ids[text[start:end]]]
    return math.log10(total[-1])


def test_lattice_brute_force(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    scores = np.random.default_rng(1).uniform(-5, -2, sp.get_piece_size())
    lattice = M.Lattice(pieces, scores)
    for word in ("the", "internationalisation", "ñandú", "a", "....."):
        assert lattice.log10_probability(word) == pytest.approx(brute_lattice("▁" + word, scores, sp), abs=1e-9)
    spelt = sum(scores[sp.piece_to_id(f"<0x{b:02X}>")] for b in "퟿".encode("utf-8", "surrogatepass"))
    assert lattice.log10_probability("a퟿") == pytest.approx(brute_lattice("▁a", scores, sp) + spelt)


def segmentations(text, ids):
    """All ways to cut a text into pieces, as lists of piece ids."""
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in ids:
            for rest in segmentations(text[n:], ids):
                yield [ids[text[:n]], *rest]


def piece_ids(sp):
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}


@pytest.mark.parametrize("short", [40, 0])
def test_expected_counts_brute_force(pieces, monkeypatch, short):
    import sentencepiece

    monkeypatch.setattr(M, "_SHORT", short)
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    scores, ids = np.random.default_rng(2).uniform(-5, -2, sp.get_piece_size()), piece_ids(sp)
    lattice = M.Lattice(pieces, scores)
    for word, c in (("the", 3.0), ("andthat", 2.0), ("ñandú", 1.0), ("a퟿", 5.0)):
        ways = [(w, 10 ** sum(scores[i] for i in w)) for w in segmentations("▁" + word.removesuffix("퟿"), ids)]
        want = np.zeros(sp.get_piece_size())
        for way, p in ways:
            np.add.at(want, way, c * p / sum(p for _, p in ways))
        if word.endswith("퟿"):
            for b in "퟿".encode():
                want[sp.piece_to_id(f"<0x{b:02X}>")] += c
        got = [0.0] * sp.get_piece_size()
        lattice.expect(word, c, got)
        assert np.allclose(got, want)


def test_document_scores_brute_force(spark, pieces):
    """score and mixture_score of whole texts, learnt and summed by enumerating all segmentations."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    ids = piece_ids(sp)
    rows = [(k, words(k, 12, "aent")) for k in range(12)] + [(12, "Unseen ANT"), (13, None)]
    train = Counter(w for i, t in rows if i < 10 for w in (t or "").lower().split())

    def shares(counts):
        counts = np.array(counts) + 0.5
        return np.log10(counts / (counts.sum() + 10 + 0.5)), math.log10(10.5 / (counts.sum() + 10 + 0.5))

    first = np.zeros(sp.get_piece_size())
    for w, c in train.items():
        np.add.at(first, sp.encode(w), c)
    scores, end = shares(first)
    for _ in range(M.ROUNDS):
        counts = np.zeros(sp.get_piece_size())
        for w, c in train.items():
            ways = [(x, 10 ** sum(scores[i] for i in x)) for x in segmentations("▁" + w, ids)]
            for x, p in ways:
                np.add.at(counts, x, c * p / sum(p for _, p in ways))
        scores, end = shares(counts)
    lp = {w: math.log10(sum(10 ** sum(scores[i] for i in x) for x in segmentations("▁" + w, ids))) for w in {w for _, t in rows for w in (t or "").lower().split()}}
    once, twice, n = sum(c == 1 for c in train.values()), sum(c == 2 for c in train.values()), sum(train.values()) + 10
    d = once / (once + 2 * twice) if once else 0.5
    mixed = {w: math.log10(10 ** lp[w] * d * len(train) / n + max(train[w] - d, 0) / n) for w in lp}
    out = {r.doc_id: r for r in M.score_documents(frame(spark, rows), pieces, F.col("doc_id") < 10).collect()}
    for i, t in rows:
        ws = (t or "").lower().split()
        assert out[i].score == pytest.approx(sum(lp[w] for w in ws) + end) and out[i].mixture_score == pytest.approx(sum(mixed[w] for w in ws) + math.log10(10 / n))
        assert out[i].n_tokens == len(ws) + 1 and out[i].n_known == sum(w in train for w in ws) + 1


def test_scores_by_hand(spark, pieces, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(M, "COMMON", 5)
    rows = [(k, words(k, 40)) for k in range(40)] + odd_rows()
    out = M.score_documents(frame(spark, rows), pieces, F.coalesce(F.col("doc_id"), F.lit(1)) % 5 != 1).collect()
    assert len(out) == len(rows)
    count, ends = Counter(), 0
    for i, t in rows:
        if (1 if i is None else i) % 5 != 1:
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(i), round(sum(log(count[w]) for w in (t or "").encode().lower().split()) + log(ends), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert M.score_documents(frame(spark, []), pieces, F.lit(True)).count() == 0
    assert M.score_documents(frame(spark, rows[:3]), pieces, F.lit(False)).count() == 3


def test_probabilities_of_words_sum_below_one(spark, pieces):
    docs = frame(spark, [(k, "aa bb aa cc") for k in range(5)])
    out = M.score_documents(frame(spark, [(1, "aa"), (2, "bb"), (3, "cc"), (4, "dd")]).unionAll(docs), pieces, F.col("text") == "aa bb aa cc").collect()
    single = {r.doc_id: 10**r.score for r in out if r.n_tokens == 2}
    assert single[1] > single[2] > single[4] and sum(single.values()) < 1


def test_toxicity_finds_planted_words_and_misspellings():
    bad = ["idiotic", "moronish", "scumbag"]
    texts, labels = [], []
    for k in range(400):
        ws = words(k, 60).split()
        if k % 4 == 0:
            ws[k % 50] = bad[k % 3]
            ws[(k * 7) % 50] = bad[(k + 1) % 3]
        texts.append(" ".join(ws))
        labels.append(int(k % 4 == 0))
    bags = [np.unique(X.subwords(t), return_counts=True) for t in texts]
    model = X.train(bags[:320], np.array(labels[:320]), steps=30_000)
    model = X.calibrate(model, np.array([model.margin(X.subwords(t)) for t in texts[320:]]), np.array(labels[320:]))
    clean = [words(1000 + k, 60) for k in range(50)]
    assert sum(model.score(t) >= 0.5 for t in clean) <= 2
    assert sum(model.score(t + " idiiotic scumbagg moronnish") >= 0.5 for t in clean) >= 45
    assert model.score("") < 0.5 and model.score(None) == model.score("")


def test_toxicity_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "STEPS", 1000)
    rows = [(k, words(k, 20) + (" horrid" if k % 2 else "")) for k in range(60)] + odd_rows()
    docs = frame(spark, rows).withColumn("toxic", F.when(F.col("doc_id") < 60, (F.col("doc_id") % 2).cast("int")))
    out = X.score(docs, X.fit(docs)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    empty = X.fit(docs.limit(0))
    assert empty.score("x") == 0.5 and X.score(frame(spark, []), empty).count() == 0


def test_language_features_brute_force():
    def naive(text):
        code, seen = [ord(c) for c in text.lower()], Counter()
        for n in I.ORDERS:
            for k in range(len(code) - n + 1):
                h = 0
                for d in range(n):
                    h = ((h ^ h >> 13 if d else 0) + code[k + d]) * 0x9E3779B1 % (1 << 32)
                seen[(((h ^ h >> 15) * 0x85EBCA6B + n) % (1 << 32)) >> 17] += 1
        return dict(sorted(seen.items()))

    for text in ("", "a", "Ab", "Das ist ñ 漢字 🙂 das", words(4, 40)):
        found, counts = I.ngram_counts(text)
        assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == naive(text)


def test_ftrl_brute_force():
    """Weights against follow-the-regularised-leader coordinate by coordinate, in plain Python."""
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(9, 4, replace=False)), rng.uniform(0.1, 1, 4)) for _ in range(14)]
    labels = rng.integers(0, 3, 14)
    labels[:3] = [0, 1, 2]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    z, n = Counter(), Counter()

    def weight(f, c):
        return 0.0 if abs(z[f, c]) <= l1 else -(z[f, c] - math.copysign(l1, z[f, c])) / ((beta + math.sqrt(n[f, c])) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(4):
        for k in order.permutation(14):
            found, value = rows[k]
            w = {(f, c): weight(f, c) for f in found for c in range(3)}
            scores = [sum(v * w[f, c] for f, v in zip(found, value, strict=True)) for c in range(3)]
            e = [math.exp(x - max(scores)) for x in scores]
            for f, v in zip(found, value, strict=True):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == labels[k])) / (3 * (labels == labels[k]).sum() / 14)
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha * w[f, c]
                    n[f, c] += g * g
    got = I.fit_ftrl(rows, labels, 3)
    assert np.allclose(got[:9], [[weight(f, c) for c in range(3)] for f in range(9)]) and not got[9:].any()


def test_toxicity_subwords_brute_force():
    def naive(text):
        out = Counter()
        for word in dict.fromkeys(text.lower().encode().split()):
            code = b" " + word + b" "
            for n in X.ORDERS:
                for k in range(len(code) - n + 1):
                    h = code[k]
                    for b in code[k + 1 : k + n]:
                        h = (h * 0x01000193 % (1 << 32)) ^ b
                    out[((h ^ h >> 15) * 0x85EBCA6B % (1 << 32)) >> 12] += 1
        return out

    for text in ("", "a", "ab Ab abc", "ünï 漢字 🙂 x", words(5, 30)):
        assert Counter(X.subwords(text).tolist()) == naive(text)


def test_toxicity_step_brute_force():
    """One pass of joint training against the gradients of the log loss, taken by differences."""
    bags = [(np.array([1, 5, 9]), np.array([2, 1, 1]))]
    model = X.train(bags, np.array([1]), width=2, steps=1)
    out = np.zeros((2, 2))
    out[:, 1] = np.random.default_rng(5).normal(0, 0.5, 2)
    out[:, 0] = -out[:, 1]
    part = X.SCALE * bags[0][1] / (4 + X.PAD)

    def loss(rows):
        zs = part @ rows @ out + np.log([0.25, 0.75])
        return -(zs[1] - np.log(np.exp(zs).sum()))

    slope = np.zeros((3, 2))
    for k in range(3):
        for w in range(2):
            up = np.zeros((3, 2))
            up[k, w] = 1e-6
            slope[k, w] = (loss(up) - loss(-up)) / 2e-6
    # the softmax does not move while all vectors are null
    assert np.allclose(model.difference[[1, 5, 9]], -0.5 * slope @ (out[:, 1] - out[:, 0]), atol=1e-5)


def test_toxicity_query(spark, tmp_path, monkeypatch):
    """Each score is the model's of that text alone, and labels of held-out rows change nothing."""
    monkeypatch.setattr(X, "STEPS", 1000)
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, DATA).collect()}
    turned = {r.doc_id: r.score for r in QUERIES["op6_toxicity"](spark, str(tmp_path)).collect()}
    assert {i: r.score for i, r in got.items()} == turned and all(r.held_out == (fold(i) == 0) for i, r in got.items())
    model = X.fit(X.labelled_sample(docs, labels.filter(~held)))
    assert len(got) == docs.count() and all(got[r.doc_id].score == model.score(r.text) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) for r in docs.collect())


def test_clashing_columns(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    docs = frame(spark, [(k, words(k, 5)) for k in range(20)]).withColumn("toxic", F.lit("other"))
    rows = X.labelled_sample(docs, labels)
    assert rows.count() == 20 and rows.filter("toxic not in (0, 1)").isEmpty()
