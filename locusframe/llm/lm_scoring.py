"""Document likelihood under a subword lattice.

The vocabulary is the piece list of a public model, which has no unigram scores of its own, so these are learnt from
all training words: first each piece's count in the model's own segmentation, plus one half, and then rounds of
expectation maximisation, in which a piece counts as often as it is expected on the lattice, by the forward and
backward sums over all segmentations of every counted word. A word's probability is the sum over all its
segmentations into pieces, taken by the forward recursion in log space. Pieces never reach over word borders, so a
document's marginal is the product over its words and the end.

Beside it stands a mixture: a word seen in training is one more edge over its whole length, of weight (c - d) / N, and
the mass that the discount d frees goes to the paths of pieces.

Each different word of the corpus is counted and scored once, in a distributed table. Documents are dealt
into blocks of bounded size; a block asks for its different words only, and the answers come back to it. A fixed
number of the commonest words, which every block would ask for, goes to all of them at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .shared import materialise

SPACE = "▁"
#: Bytes of text in one block on average.
BLOCK_BYTES = 16 << 20
#: Rounds of expectation maximisation.
ROUNDS = 1
#: How many of the commonest words are sent to all blocks; results do not depend on it.
COMMON = 4096
#: Up to this many characters sums are taken of probabilities, beyond it, or where these vanish, of logarithms.
_SHORT = 40
#: Different words that a task holds before it hands its counts on.
_FLUSH = 300_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class Lattice:
    """Sums over all segmentations, with log10 scores of a model's pieces."""

    def __init__(self, model: bytes, scores: np.ndarray):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = ahocorasick.Automaton()
        self.known = set()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.log = (np.asarray(scores, float) * math.log(10)).tolist()
        self.p = np.exp(self.log).tolist()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            self.pieces.add_word(piece, (len(piece), i))
            if len(piece) == 1:
                self.known.add(piece)
        self.pieces.make_automaton()

    def _runs(self, word: str) -> Iterator[tuple[str, list[int]]]:
        """A word, its leading space included, in runs of characters that are pieces, each with the bytes' pieces that spell
        the character behind it."""
        text = SPACE + word
        if self.known.issuperset(text):
            yield text, []
            return
        run = ""
        for c in text:
            if c in self.known:
                run += c
                continue
            yield run, [self.bytes[b] for b in c.encode()]
            run = ""
        yield run, []

    def _forward(self, text: str) -> float:
        log1p, exp, log = math.log1p, math.exp, self.log
        alpha: list = [None] * (len(text) + 1)
        alpha[0] = 0.0
        for end, (size, i) in self.pieces.iter(text):
            path = alpha[end + 1 - size] + log[i]
            old = alpha[end + 1]
            if old is None:
                alpha[end + 1] = path
            elif old > path:
                alpha[end + 1] = old + log1p(exp(path - old))
            else:
                alpha[end + 1] = path + log1p(exp(old - path))
        return alpha[-1]

    def log10_probability(self, word: str) -> float:
        """Marginal of a word, its leading space included; characters without a piece are spelt in bytes."""
        total = 0.0
        for run, spelt in self._runs(word):
            total += (self._forward(run) if run else 0.0) + sum(self.log[i] for i in spelt)
        return total / math.log(10)

    def _expect_run(self, text: str, weight: float, counts: list[float]) -> None:
        # edges come by their end, so all that lead to a place come before those that leave it
        edges = [(end + 1 - size, end + 1, i) for end, (size, i) in self.pieces.iter(text)]
        n = len(text)
        if n <= _SHORT:
            p = self.p
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            alpha[0] = beta[n] = 1.0
            for start, end, i in edges:
                alpha[end] += alpha[start] * p[i]
            if alpha[n] > 1e-280:
                for start, end, i in reversed(edges):
                    beta[start] += p[i] * beta[end]
                unit = weight / alpha[n]
                for start, end, i in edges:
                    counts[i] += unit * alpha[start] * p[i] * beta[end]
                return
        log, none = self.log, float("-inf")
        front, back = [none] * (n + 1), [none] * (n + 1)
        front[0] = back[n] = 0.0
        for start, end, i in edges:
            front[end] = _log_add(front[start] + log[i], front[end])
        for start, end, i in reversed(edges):
            if back[end] > none:
                back[start] = _log_add(back[end] + log[i], back[start])
        for start, end, i in edges:
            counts[i] += weight * math.exp(front[start] + log[i] + back[end] - front[n])

    def expect(self, word: str, weight: float, counts: list[float]) -> None:
        """Add weight times how often each piece is expected among a word's segmentations."""
        for run, spelt in self._runs(word):
            if run:
                self._expect_run(run, weight, counts)
            for i in spelt:
                counts[i] += weight


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """(word, c): every word of docs and how often it stands in training rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": list(held), "c": list(held.values())})

        for batch in batches:
            for text, learn in zip(batch["text"], batch["learn"], strict=True):
                words = words_of(text)
                if learn:
                    held.update(words)
                else:
                    for word in words:
                        if word not in held:
                            held[word] = 0
                if len(held) > _FLUSH:
                    yield rows()
                    held = Counter()
        yield rows()

    rows = docs.select(F.col(text_col).alias("text"), train.alias("learn"))
    return rows.mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_scores(words: DataFrame, model: bytes, ends: int) -> tuple[np.ndarray, float]:
    """log10 probability of each piece and of the end, from counted training words."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            weights = batch["c"].tolist()
            for at in range(0, len(weights), 10_000):
                some = [w.decode() for w in batch["word"].iloc[at : at + 10_000]]
                for ids, c in zip(sp.encode(some, num_threads=1), weights[at : at + 10_000], strict=True):
                    for i in ids:
                        total[i] += c
        found = np.flatnonzero(total)
        yield pd.DataFrame({"piece": found, "n": total[found].astype(float)})

    return _scores(words.filter("c > 0").mapInPandas(count, "piece int, n double"), model, ends)


def _scores(counted: DataFrame, model: bytes, ends: int) -> tuple[np.ndarray, float]:
    """log10 probabilities from counts (piece, n) of any number of tasks; one row a piece reaches the driver."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    counts = np.full(sp.get_piece_size(), 0.5)
    for r in counted.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[r.piece] += r.n
    total = counts.sum() + ends + 0.5
    return np.log10(counts / total), math.log10((ends + 0.5) / total)


def expected_scores(words: DataFrame, model: bytes, scores: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """One round of expectation maximisation: piece_scores anew, with the counts that are expected under scores."""
    shared = words.sparkSession.sparkContext.broadcast((model, scores))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*shared.value)
        total = [0.0] * len(scores)
        for batch in batches:
            for word, c in zip(batch["word"], batch["c"].tolist(), strict=True):
                lattice.expect(word.decode(), float(c), total)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"piece": found, "n": np.array(total)[found]})

    return _scores(words.filter("c > 0").mapInPandas(count, "piece int, n double"), model, ends)


def score_documents(docs: DataFrame, model: bytes, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, mixture_score), one row for each row of docs.

    train tells which rows are learnt from. score is the lattice's marginal, mixture_score that with whole words. Null
    texts count as empty: one token, the end. Repeated rows and null ids are scored like any other. Without training
    rows every word is unknown and pieces are equally likely. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    counted = docs.select(train.alias("learn"), F.octet_length(F.col(text_col)).alias("size"))
    about = counted.agg(F.count_if("learn").alias("ends"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    words = materialise(word_counts(docs, text_col, train), "lm-words")
    about_c = [F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")]
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *about_c).first()
    tokens, distinct = seen.n + about.ends, seen.v + (about.ends > 0)
    scores, end_score = piece_scores(words, model, about.ends)
    for _ in range(ROUNDS if seen.v else 0):
        scores, end_score = expected_scores(words, model, scores, about.ends)
    discount = seen.once / (seen.once + 2 * seen.twice) if seen.once else 0.5
    freed = discount * seen.v / tokens if seen.v else 1.0
    mixture_end = math.log10(about.ends / tokens) if about.ends else end_score
    shared = spark.sparkContext.broadcast((model, scores))

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            yield batch.assign(lp=[lattice.log10_probability(w.decode()) for w in batch["word"]])

    scored = materialise(words.mapInPandas(forward, "word binary, c long, lp double"), "lm-scores")
    top = {bytes(r.word): (r.c, r.lp) for r in scored.orderBy(F.desc("c"), "word").limit(COMMON).collect()}
    common = spark.sparkContext.broadcast(top)
    blocks = max(1, -(-about.size // BLOCK_BYTES))
    # rows are dealt by number, so that no id or text makes a block large
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).drop("rid").repartition(blocks, "block")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, set] = {}
        sent = common.value.keys()

        def rows() -> pd.DataFrame:
            asked = [s - sent for s in held.values()]
            return pd.DataFrame({"block": np.repeat(list(held), [len(s) for s in asked]), "word": [w for s in asked for w in s]})

        for batch in batches:
            for block, text in zip(batch["block"].tolist(), batch["text"], strict=True):
                held.setdefault(block, set()).update(words_of(text))
            if sum(map(len, held.values())) > 2 * _FLUSH:
                yield rows()
                held = {}
        if held:
            yield rows()

    # every word that a block asks for is in the table, once for each block
    asked = dealt.mapInPandas(ask, "block int, word binary").distinct()
    answers = asked.join(scored, "word")
    low = tokens + 0.5 * (distinct + 1)
    end_base = math.log10((about.ends + 0.5) / low)

    def finish(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        sent = common.value
        place = dict(zip(found["word"], range(len(found)), strict=True)) | dict(zip(sent, range(len(found), len(found) + len(sent)), strict=True))
        c = np.concatenate([found["c"].to_numpy(np.int64), np.array([v[0] for v in sent.values()], np.int64)])
        lp = np.concatenate([found["lp"].to_numpy(np.float64), np.array([v[1] for v in sent.values()], np.float64)])
        base = np.log10((c + 0.5) / low)
        whole = np.log10(np.maximum(c - discount, 1e-300) / max(tokens, 1))
        mixed = np.logaddexp((lp + math.log10(freed)) * math.log(10), whole * math.log(10)) / math.log(10)
        out = []
        for text in texts["text"]:
            words = words_of(text)
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            known = int((c[at] > 0).sum()) + (about.ends > 0)
            out.append((len(words) + 1, known, tokens, float(base[at].sum()) + end_base, float(lp[at].sum()) + end_score, float(mixed[at].sum()) + mixture_end))
        frame = pd.DataFrame(out, columns=["n_tokens", "n_known", "train_tokens", "base_score", "score", "mixture_score"])
        return pd.concat([texts[["id"]].reset_index(drop=True), frame], axis=1)

    names = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).fields
    longs = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
    out = T.StructType(names + longs + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "mixture_score")])

    def named(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return finish(key, texts, found).rename(columns={"id": id_col})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(named, out)
