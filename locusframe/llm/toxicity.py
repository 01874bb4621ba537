"""Toxicity by subword-bag embeddings that are averaged into a linear softmax.

A text is the bag of the byte n-grams (3 to 5) of its different lower-cased words, word borders included,
hashed into 2^20 rows of an embedding table. The average runs over the bag and `PAD` null vectors, so that a
few odd n-grams do not decide a short text. Embeddings and softmax are trained jointly in numpy by gradient
descent on at most `max_rows` labelled rows, those with the smallest hash of their id and text; a fifth of
them, kept aside, calibrate the score. A misspelt word shares most of its n-grams, and so its vectors, with
the word it stands for. As the softmax is linear in the average, its two classes reduce to one number a
table row when texts are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import hashed_sample, text_key

ROWS = 1 << 20
ORDERS = (3, 4, 5)
#: Averages over long bags are small; this fixed factor brings them to the softmax's scale.
SCALE = 100.0
PAD = 400
#: Steps of gradient descent, a text each.
STEPS = 50_000
#: A missed toxic document weighs so many times a clean one that is taken for toxic.
WEIGHT = 3.0
_M = np.uint32(0x01000193)


def subwords(text: str | None) -> np.ndarray:
    """Table rows of all n-grams of the different words of a text; n-grams do not reach over word borders."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int64)
    code = np.frombuffer(b" " + b" ".join(dict.fromkeys(words)) + b" ", np.uint8)
    blank = code == 32
    plain = code.astype(np.uint32)
    rolled = plain
    inner = np.zeros(len(code), bool)
    out = []
    for n in range(2, ORDERS[-1] + 1):
        size = len(code) - n + 1
        if size < 1:
            break
        rolled = (rolled[:size] * _M) ^ plain[n - 1 :]
        # a border inside the n-gram, its ends aside
        inner = inner[:size] | blank[n - 2 : n - 2 + size] if n > 2 else inner[:size]
        if n in ORDERS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((mixed >> np.uint32(12))[~inner])
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    difference: np.ndarray
    bias: float

    def margin(self, rows: np.ndarray) -> float:
        return self.bias + SCALE * float(self.difference[rows].sum()) / (len(rows) + PAD)

    def score(self, text: str | None) -> float:
        """Probability of the label 1; texts without a subword get that of the bias alone."""
        return float(1 / (1 + np.exp(-np.clip(self.margin(subwords(text)), -500, 500))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, width: int = 8, rate: float = 0.5, steps: int | None = None) -> Model:
    """bags: for each text its different table rows and how often each occurs."""
    rng = np.random.default_rng(5)
    table = np.zeros((ROWS, width), np.float32)
    out = np.zeros((width, 2), np.float32)
    out[:, 1] = rng.normal(0, 0.5, width)
    out[:, 0] = -out[:, 1]
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = np.log([1 - share, share])
    rounds = -(-(steps or STEPS) // max(1, len(labels)))
    for r in range(rounds):
        step = rate * (1 - r / rounds)
        for k in rng.permutation(len(labels)):
            rows, counts = bags[k]
            part = (SCALE * counts / (counts.sum() + PAD)).astype(np.float32)
            h = part @ table[rows]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = (out @ p).astype(np.float32)
            out -= (step * 0.1 / max(1.0, np.abs(h).max()) * np.outer(h, p)).astype(np.float32)
            bias -= step * 0.01 * p
            table[rows] -= np.float32(step) * part[:, None] * back
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def calibrate(model: Model, margins: np.ndarray, labels: np.ndarray, weight: float = WEIGHT) -> Model:
    """Scale and shift of the margin by which held-aside labels are likeliest, rows of label 1 counted `weight` times, with a
    weak pull to no change."""
    if labels.min(initial=1) == labels.max(initial=0):
        return model
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], 1)
    heavy = np.where(labels == 1, weight, 1.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = x.T @ (heavy * (p - labels)) + 0.5 * np.array([a - 1, b])
        h = (x * (heavy * p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.5
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
    a = max(a, 0.05)
    return Model((a * model.difference).astype(np.float32), a * model.bias + b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = 8_000) -> DataFrame:
    """docs of at most max_rows labels, those with the smallest hash of their id; their number bounds the broadcast.

    The sample is drawn before the texts come in, so no text is shuffled. Labels other than 0 and 1 are left
    out; an id with both has a row for each. A column of docs that is named as the label is replaced.
    """
    known = labels.select(id_col, label_col).filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).distinct()
    chosen = hashed_sample(known, F.xxhash64(F.col(id_col).cast("string"), label_col), known.count(), max_rows)
    return docs.drop(label_col).join(F.broadcast(chosen), id_col)


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = 8_000) -> Model:
    """A model of rows with label 0 or 1; null labels are left out, null texts count as empty. Without rows: always 0.5."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("f binary, n binary")
    def bag(texts: pd.Series) -> pd.DataFrame:
        rows = [[x.astype("<u4").tobytes() for x in np.unique(subwords(t), return_counts=True)] for t in texts]
        return pd.DataFrame(rows, columns=["f", "n"])

    text = F.coalesce(text_col, F.lit(""))
    rows = rows.filter(F.col(label_col).isin(0, 1))
    named = rows.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), F.col(label_col).cast("int").alias("y"))
    chosen = hashed_sample(named, F.xxhash64("id", text_key(F.col("text")), "y"), rows.count(), max_rows)
    sample = chosen.select(bag("text").alias("x"), "y").select("x.f", "x.n", "y").toPandas()
    if not len(sample):
        return Model(np.zeros(ROWS, np.float32), 0.0)
    bags = [(np.frombuffer(f, "<u4"), np.frombuffer(n, "<u4")) for f, n in zip(sample["f"], sample["n"], strict=True)]
    y = sample["y"].to_numpy(int)
    aside = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    model = train([bags[k] for k in np.flatnonzero(~aside)], y[~aside])
    held = np.array([model.margin(np.repeat(bags[k][0], bags[k][1].astype(int))) for k in np.flatnonzero(aside)])
    return calibrate(model, held, y[aside])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score and predicted (columns so named are replaced), for every row by its text alone; null texts count as
    empty, equal texts get equal scores, and an empty table gives an empty result."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    out = docs.drop("score", "predicted").withColumn("score", run(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
