"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed into 2^15 features. Document
frequencies come from all training rows. The model is fitted by follow-the-regularised-leader with L1 and L2
penalties on at most `max_rows` training rows, those with the smallest hash of their id and text; a fifth of
them, kept aside, calibrate the temperature by which the scores are divided before the softmax.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import fresh, hashed_sample, text_key

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(FEATURES, np.int64)
    rolled = np.zeros(len(code), np.uint32)
    for n in ORDERS:
        if len(code) < n:
            break
        rolled = (rolled[: len(code) - n + 1] + code[n - 1 :]) * _MIX
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        total += np.bincount((mixed >> np.uint32(17)).astype(np.int64), minlength=FEATURES)
        rolled = rolled ^ (rolled >> np.uint32(13))
    found = np.flatnonzero(total)
    return found, total[found]


def tfidf(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log-scaled term frequencies times idf, to unit length."""
    value = (1 + np.log(counts)) * idf[found]
    norm = np.sqrt((value * value).sum())
    return value / norm if norm else value


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """The label and its calibrated probability; und with 0 for texts without a letter or an empty model."""
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        found, counts = ngram_counts(text)
        p = softmax(tfidf(found, counts, self.idf) @ self.weights[found] / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, rounds: int = 4) -> np.ndarray:
    """FTRL-proximal weights (features x classes); labels weigh inversely to their number."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        w[np.abs(z) <= l1] = 0
        return w

    share = np.bincount(labels, minlength=classes) / max(1, len(labels))
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            found, value = rows[k]
            w = solve(z[found], n[found])
            p = softmax(value @ w)
            p[labels[k]] -= 1
            g = value[:, None] * (p / (classes * share[labels[k]]))
            sigma = (np.sqrt(n[found] + g * g) - np.sqrt(n[found])) / alpha
            z[found] += g - sigma * w
            n[found] += g * g
    return solve(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search between 1/64 and 16.

    The true label's target is (n+1)/(n+2), not 1, so that few or easily parted rows give no certainty.
    """
    if not len(labels) or scores.shape[1] < 2:
        return 1.0
    n = len(labels)
    target = np.full(scores.shape, 1 / (n + 2) / (scores.shape[1] - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        return -(target * np.log(softmax(scores / np.exp(t)) + 1e-300)).sum()

    low, high, ratio = np.log(1 / 64), np.log(16), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(rows: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many rows each feature occurs, and the number of rows; tasks send one count a feature at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.iloc[:, 0]:
                if text:
                    df[ngram_counts(text)[0]] += 1
                n += 1
        found = np.flatnonzero(df)
        yield pd.DataFrame({"f": np.append(found, FEATURES), "n": np.append(df[found], n)})

    sums = rows.select(F.col(text_col)).mapInPandas(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1, np.int64)
    for r in sums:
        df[r.f] = r.n
    return df[:FEATURES], int(df[FEATURES])


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", max_rows: int = 4_000) -> Model:
    """A model of rows that have a label and a text; no such row gives a model that always answers und."""
    ship_package(rows.sparkSession)
    rows = rows.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    df, n = document_frequencies(rows, "text")
    idf = np.log((1 + n) / (1 + df)) + 1

    @F.pandas_udf("f binary, n binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[x.astype("<u4").tobytes() for x in ngram_counts(t)] for t in texts], columns=["f", "n"])

    chosen = hashed_sample(rows, F.xxhash64(F.col("id").cast("string"), text_key(F.col("text")), "label"), n, max_rows)
    sample = chosen.select(features("text").alias("x"), "label").select("x.f", "x.n", "label").toPandas()
    labels = sorted(sample["label"].unique())
    y = np.array([labels.index(v) for v in sample["label"]], int)
    read = [(np.frombuffer(f, "<u4"), np.frombuffer(c, "<u4")) for f, c in zip(sample["f"], sample["n"], strict=True)]
    x = [(f, tfidf(f, c, idf).astype(np.float32)) for f, c in read]
    aside = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    weights = fit_ftrl([x[k] for k in np.flatnonzero(~aside)], y[~aside], len(labels)) if len(labels) else np.zeros((FEATURES, 0))
    held = np.array([x[k][1] @ weights[x[k][0]] for k in np.flatnonzero(aside)]).reshape(-1, max(1, len(labels)))
    return Model(labels, weights, idf, fit_temperature(held, y[aside]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns so named are replaced); null, empty and letterless texts are und, 0."""
    spark = docs.sparkSession
    ship_package(spark)
    # its size is fixed: features times labels
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    (out,) = fresh(docs, "lang_out")
    return docs.drop("lang_pred", "score").withColumn(out, run(F.col(text_col))).select("*", f"{out}.lang_pred", f"{out}.score").drop(out)
