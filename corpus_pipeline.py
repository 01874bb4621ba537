"""A training-data pipeline over documents, in five stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents. Every stage takes null ids and texts, empty
and very long texts and repeated rows, and an empty table gives an empty result; what each does with them stands below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.decontamination import contamination
from locusframe.llm.language_id import UNKNOWN, fit, identify
from locusframe.llm.line_dedup import dedup_lines
from locusframe.llm.near_copies import drop_near_copies
from locusframe.llm.sentencepiece_codec import digest_texts, read_model
from locusframe.llm.shared import materialise

#: How far from chance, 1 over the number of languages, towards 1 the calibrated probability of a text in one of them is at least.
#: With four languages that is 0.34: random letters and foreign alphabets get 0.25 to 0.30, and the least of 51,282 documents 0.39.
OVER_CHANCE = 0.12
#: Words that a worker remembers in the last stage, where it also holds what earlier stages have left in its memory.
REMEMBERED = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; texts without a letter, null and empty ones among them, and those of no clear language
    go. Each row is judged by its text alone, so repeated rows go or stay together."""
    model = fit(docs)
    chance = 1 / max(1, len(model.labels))
    least = chance + OVER_CHANCE * (1 - chance)
    return identify(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of repeated three-line windows; n_chars follows the text. Null texts stay
    null; the first occurrence is that of the least id, null ids before all."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more, links chain.

    The row of the least id stays, of one id that of the smaller text hash, rows without id after all others; of rows equal
    in id and text one stays. Null and blank texts are one group."""
    return drop_near_copies(docs).select(docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; null and empty texts are clean, and repeated rows go or stay
    together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).filter(~F.col("contaminated")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids and decoded text, as digests, a row for each row; null texts count as empty."""
    out = digest_texts(docs, read_model(public_tokenizers.path("piece_bpe_32k.model")), remembered=REMEMBERED)
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express language ID; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
