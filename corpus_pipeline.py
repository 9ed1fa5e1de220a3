"""A training-data pipeline: five stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardrail_spark.llm import bpe, mixing, neardup, substring, toxicity
from guardrail_spark.llm.common import settled
from guardrail_spark.llm.queries import TOKENIZERS, VOCABULARY, table

#: Half of the low domain's tokens go. Memberships are soft, so no rates up to one can do so and keep all of the good one's.
TARGETS = {"low": 0.5, "good": 0.99}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~F.expr(toxicity.held_out_rule()))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component (five words, 0.8): one with its least id. Rows are told apart as such:
    different texts under one id both stay, and rows without an id are judged like all others. Texts without words stay."""
    return neardup.one_of_each(docs, size=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document of which nothing is left goes."""
    cut = substring.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by rates of one at most that halve the low domain's tokens."""
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"), TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.bpe(docs, f"{TOKENIZERS}/{VOCABULARY}")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_domains),
    ("bpe", encode),
]

#: Decoding, sketches, fitted rates and BPE aren't expressible in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
    return docs
