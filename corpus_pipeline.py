"""A corpus from documents to tokens: STAGES in order, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidframe.llm import exact_dedup, language_id, minhash, mixing, pieces
from lucidframe.llm.common import materialize
from lucidframe.llm.queries import table, tokenizer_file

#: Similarity in percent from which documents are near copies; op3_minhash has its own, 85.
NEAR = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the models are fitted on pages."""
    labelled = language_id.sample_pages(table(spark, sf_dir, "pages"))
    return language_id.drop_unidentified(docs, declared=F.col("lang"), host=F.col("source"), labelled=labelled)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near-duplicates, linked from a similarity of NEAR percent on, the smallest id stays."""
    return minhash.drop_near_duplicates(docs, percent=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order in which it serves them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return pieces.encode(docs, tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express MinHash candidates, trained trigram models or the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
