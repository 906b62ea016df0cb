"""The corpus pipeline: five stages from ``documents`` to token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept;
its result is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``.

1. ``language_id`` learns from the rows that name a language and drops texts the model
   rejects: without a letter, or far from every centroid.
2. ``exact_dedup`` keeps the smallest doc_id of each group of equal texts.
3. ``ngram_join`` keeps the smallest doc_id of each group of linked texts.
4. ``mixing`` returns the mix: per document and pass over its source, the words taken.
5. ``byte_bpe`` returns each row's token ids, with digests of the ids and of their decoding.

Empty tables pass through every stage. Rows of null text leave at the first stage.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leafmill.llm import bpe, exact_dedup, language, mixing, ngram_join, queries  # noqa: E402
from leafmill.session import written  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    return language.identified(docs, model).filter("NOT rejected").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encoded_rows(docs, *queries.ranks(), ids=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Clustering, similarity links and hash permutations have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
