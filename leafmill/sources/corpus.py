"""Saved corpora, reloaded by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.schema import CORPUS_FOLDERS


def load_corpus(spark: SparkSession, output_dir: str, kind: str = "standard") -> DataFrame:
    """Corpus of one kind below ``output_dir``; unknown kinds mean ``standard``.

    ``split`` is a partition column, so a filter on it prunes whole folders.
    """
    folder = CORPUS_FOLDERS.get(kind, CORPUS_FOLDERS["standard"])
    return spark.read.parquet(f"{output_dir.rstrip('/')}/{folder}")
