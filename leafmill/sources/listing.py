"""Repository and folder listings, as delivered by a code host, read as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING_DDL = "name string, clone_url string"
FOLDER_DDL = "repo_name string, name string, type string"


def read_repo_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing files (JSON arrays or lines) to ``name, clone_url``."""
    return normalise_listing(spark.read.schema(LISTING_DDL).option("multiLine", "true").json(path))


def normalise_listing(listing: DataFrame) -> DataFrame:
    """Keep entries that say where to clone from; the rest is skipped."""
    return listing.filter(F.col("clone_url").isNotNull()).select("name", "clone_url")


def read_folder_listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOLDER_DDL).option("multiLine", "true").json(path)
