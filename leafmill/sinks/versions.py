"""Published corpora in versions: a new one is whole before anything names it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"


def place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place in one step."""
    staged, store = place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = store.create(staged)
    stream.write(text.encode())
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    target = hadoop.Path(path)
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, target, overwrite)


def current(spark: SparkSession, root: str, name: str) -> dict | None:
    """What is published under a name: ``version``, ``schema``, ``records`` by split, and the version ``before``."""
    target, store = place(spark, f"{root.rstrip('/')}/{name}/{POINTER}")
    if not store.exists(target):
        return None
    return json.loads(spark.read.text(target.toString(), wholetext=True).first()[0])


def publish_version(corpus: DataFrame, root: str, name: str, records_per_file: int = 100_000) -> dict:
    """Sharded Parquet in a folder of its own, then the pointer that names it; returns the pointer.

    A job that fails leaves a folder that nothing names, and what was published stays. The
    version before the new one is kept for readers that have begun, older ones go.
    """
    spark = corpus.sparkSession
    target, version = f"{root.rstrip('/')}/{name}", uuid.uuid4().hex
    before = current(spark, root, name) or {"version": None, "before": None}
    folder, store = place(spark, f"{target}/data/{version}")
    try:
        corpus.write.option("maxRecordsPerFile", records_per_file).partitionBy("split").parquet(folder.toString())
    except Exception:
        store.delete(folder, True)
        raise
    saved = spark.read.parquet(folder.toString())
    records = {r.split: r.n for r in saved.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    pointer = {"version": version, "schema": json.loads(saved.schema.json()), "records": records, "before": before["version"]}
    replace_file(spark, f"{target}/{POINTER}", json.dumps(pointer))
    if before["before"]:
        old, store = place(spark, f"{target}/data/{before['before']}")
        store.delete(old, True)
    return pointer


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of the published version."""
    found = current(spark, root, name)
    if found is None:
        raise FileNotFoundError(f"nothing is published as {name} under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/data/{found['version']}")
