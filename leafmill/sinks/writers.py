"""Writers. Every one is a distributed write; nothing passes through the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.schema import CORPUS_FOLDERS, CSV_COLUMNS
from leafmill.session import slim_batches

# Doubled quotes, untouched outer blanks, empty strings as nothing.
CSV_WRITE = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
CSV_READ = {**CSV_WRITE, "multiLine": "true"}


def write_csv(records: DataFrame, output_dir: str, mode: str = "overwrite") -> None:
    """``train.csv``, ``test.csv`` (as ``split=`` folders) and ``metadata.csv``.

    The text column is never selected, so the scan below does not read it.
    """
    records.select(*CSV_COLUMNS).write.mode(mode).options(**CSV_WRITE).csv(f"{output_dir}/metadata.csv")
    # The per-split folders come from what was written: the records are made once.
    flat = read_csv(records.sparkSession, output_dir).withColumn("_split", F.col("split"))
    flat.write.mode(mode).options(**CSV_WRITE).partitionBy("_split").csv(f"{output_dir}/csv_by_split")


def read_csv(spark: SparkSession, output_dir: str, which: str = "metadata") -> DataFrame:
    """One CSV output: ``train``, ``test`` or ``metadata``."""
    folder = "metadata.csv" if which == "metadata" else f"csv_by_split/_split={which}"
    kinds = {"file_size": "long", "is_api_spec": "boolean", "is_sdk_file": "boolean"}
    ddl = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in CSV_COLUMNS)
    rows = spark.read.schema(ddl).options(**CSV_READ).csv(f"{output_dir}/{folder}")
    # The file cannot tell an empty string from no value; records have no NULLs.
    return rows.fillna("")


def write_corpus(corpus: DataFrame, output_dir: str, kind: str = "standard", mode: str = "overwrite") -> str:
    """Parquet under the folder of the corpus kind, one sub-folder per split; texts stand in it more than once, so packed well."""
    path = f"{output_dir.rstrip('/')}/{CORPUS_FOLDERS.get(kind, CORPUS_FOLDERS['standard'])}"
    corpus.write.mode(mode).option("compression", "zstd").partitionBy("split").parquet(path)
    return path


def write_converted(converted: DataFrame, output_dir: str, mode: str = "overwrite") -> str:
    """The converted tree as one table keyed by ``dest_path``."""
    path = f"{output_dir.rstrip('/')}/converted"
    converted.write.mode(mode).parquet(path)
    return path


def export_tree(converted: DataFrame, root: str) -> DataFrame:
    """Write one file per row below ``root``; returns path and bytes written.

    Lazy: files appear when the result is consumed. Writing a file again gives
    the same bytes, so a task that runs twice does no harm.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from leafmill.sources.tree import _open

        filesystem, base = _open(root)
        for batch in batches:
            sizes = []
            for row in batch.itertuples():
                target = f"{base.rstrip('/')}/{row.dest_path}"
                filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
                data = row.markdown.encode("utf-8")
                with filesystem.open_output_stream(target) as stream:
                    stream.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"dest_path": batch["dest_path"], "n_bytes": sizes})

    slim_batches(converted.sparkSession)
    return converted.select("dest_path", "markdown").mapInPandas(write, "dest_path string, n_bytes long")


def default_name(first_repo: str | None, kind: str) -> str:
    """Corpus name from the first repository, else a general one."""
    endings = {"standard": "", "sft": "-sft", "code_gen": "-code-gen"}
    stem = f"{first_repo.replace('/', '-')}-docs" if first_repo else "documentation-dataset"
    return stem + endings.get(kind, "")


def publish(corpus: DataFrame, root: str, name: str, records_per_file: int = 100_000) -> DataFrame:
    """Sharded Parquet under ``<root>/<name>`` and a JSON manifest beside it.

    The manifest holds schema, counts per split and nothing that grows with the
    data. Returned: the counts.
    """
    spark = corpus.sparkSession
    target = f"{root.rstrip('/')}/{name}"
    (
        corpus.write.mode("overwrite")
        .option("maxRecordsPerFile", records_per_file)
        .partitionBy("split")
        .parquet(f"{target}/data")
    )
    saved = spark.read.parquet(f"{target}/data")
    counts = saved.groupBy("split").agg(F.count(F.lit(1)).alias("n_records"))
    schema = json.dumps(json.loads(saved.schema.json()))
    manifest = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("split", "n_records"))).alias("records")
    ).select(F.lit(name).alias("name"), F.lit(schema).alias("schema"), "records")
    manifest.coalesce(1).write.mode("overwrite").json(f"{target}/manifest")
    return counts
