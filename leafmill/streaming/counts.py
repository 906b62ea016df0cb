"""Files per repository, category and day of modification, kept by a stream.

Two aggregates over the same source, both in update mode, combined in tasks before they are shuffled:

* ``in_time``: per day, repository and category, with a watermark on the modification time. Spark forgets
  a day once the watermark (newest modification time of the batches before, less ``delay``) has
  passed its end, so the state holds the open days only. A row is **late** if its day had ended by the
  watermark when its batch began; late rows do not change these counts.
* ``arrived``: per repository and category, all rows. Its state is one row per group.

Late rows are what arrived less what was in time. Each micro-batch writes the groups that it changed
as the folder of its number, which a replay replaces; a group's count is that of its last batch.
Rows without a modification time belong to no day and are late. The fallback category needs files
that come later and is left to batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import scan as S
from leafmill.streaming.ingest import stream_session
from leafmill.streaming.names import named_files, take_names

GROUP = ["repo_name", "category"]
#: Files of a batch that ask for a piece of state; a batch changes few groups, and to commit a piece takes longer than they do.
FILES_PER_PIECE = 250


def categorised(files: DataFrame) -> DataFrame:
    """One row per wanted file and target folder above it."""
    return S.select_suffixes(S.exclude_git(files)).select(
        "repo_name", "modified", F.explode(S.target_folders(F.col("rel_path"))).alias("category")
    )


def counts_in_time(files: DataFrame, delay: str) -> DataFrame:
    open_days = categorised(files).withWatermark("modified", delay).groupBy(F.window("modified", "1 day"), *GROUP)
    return open_days.agg(F.count(F.lit(1)).alias("n_files")).select(F.col("window.start").alias("day"), *GROUP, "n_files")


def counts_arrived(files: DataFrame) -> DataFrame:
    return S.count_by_category(categorised(files))


def keep_counts(
    spark: SparkSession, root: str, output_dir: str, checkpoint: str, delay: str = "7 days", files_per_batch: int = 1000
) -> list[StreamingQuery]:
    """Starts a job over all files there are; files that come later are the next job's."""
    started, own = [], stream_session(spark)
    pieces = min(int(own.conf.get("spark.sql.shuffle.partitions")), -(-files_per_batch // FILES_PER_PIECE))
    own.conf.set("spark.sql.shuffle.partitions", pieces)
    own.conf.set("spark.sql.files.minPartitionNum", pieces)
    (names,) = take_names(spark, root, checkpoint, files_per_batch)
    for name, made in (("in_time", lambda f: counts_in_time(f, delay)), ("arrived", counts_arrived)):
        target = f"{output_dir.rstrip('/')}/{name}"

        def put(rows: DataFrame, number: int, target: str = target) -> None:
            rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

        sink = made(named_files(own, names)).writeStream.outputMode("update").foreachBatch(put)
        started.append(sink.option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}").trigger(availableNow=True).start())
    return started


def _latest(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy(*keys).agg(F.max_by("n_files", "batch").alias("n_files"))


def daily_counts(spark: SparkSession, output_dir: str) -> DataFrame:
    """``day, repo_name, category, n_files`` of the rows in time."""
    return _latest(spark, f"{output_dir.rstrip('/')}/in_time", "day", *GROUP)


def category_counts(spark: SparkSession, output_dir: str) -> DataFrame:
    """``repo_name, category, n_files`` of the rows in time, and ``n_late`` of the others."""
    arrived = _latest(spark, f"{output_dir.rstrip('/')}/arrived", *GROUP).withColumnRenamed("n_files", "_all")
    timely = daily_counts(spark, output_dir).groupBy(*GROUP).agg(F.sum("n_files").alias("n_files"))
    both = arrived.join(timely, GROUP, "left").fillna(0, ["n_files"])
    return both.select(*GROUP, "n_files", (F.col("_all") - F.col("n_files")).alias("n_late"))
