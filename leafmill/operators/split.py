"""Reproducible stratified train/test split, exact for any group size.

Inside each group the rows are ordered by a seeded hash of their path and the
first ``max(1, floor(n * (1 - ratio)))`` are train. A window per group would put
a group holding a third of all rows into one task, so the cut is searched:

1. count rows per (group, hash prefix), combined before the shuffle;
2. a running sum over those counts (at most 16**digits per group) names the
   prefix the cut falls into;
3. only rows with that prefix are ranked, by (group, prefix).

The result is one (hash, path) cut per group. Rows are train if they are not
beyond it, so their text never passes through a sort or a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.joins import sized_join
from leafmill.session import written

GROUP = ("repo_name", "category")


def order_hash(path: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), path))


def train_size(n: Column, test_ratio: float) -> Column:
    """In doubles on purpose: decimals would round other ratios differently."""
    return F.greatest(
        F.lit(1).cast("long"),
        F.floor(n.cast("double") * (F.lit(1.0).cast("double") - F.lit(float(test_ratio)).cast("double"))),
    )


def split_cuts(
    rows: DataFrame,
    test_ratio: float = 0.2,
    seed: int = 42,
    group: Sequence[str] = GROUP,
    path: str = "file_path",
    digits: int = 3,
) -> DataFrame:
    """One row per group: ``n_train, n_rows`` and the last train key."""
    keys = rows.select(*group, F.col(path).alias("_path"), order_hash(F.col(path), seed).alias("_hash"))
    keys = keys.withColumn("_prefix", F.substring("_hash", 1, digits))
    per_prefix = keys.groupBy(*group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    edge = (
        per_prefix.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("n_rows", F.sum("_n").over(whole))
        .withColumn("n_train", train_size(F.col("n_rows"), test_ratio))
        .filter((F.col("_upto") - F.col("_n") < F.col("n_train")) & (F.col("n_train") <= F.col("_upto")))
        .withColumn("_need", F.col("n_train") - (F.col("_upto") - F.col("_n")))
        .select(*group, "_prefix", "_need", "n_train", "n_rows")
    )
    inside = Window.partitionBy(*group, "_prefix").orderBy("_hash", "_path")
    return (
        keys.join(edge, [*group, "_prefix"])
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == F.col("_need"))
        .select(*group, F.col("_hash").alias("cut_hash"), F.col("_path").alias("cut_path"), "n_train", "n_rows")
    )


def apply_cuts(
    rows: DataFrame,
    cuts: DataFrame,
    seed: int = 42,
    group: Sequence[str] = GROUP,
    path: str = "file_path",
) -> DataFrame:
    """Add ``split``. ``cuts`` is a written table, joined by its measured size."""
    slim = cuts.select(*group, "cut_hash", "cut_path")
    mine = order_hash(F.col(path), seed)
    before = (mine < F.col("cut_hash")) | ((mine == F.col("cut_hash")) & (F.col(path) <= F.col("cut_path")))
    both = sized_join(rows, slim, list(group), "inner", path)
    return both.withColumn("split", F.when(before, "train").otherwise("test")).drop("cut_hash", "cut_path")


def stratified_split(
    rows: DataFrame,
    test_ratio: float = 0.2,
    seed: int = 42,
    group: Sequence[str] = GROUP,
    path: str = "file_path",
) -> DataFrame:
    """Cuts from written slim keys, then one pass over the rows."""
    keys = written(rows.select(*group, path), "split-keys")
    cuts = written(split_cuts(keys, test_ratio, seed, group, path), "cuts")
    return apply_cuts(rows, cuts, seed, group, path)


def split_by_source(
    rows: DataFrame, test_ratio: float = 0.2, seed: int = 42, group: Sequence[str] = ("repo_name",), source: str = "path"
) -> DataFrame:
    """Split source files, not records: all records made from one file share its split."""
    keys = written(rows.select(*group, source).distinct(), "split-keys")
    cuts = written(split_cuts(keys, test_ratio, seed, group, source), "cuts")
    return apply_cuts(rows, cuts, seed, group, source)


def count_by_split(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_records"))


def count_outputs(rows: DataFrame) -> DataFrame:
    """Records per CSV output: each split and the combined file."""
    return rows.rollup("split").agg(F.count(F.lit(1)).alias("n_records")).select(
        F.coalesce("split", F.lit("metadata")).alias("output"), "n_records"
    )


def only(rows: DataFrame, split: str) -> DataFrame:
    return rows.filter(F.col("split") == split)
