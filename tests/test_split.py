"""The split against a plain sort per group, and its properties."""

import hashlib

import pytest
from pyspark.sql import functions as F

from leafmill.operators.split import count_outputs, split_cuts, stratified_split

SIZES = {"one": 1, "two": 2, "five": 5, "ten": 10, "many": 1000}


def rows(spark):
    data = [("r", g, f"r/{g}/f{i}.md") for g, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(data, "repo_name string, category string, file_path string")


def expected(ratio, seed):
    result = {}
    for g, n in SIZES.items():
        paths = sorted((hashlib.md5(f"{seed}:r/{g}/f{i}.md".encode()).hexdigest(), f"r/{g}/f{i}.md") for i in range(n))
        k = max(1, int(n * (1 - ratio)))
        result |= {p: "train" if at < k else "test" for at, (_, p) in enumerate(paths)}
    return result


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.2, 0.9, 1.0])
@pytest.mark.parametrize("digits", [1, 3])
def test_equals_plain_sort(spark, ratio, digits):
    from leafmill.operators.split import apply_cuts

    df = rows(spark)
    got = apply_cuts(df, split_cuts(df, ratio, 7, digits=digits), 7).select("file_path", "split").collect()
    assert {r.file_path: r.split for r in got} == expected(ratio, 7)
    assert len(got) == sum(SIZES.values())


def test_order_and_partitions_do_not_matter(spark):
    base = rows(spark)
    one = {tuple(r) for r in stratified_split(base.coalesce(1)).select("file_path", "split").collect()}
    other = {tuple(r) for r in stratified_split(base.orderBy(F.rand(3)).repartition(13)).select("file_path", "split").collect()}
    assert one == other
    assert {tuple(r) for r in stratified_split(base, seed=1).select("file_path", "split").collect()} != one


def test_every_group_has_train_rows(spark):
    cuts = {r.category: (r.n_train, r.n_rows) for r in split_cuts(rows(spark), 0.2).collect()}
    assert cuts == {"one": (1, 1), "two": (1, 2), "five": (4, 5), "ten": (8, 10), "many": (800, 1000)}


def test_output_counts(spark):
    counts = {r.output: r.n_records for r in count_outputs(stratified_split(rows(spark))).collect()}
    assert counts["metadata"] == counts["train"] + counts["test"] == 1018


def test_text_passes_no_sort_or_window(spark):
    """Keys are ranked beforehand: rows with text meet a broadcast table of cuts."""
    wide = rows(spark).withColumn("content", F.repeat(F.lit("x"), 10))
    plan = stratified_split(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and "strategy=broadcast" in plan
