"""Conversions kept between runs: a run reads and converts only what is new or changed.

The state is a folder on the shared store:

* ``parts/<run>``: the conversions of one run, text included, never changed afterwards;
* ``live/<run>``: one slim row per (path, category) with its stamp and the part that holds it;
* ``current.json``: the live table and the parts that count, replaced as a run's last step.

A run compares the planned rows with the live table by a full join of slim columns. Rows of an
equal stamp stay where they are, the others are read and converted into a new part. Rows that
were replaced or removed remain in old parts until these are merged; readers leave them out
by an anti-join with those few keys, so kept text is not shuffled. A run that fails leaves folders
that nothing names. One run at a time may work on a state.

Categories are part of the key: a target folder that comes later moves a repository's files
out of ``other``, and those rows are converted anew. Collisions and the split are found again
on slim columns of all live rows, as both can change for files that did not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.convert import convert_files
from leafmill.operators.joins import sized_join
from leafmill.plans.build import Corpora, plan_files, records_from_converted, save_corpora
from leafmill.session import intermediates, written
from leafmill.sinks.versions import place, replace_file
from leafmill.sources.tree import list_tree, read_contents, read_tasks

KEYS, STAMP = ["path", "category"], ("length", "modified")
#: Parts of a state; with more, a run merges them all into its own.
MOST_PARTS = 16


def state(spark: SparkSession, folder: str) -> dict | None:
    """What the last whole run left: ``live``, ``parts``, and the same of the run ``before``."""
    target, store = place(spark, f"{folder.rstrip('/')}/current.json")
    if not store.exists(target):
        return None
    return json.loads(spark.read.text(target.toString(), wholetext=True).first()[0])


def changes(plan: DataFrame, live: DataFrame, stamp: tuple[str, ...] = STAMP) -> DataFrame:
    """``path, category, part, kind`` of every key of either side: added, changed, kept or removed.

    Both have one row per key. Stamps are compared null-safely, so a missing time is equal to a missing time.
    """
    new = plan.select(*KEYS, F.struct(*stamp).alias("now"))
    old = live.select(*KEYS, F.struct(*stamp).alias("then"), "part")
    kind = (
        F.when(F.col("then").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("now").eqNullSafe(F.col("then")), "kept")
        .otherwise("changed")
    )
    return new.join(old, KEYS, "full").select(*KEYS, "part", kind.alias("kind"))


def conversions(spark: SparkSession, folder: str) -> DataFrame:
    """The live conversions of a state, as ``convert_files`` gives them."""
    found = state(spark, folder)
    if found is None:
        raise FileNotFoundError(f"no run has finished in {folder}")
    root = folder.rstrip("/")
    return _live_rows(spark, root, found["parts"], spark.read.parquet(f"{root}/live/{found['live']}")).drop("part")


def _live_rows(spark: SparkSession, root: str, parts: list[str], live: DataFrame) -> DataFrame:
    rows = spark.read.parquet(*[f"{root}/parts/{p}" for p in parts])
    dead = written(rows.select(*KEYS, "part").join(live.select(*KEYS, "part"), [*KEYS, "part"], "left_anti"), "dead")
    return sized_join(rows, dead, [*KEYS, "part"], "left_anti", "path")


def update_conversions(
    plan: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    folder: str,
    stamp: tuple[str, ...] = STAMP,
    most_parts: int = MOST_PARTS,
) -> dict[str, int]:
    """Brings a state up to ``plan`` (slim, from ``plan_files``) and returns how many keys are of each kind.

    ``read`` adds ``content`` to the planned rows it is given, which are those to convert.
    """
    spark, root, run = plan.sparkSession, folder.rstrip("/"), uuid.uuid4().hex
    before = state(spark, root)
    plan = written(plan, "plan")
    if before:
        live = spark.read.parquet(f"{root}/live/{before['live']}")
    else:
        live = plan.limit(0).select(*KEYS, *stamp, F.lit("").alias("part"))
    diff = written(changes(plan, live, stamp), "changes")
    counts = {r.kind: r["count"] for r in diff.groupBy("kind").count().collect()}
    todo = written(plan.join(diff.filter("kind IN ('added', 'changed')").select(*KEYS), KEYS, "left_semi"), "todo")
    made = convert_files(read(todo)).withColumn("part", F.lit(run))
    kept = diff.filter("kind = 'kept'").select(*KEYS, "part")
    parts = sorted(r.part for r in kept.select("part").distinct().collect())
    if len(parts) >= most_parts:
        old = _live_rows(spark, root, parts, kept).withColumn("part", F.lit(run))
        made, kept, parts = made.unionByName(old), kept.withColumn("part", F.lit(run)), []
    made.write.parquet(f"{root}/parts/{run}")
    stamps = plan.select(*KEYS, *stamp).join(kept.withColumnRenamed("part", "_old"), KEYS, "left")
    stamps.select(*KEYS, *stamp, F.coalesce("_old", F.lit(run)).alias("part")).write.parquet(f"{root}/live/{run}")
    now = {"live": run, "parts": [*parts, run]}
    past = {k: before[k] for k in ("live", "parts")} if before else None
    replace_file(spark, f"{root}/current.json", json.dumps(now | {"before": past}))
    _forget(spark, root, before, now)
    return {k: counts.get(k, 0) for k in ("added", "changed", "kept", "removed")}


def _forget(spark: SparkSession, root: str, before: dict | None, now: dict) -> None:
    """Removes what only the run before the last one named; the last one's readers may have begun."""
    older = before and before["before"]
    if not older:
        return
    unused = [f"parts/{p}" for p in older["parts"] if p not in before["parts"] and p not in now["parts"]]
    for name in [*unused, f"live/{older['live']}"]:
        target, store = place(spark, f"{root}/{name}")
        store.delete(target, True)


def update_from_tree(
    spark: SparkSession, tree: str, folder: str, output_dir: str, test_ratio: float = 0.2, seed: int = 42
) -> tuple[Corpora, dict[str, int]]:
    """``build_from_tree`` over a state: the same corpora, with only new and changed files read and converted."""
    with intermediates(spark):
        plan = plan_files(written(list_tree(spark, tree), "manifest"))
        counts = update_conversions(plan, tree_reader(tree), folder)
        return save_corpora(records_from_converted(conversions(spark, folder), test_ratio, seed), output_dir), counts


def tree_reader(tree: str) -> Callable[[DataFrame], DataFrame]:
    return lambda todo: read_contents(todo, tree, read_tasks(todo))
