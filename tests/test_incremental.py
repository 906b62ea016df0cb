"""Conversions kept between runs."""

import os
import time

import pytest
from pyspark.sql import functions as F

from leafmill.plans import incremental as I
from leafmill.plans.build import build_from_tree, plan_files
from leafmill.session import written
from leafmill.sources.tree import list_tree

FIRST = {
    "alpha/docs/a.md": "# A\ntext", "alpha/docs/b.py": "def f(x):\n    return x\n", "alpha/examples/docs/both.md": "# Both\nin two",
    "beta/readme.md": "# Beta\nno folder yet", "beta/tool.py": "def g():\n    pass\n", "gamma/docs/gone.md": "# Gone\nsoon", "gamma/docs/stay.md": "# Stay",
}


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def rows(df):
    return sorted(map(str, df.drop("creation_date").select(*sorted(c for c in df.columns if c != "creation_date")).collect()))


def update(spark, tree, state, **how):
    plan = plan_files(written(list_tree(spark, tree), "manifest"))
    return I.update_conversions(plan, I.tree_reader(tree), state, **how)


@pytest.fixture
def places(tmp_path):
    put(tmp_path / "tree", FIRST)
    return tmp_path / "tree", str(tmp_path / "state"), tmp_path


def test_a_second_run_converts_what_changed_and_equals_a_full_run(spark, places):
    tree, state, tmp = places
    corpora, counts = I.update_from_tree(spark, str(tree), state, str(tmp / "one"))
    assert counts == {"added": 8, "changed": 0, "kept": 0, "removed": 0}
    assert rows(corpora.standard) == rows(build_from_tree(spark, str(tree), str(tmp / "full one")).standard)

    put(tree, {"alpha/docs/new.md": "# New\nfile", "alpha/docs/a.md": "# A\nother text", "beta/docs/late.md": "# Late\nfolder"})
    os.utime(tree / "gamma/docs/stay.md", (1, 1))  # an equal text with another time is converted anew
    (tree / "gamma/docs/gone.md").unlink()
    corpora, counts = I.update_from_tree(spark, str(tree), state, str(tmp / "two"))
    # The new folder takes both files of beta out of "other"; they are below no target folder.
    assert counts == {"added": 2, "changed": 2, "kept": 3, "removed": 3}
    run = I.state(spark, state)
    assert spark.read.parquet(f"{state}/parts/{run['live']}").count() == 4
    assert rows(corpora.standard) == rows(build_from_tree(spark, str(tree), str(tmp / "full two")).standard)

    _, counts = I.update_from_tree(spark, str(tree), state, str(tmp / "three"))
    assert counts == {"added": 0, "changed": 0, "kept": 7, "removed": 0}
    assert spark.read.parquet(f"{state}/parts/{I.state(spark, state)['live']}").count() == 0


def test_a_failed_run_leaves_the_state_as_it_was(spark, places):
    tree, state, _ = places
    with pytest.raises(FileNotFoundError):
        I.conversions(spark, state)
    update(spark, str(tree), state)
    before, held = I.state(spark, state), rows(I.conversions(spark, state))
    put(tree, {"alpha/docs/new.md": "# New"})
    plan = plan_files(written(list_tree(spark, str(tree)), "manifest"))
    broken = lambda todo: I.tree_reader(str(tree))(todo).withColumn("content", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        I.update_conversions(plan, broken, state)
    assert I.state(spark, state) == before and rows(I.conversions(spark, state)) == held
    assert update(spark, str(tree), state) == {"added": 1, "changed": 0, "kept": 8, "removed": 0}


def test_parts_are_merged_and_old_ones_removed(spark, places):
    tree, state, _ = places
    for n in range(4):
        put(tree, {f"alpha/docs/n{n}.md": f"# {n}", "alpha/docs/a.md": "# A\n" + "x" * n})
        os.utime(tree / "alpha/docs/a.md", (time.time() + n, time.time() + n))
        update(spark, str(tree), state, most_parts=2)
        now = I.state(spark, state)
        assert len(now["parts"]) <= 2 and set(os.listdir(f"{state}/parts")) <= {*now["parts"], *(now["before"] or now)["parts"]}
        held = {f"{r.repo_name}/{r.rel_path}": r.markdown for r in I.conversions(spark, state).collect()}
        assert held["alpha/docs/a.md"].endswith("x" * n) and len(held) == len(FIRST) + n + 1


def test_changes_compare_null_safely(spark):
    ddl = "path string, category string, length long, modified timestamp"
    plan = spark.createDataFrame([("a", "docs", None, None), ("b", "docs", 1, None), ("c", "docs", 2, None), ("c", "other", 2, None)], ddl)
    live = spark.createDataFrame([("a", "docs", None, None), ("b", "docs", None, None), ("c", "docs", 2, None), ("d", "docs", 2, None)], ddl)
    got = {(r.path, r.category): (r.kind, r.part) for r in I.changes(plan, live.withColumn("part", F.lit("p"))).collect()}
    assert got == {("a", "docs"): ("kept", "p"), ("b", "docs"): ("changed", "p"), ("c", "docs"): ("kept", "p"), ("c", "other"): ("added", None), ("d", "docs"): ("removed", "p")}
    assert I.changes(plan.limit(0), live.limit(0).withColumn("part", F.lit("p"))).count() == 0
