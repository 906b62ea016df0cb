"""Trees as a data source, and committed sinks."""

import os
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.session import intermediates, written
from leafmill.sinks import versions
from leafmill.sources import treesource as T

FILES = {
    "alpha/docs/a.md": "# A\r\ntext", "alpha/docs/.hidden.md": "h", "alpha/src/b.py": "x = 1", "alpha/.git/config": "no", "alpha/docs/sub/.git/x.md": "no",
    "beta/Examples/c.md": "é", "beta/empty.txt": "", "gamma/noext": "n", "gamma/.md": "named by its suffix",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "tree/loose.md").write_text("not in a repository")
    return str(tmp_path / "tree")


def read(spark, root, **options):
    T.register(spark)
    return spark.read.format(T.NAME).options(**options).load(root)


def manifest(spark, root, tmp_path):
    return T.write_manifest(spark, root, str(tmp_path / "manifest"))


@pytest.mark.parametrize("by_manifest", [True, False])
def test_all_files_with_their_text(spark, root, tmp_path, by_manifest):
    options = {"manifest": manifest(spark, root, tmp_path)} if by_manifest else {"tasks": "3"}
    rows = read(spark, root, **options).collect()
    assert {f"{r.repo_name}/{r.rel_path}": r.content for r in rows} == {k: v.replace("\r\n", "\n") for k, v in FILES.items()}
    assert {r.path: r.length for r in rows} == {f"{root}/{k}": len(v.encode()) for k, v in FILES.items()}
    facts = {f"{r.repo_name}/{r.rel_path}": (r.suffix, r.category, r.in_git) for r in rows}
    assert facts["alpha/docs/sub/.git/x.md"] == (".md", "docs", True) and facts["beta/Examples/c.md"] == (".md", "examples", False)
    assert facts["gamma/noext"] == ("", None, False) and facts["gamma/.md"] == (".md", None, False)
    assert read(spark, root, content="false", **options).columns == [c.split()[0] for c in T.LISTED.split(", ")]


CONDITIONS = [
    "suffix = '.md'", "suffix IN ('.md', '.py') AND NOT in_git", "NOT in_git", "in_git", "repo_name <> 'alpha'", "category = 'docs'",
    "category IS NULL", "category IS NOT NULL", "category <> 'docs'", "NOT (category IN ('docs', 'x'))", "length > 3 AND length <= 6", "length >= 6 OR repo_name = 'gamma'",
    "rel_path LIKE 'docs/%'", "rel_path LIKE '%.md'", "rel_path LIKE '%sub%'", "category <=> NULL", "content LIKE '%x%'", "upper(suffix) = '.MD'",
    "category IN ('docs', NULL)", "length < 1", "modified > timestamp'2000-01-01'", "read_error IS NULL",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_pushed_filters_give_what_filters_give(spark, root, condition):
    whole = spark.createDataFrame(read(spark, root).collect(), read(spark, root).schema)
    want = Counter(r.path for r in whole.filter(condition).collect())
    assert Counter(r.path for r in read(spark, root).filter(condition).collect()) == want


def test_files_ruled_out_are_never_opened(spark, root, tmp_path):
    """Access times: reset ones change for the files read, and only for those."""
    paths = {n: f"{root}/{n}" for n in FILES if FILES[n]}
    with open(paths["alpha/src/b.py"]) as probe:
        os.utime(paths["alpha/src/b.py"], (0, 1000))
        probe.read()
    if os.stat(paths["alpha/src/b.py"]).st_atime == 0:
        pytest.skip("the file system keeps no access times")
    for options in ({"manifest": manifest(spark, root, tmp_path)}, {}):
        for path in paths.values():
            os.utime(path, (0, 1000))
        got = read(spark, root, **options).filter("suffix = '.md' AND NOT in_git AND repo_name = 'alpha' AND category = 'docs'").collect()
        opened = {n for n, p in paths.items() if os.stat(p).st_atime != 0}
        assert {f"{r.repo_name}/{r.rel_path}" for r in got} == opened == {"alpha/docs/a.md", "alpha/docs/.hidden.md"}


def test_partitions_follow_the_manifest_and_the_bytes(spark, root, tmp_path):
    folder = T.write_manifest(spark, root, str(tmp_path / "m"), bytes_per_task=4)
    assert read(spark, root, manifest=folder).rdd.getNumPartitions() == len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 4
    assert read(spark, root, tasks="5").rdd.getNumPartitions() == 5
    empty = tmp_path / "empty"
    empty.mkdir()
    assert read(spark, str(empty)).count() == 0


def tree(spark, rows, parts=3):
    return spark.createDataFrame(rows, "dest_path string, markdown string").repartition(parts)


def committed(spark, root):
    return {f"{r.repo_name}/{r.rel_path}".removeprefix("/"): r.content for r in read(spark, root).collect()}


def test_versions_replace_and_append(spark, tmp_path):
    root = str(tmp_path / "out")
    first = {f"r/docs/{i}.md": f"one {i}" for i in range(20)} | {"top.md": "é"}
    assert T.commit_tree(tree(spark, list(first.items()) + [(None, "x"), ("r/none.md", None)]), root) == {"files": 21, "bytes": sum(len(v.encode()) for v in first.values())}
    assert committed(spark, root) == first
    T.commit_tree(tree(spark, [("r/more.md", "two")]), root, "append")
    assert committed(spark, root) == first | {"r/more.md": "two"}
    for n in range(3):
        T.commit_tree(tree(spark, [("r/only.md", f"three {n}")]), root)
        assert committed(spark, root) == {"r/only.md": f"three {n}"}
    assert len(os.listdir(f"{root}/_versions")) == 2  # the present one and the one before
    T.commit_tree(tree(spark, []), root)
    assert committed(spark, root) == {}


def test_a_failed_task_leaves_nothing_readable(spark, tmp_path):
    root, rows = str(tmp_path / "out"), [(f"r/{i}.md", f"text {i}") for i in range(40)]
    bad = [*rows, ("r/../../escape.md", "x")]
    with pytest.raises(Exception, match="not a path inside the tree"):
        T.commit_tree(tree(spark, bad), root)
    assert T.read_current(root) is None and not os.path.exists(f"{root}/_versions") or not os.listdir(f"{root}/_versions")
    T.commit_tree(tree(spark, rows), root)
    before = committed(spark, root)
    with pytest.raises(Exception, match="not a path inside the tree"):
        T.commit_tree(tree(spark, bad), root)
    assert committed(spark, root) == before == dict(rows)
    T.commit_tree(tree(spark, rows, 7), root)
    assert committed(spark, root) == dict(rows)
    assert not os.path.exists(str(tmp_path / "escape.md"))


def test_attempts_that_do_not_count_are_removed(tmp_path):
    """Two attempts of one task, of which the commit names one."""
    from types import SimpleNamespace

    writer = T.TreeWriter({"path": str(tmp_path / "out")}, SimpleNamespace(fieldNames=lambda: ["dest_path", "markdown"]), True)
    for n in (1, 2):
        folder = tmp_path / f"out/_versions/{writer.version}/part-0-{n}"
        folder.mkdir(parents=True)
        (folder / "torn.md").write_text("half")
        (tmp_path / f"out/_versions/{writer.version}/part-0-{n}.list.parquet").write_text("x")
    writer.commit([T.Attempt(f"{writer.version}/part-0-2", 1, 4), None])
    assert sorted(os.listdir(tmp_path / f"out/_versions/{writer.version}")) == ["part-0-2", "part-0-2.list.parquet"]
    with pytest.raises(ValueError, match="missing"):
        T.TreeWriter({"path": "x"}, SimpleNamespace(fieldNames=lambda: ["dest_path"]), True)


def test_published_versions(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda n: spark.range(n).select("id", F.lit("train").alias("split"))
    with pytest.raises(FileNotFoundError):
        versions.read_published(spark, root, "c")
    for n in (3, 5, 7):
        assert versions.publish_version(rows(n), root, "c")["records"] == {"train": n}
        assert versions.read_published(spark, root, "c").count() == n
    assert len(os.listdir(f"{root}/c/data")) == 2
    with pytest.raises(Exception, match="on purpose"):
        versions.publish_version(rows(9).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("on purpose")).cast("long")).otherwise(F.col("id"))), root, "c")
    assert versions.read_published(spark, root, "c").count() == 7 and len(os.listdir(f"{root}/c/data")) == 2


def test_jobs_in_threads_keep_their_own_intermediates(spark):
    kept, done = [], []

    def other():
        with intermediates(spark):
            written(spark.range(1), "other")
        done.append(kept[0].count())

    with intermediates(spark):
        kept.append(written(spark.range(3), "mine"))
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
    assert done == [3]
