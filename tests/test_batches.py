"""What a Python worker holds at once does not grow with a task's rows."""

import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.operators import convert, maps, pysource
from leafmill.session import BATCH_BYTES, BATCH_ROWS, slim_batches
from leafmill.sinks.writers import export_tree
from leafmill.sources import tree, treesource

BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
FILE = "'r' AS repo_name, 'docs' AS category, 'r/docs/a.py' AS path, 'a.py' AS rel_in_category, 'x = 1' AS content, 5L AS length, 'a' AS dest_path, 'b' AS markdown"
USES = {
    "classes": pysource.py_classes,
    "functions": pysource.py_functions,
    "conversion": convert.convert_files,
    "rows": lambda files: maps.map_rows(files, lambda r: {}, "n int"),
    "export": lambda files: export_tree(files, "/tmp"),
}


@pytest.mark.parametrize("use", USES)
def test_whole_texts_go_to_python_in_slim_batches(spark, use):
    own = spark.newSession()  # as a session that nobody has prepared, with Spark's many rows a batch
    for key in BOUNDS:
        own.conf.set(key, str(1 << 30))
    USES[use](own.range(1).selectExpr(*FILE.split(", ")))
    for key, most in BOUNDS.items():
        assert int(own.conf.get(key)) <= most
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    slim_batches(own)
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"


def test_a_row_of_many_records_and_a_reading_task_hand_on_parts(spark, tmp_path):
    many = 2 * maps.ROWS_AT_ONCE + 3
    rows = maps.expand_files(spark.range(2), lambda row: ({"n": row["id"] * many + i} for i in range(many)), "n long")
    assert rows.agg(F.sum("n"), F.count("n")).first() == (many * (2 * many - 1), 2 * many)
    assert tree.READ_BATCH_BYTES <= BATCH_BYTES < tree.LARGEST_FILE == (1 << 31) - (64 << 20)


def big_files(folder, n=30, size=400_000):
    """More than a reading task may hold before it hands on, in one repository."""
    (folder / "r/docs").mkdir(parents=True)
    for i in range(n):
        (folder / f"r/docs/{i}.md").write_text(str(i % 10) * size)
    return n, size


def assert_parts(parts, n, size):
    """All texts, in parts that end as soon as they hold enough."""
    assert sorted(t for part in parts for t in part) == sorted(str(i % 10) * size for i in range(n))
    assert max(sum(map(len, part)) for part in parts) < tree.READ_BATCH_BYTES + size <= BATCH_BYTES + size


class Spread:
    """Stands for a manifest, and catches what its tasks would run."""

    columns = ["path"]
    schema = StructType([StructField("path", StringType())])

    def repartition(self, *_):
        return self

    def mapInPandas(self, read, _):
        return read


def test_a_task_that_reads_a_manifest_holds_no_more_than_a_part(tmp_path):
    n, size = big_files(tmp_path)
    read = tree.read_contents(Spread(), str(tmp_path), 1)
    rows = pd.DataFrame({"path": [f"{tmp_path}/r/docs/{i}.md" for i in range(n)]})
    parts = list(read(iter([rows.iloc[:25], rows.iloc[25:]])))
    assert_parts([list(part["content"]) for part in parts], n, size)
    assert [p for part in parts for p in part["path"]] == list(rows["path"])


def held(walk) -> int:
    """Bytes of Python objects at most while what comes out is thrown away."""
    tracemalloc.start()
    for _ in walk:
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


@pytest.mark.parametrize("by", ["listing", "source"])
def test_a_listing_does_not_hold_a_folder(tmp_path, monkeypatch, by):
    monkeypatch.setattr(tree, "LIST_BATCH", 100)

    def walk(name):
        root = str(tmp_path / name)
        if by == "source":
            return treesource.TreeReader({"path": root, "tasks": "1"}, StructType([]))._repositories((0, 1))
        start = pd.DataFrame({"repo_name": [""], "path": [root], "is_dir": [True], "length": [0], "modified": [pd.Timestamp(0, tz="UTC")]})
        return (r for part in tree._expander(root, True)(iter([start])) for r in part["path"])

    for name, n in (("small", 500), ("large", 5000)):
        (tmp_path / name / "r/docs").mkdir(parents=True)
        for i in range(n):
            (tmp_path / name / f"r/docs/{i:04d}.md").touch()
        assert sum(1 for _ in walk(name)) == n
    assert held(walk("large")) < 1.5 * held(walk("small"))


def test_a_commit_takes_slim_batches_and_reads_back_in_parts(spark, tmp_path):
    n, size = big_files(tmp_path / "plain")
    root, before = str(tmp_path / "committed"), {key: spark.conf.get(key) for key in BOUNDS}
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    made = spark.read.text(str(tmp_path / "plain/r/docs"), wholetext=True).select(F.concat(F.lit("r/docs/"), name).alias("dest_path"), F.col("value").alias("markdown"))
    try:
        for key in BOUNDS:
            spark.conf.set(key, str(1 << 30))
        assert treesource.commit_tree(made, root) == {"files": n, "bytes": n * size}
        for key, most in BOUNDS.items():
            assert int(spark.conf.get(key)) <= most
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    columns = [StructField(c.split()[0], StringType()) for c in (treesource.LISTED + treesource.TEXT).split(", ")]
    reader = treesource.TreeReader({"path": root}, StructType(columns))
    assert_parts([part["content"].to_pylist() for task in reader.partitions() for part in reader.read(task)], n, size)
