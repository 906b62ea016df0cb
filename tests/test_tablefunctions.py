"""Table functions, the scanner's linear time, and streams."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.operators import notebook as N
from leafmill.operators import openapi as A
from leafmill.operators import pysource as Y
from leafmill.operators import tablefunctions
from leafmill.streaming import ingest

TEXTS = [
    'def f(a, b=1) -> int:\n    """Doc."""\n\nclass C(B):\n    """C doc."""\n    def m(self): pass\n',
    '{"cells": [{"cell_type": "heading", "level": 2, "source": ["a", "b"]}, {"cell_type": "code", "source": "x = 1"}, {"cell_type": "raw"}]}',
    '{"worksheets": [{"cells": [{"cell_type": "code", "input": ["y"]}]}]}',
    '{"openapi": "3", "paths": {"/a": {"get": {"summary": "S"}, "head": {}, "post": {"description": "d"}}, "/b": {"put": {}}}}',
    "[1]", "{broken", "", None, '{"paths": []}', "def g(\n", '{"cells": []}',
]


@pytest.fixture
def files(spark):
    rows = [("r", f"r/{i}", t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "repo_name string, path string, content string")
    df.createOrReplaceTempView("files_of_test")
    tablefunctions.register(spark)
    return df


def lateral(spark, kind, columns):
    return sorted(map(tuple, spark.sql(f"SELECT path, {columns} FROM files_of_test, LATERAL file_rows(content, '{kind}')").collect()))


def test_equal_to_the_operators(spark, files):
    got = lateral(spark, "functions", "ordinal, name, return_type, docstring, full_definition")
    assert got == sorted(map(tuple, Y.py_functions(files).select("path", "ordinal", "name", "return_type", "docstring", "full_definition").collect())) and got
    want = Y.py_classes(files).select("path", "ordinal", "name", "parents", "docstring", F.size("methods"))
    assert lateral(spark, "classes", "ordinal, name, parents, docstring, n_methods") == sorted(map(tuple, want.collect()))
    want = N.notebook_cells(files).select("path", "cell_ordinal", "cell_type", "source")
    got = lateral(spark, "cells", "ordinal, cell_type, source")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 4
    want = A.api_endpoints(files).select("path", "endpoint_ordinal", "method", "endpoint", "summary", "description")
    got = lateral(spark, "endpoints", "ordinal, method, endpoint, summary, description")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 3


def test_columns_follow_from_the_kind(spark, files):
    assert spark.sql("SELECT * FROM file_rows('', 'cells')").columns == ["ordinal", "cell_type", "source"]
    for bad in ("'other'", "path"):
        with pytest.raises(Exception, match="kind is a literal"):
            spark.sql(f"SELECT * FROM files_of_test, LATERAL file_rows(content, {bad})").collect()


def test_totals_by_partition(spark, files):
    got = spark.sql("SELECT * FROM source_totals(TABLE(files_of_test) PARTITION BY repo_name)").collect()
    assert [tuple(r) for r in got] == [("r", len(TEXTS), 2, 1)]


PIECES = ["def ", "def", " f", "(", ")", ":", "->", " ", "\n", "\t", "a", ", ", "x: int", "[", "]", "'", '"', "-", ">", "@", "class C:"]


def test_signatures_are_the_patterns_matches():
    rnd = random.Random(7)
    for _ in range(30_000):
        source = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(25)))
        want = [(m.start(), m.end(), m[1], m[2], m[3]) for m in re.finditer(P.FUNCTION, source, re.DOTALL)]
        assert list(Y.signatures(source)) == want, source


@pytest.mark.parametrize("source", ["def f(\n" * 120_000, "def f(x)" * 60_000, "def f(a) -> " + " " * 400_000, "def f(a)" + "\n" * 400_000, "def " + "a" * 400_000])
def test_hostile_sources_take_linear_time(source):
    began = time.perf_counter()
    assert list(Y.signatures(source)) == []
    assert time.perf_counter() - began < 5


def test_stream_equals_batch(spark, tmp_path):
    """Three batches, the second one replayed; and files that come later are the next job's."""
    texts = {f"r{i % 3}/docs/{i}.{'md' if i % 2 else 'py'}": f"# T{i}\n\ntext {i}" for i in range(12)} | {"r0/src/x.md": "# none", "r1/Docs/examples/y.md": "# two"}
    root, out, checkpoint = (str(tmp_path / n) for n in ("tree", "out", "checkpoint"))
    for name, text in texts.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    ingest.ingest(spark, root, out, checkpoint, 5).awaitTermination()

    def rows(df):
        return sorted((r.file_path, r.category, r.title, r.content, r.file_size) for r in df.collect())

    def batch(names):
        files = spark.createDataFrame([(*n.split("/", 1), n, len(t), t) for n, t in names.items()], "repo_name string, rel_path string, path string, length long, content string")
        return rows(ingest.categorised_records(files.withColumn("modified", F.current_timestamp())))

    want = batch(texts)
    assert rows(ingest.ingested(spark, out)) == want and len(want) == 14
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"batch=0", "batch=1", "batch=2"}
    (tmp_path / "checkpoint/commits/2").unlink()  # the last batch was written, but its commit was lost
    (tmp_path / "checkpoint/commits/.2.crc").unlink(missing_ok=True)
    ingest.ingest(spark, root, out, checkpoint, 5).awaitTermination()
    assert rows(ingest.ingested(spark, out)) == want
    (tmp_path / "tree/r0/docs/late.md").write_text("# Late\n\nmore")
    ingest.ingest(spark, root, out, checkpoint, 5).awaitTermination()
    assert rows(ingest.ingested(spark, out)) == batch(texts | {"r0/docs/late.md": "# Late\n\nmore"})


def test_a_streams_conversion_is_planned_once_and_a_batch_is_one_job(spark, tmp_path, monkeypatch):
    """Not once a batch: building the converters' columns took longer than converting a batch."""
    root, out, checkpoint = (str(tmp_path / n) for n in ("tree", "out", "checkpoint"))
    for i in range(9):
        (tmp_path / "tree" / f"r{i}" / "docs").mkdir(parents=True)
        (tmp_path / "tree" / f"r{i}" / "docs" / "a.py").write_text(f"def f{i}(): pass")
    calls, convert = [], ingest.convert_files
    monkeypatch.setattr(ingest, "convert_files", lambda files: calls.append(1) or convert(files))
    writes, write = [], ingest.written
    monkeypatch.setattr(ingest, "written", lambda *a: writes.append(1) or write(*a))
    ingest.ingest(spark, root, out, checkpoint, 3).awaitTermination()
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"batch=0", "batch=1", "batch=2"}
    assert ingest.ingested(spark, out).count() == 9 and len(calls) == 1 and not writes
