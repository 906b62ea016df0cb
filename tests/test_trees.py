"""Real trees on disk: listing, reading, categories, collisions, whole jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leafmill.operators import routing as R
from leafmill.operators import scan as S
from leafmill.operators.convert import convert_files
from leafmill.plans import build as B
from leafmill.sinks import writers as W
from leafmill.sources.corpus import load_corpus
from leafmill.sources.tree import list_tree, read_contents

TREE = {
    "alpha/.git/docs/x.md": b"hidden",
    "alpha/docs/_static/x.md": b"# Static\n\nunder score",
    "alpha/.github/docs/y.md": b"# Dot\n\nunder dot",
    "alpha/docs/b.MD": b"# upper",
    "alpha/docs/examples/x.md": b"# Both\r\n\r\ntwice",
    "alpha/docs/a.py": b'"""Mod."""\ndef f(x):\n    return x\n',
    "alpha/docs/a.ipynb": json.dumps({"cells": [{"cell_type": "markdown", "source": "hi"}], "nbformat": 4}).encode(),
    "alpha/docs/a.md": b"plain a",
    "alpha/docs/deep/er/still/going/on/z.txt": b"deep",
    "alpha/docs/api.json": json.dumps({"openapi": "3", "info": {"title": "T"}, "paths": {}}).encode(),
    "alpha/docs/list.json": b"[1, 2]",
    "alpha/docs/marked.json": b'["**bold**"]',
    "alpha/docs/servers.json": b'{"servers": "# x"}',
    "alpha/docs/broken.json": b"{broken",
    "alpha/docs/odd.json": b'{"paths": [1]}',
    "alpha/docs/bad.ipynb": b"not a notebook",
    "alpha/docs/bytes.txt": b"bad \xff byte",
    "alpha/docs/empty.md": b"",
    "alpha/src/main.py": b"x = 1",
    "beta/src/README.md": b"# Beta\n\nfirst",
    "beta/lib/README.md": b"# Beta lib\n\nsecond",
    "beta/other/deep/n.txt": b"n",
    "gamma/Docs/only.bin": b"no wanted suffix",
    "gamma/src/k.md": b"# never selected",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, data in TREE.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(base)


def test_listing_sees_every_name(spark, root):
    for levels in (0, 1, 3):
        got = {f"{r.repo_name}/{r.rel_path}": r.length for r in list_tree(spark, root, levels, 3, skipped=()).collect()}
        assert got == {k: len(v) for k, v in TREE.items()}


def test_reading_decodes(spark, root):
    rows = {r.rel_path: r for r in read_contents(list_tree(spark, root), root, 3).collect()}
    assert rows["docs/bytes.txt"].content == "bad  byte"
    assert rows["docs/examples/x.md"].content == "# Both\n\ntwice"
    assert rows["docs/bytes.txt"].length == 10 and rows["docs/bytes.txt"].read_error is None


def test_unreadable_file_is_reported(spark, root):
    manifest = list_tree(spark, root).filter("rel_path = 'docs/a.md'")
    missing = manifest.withColumn("path", F.concat("path", F.lit(".gone")))
    row = read_contents(missing, root).first()
    assert row.content is None and row.read_error


def test_skipped_folders_are_not_opened(spark, root):
    plain = {k for k in TREE if "/.git/" not in k}
    assert {f"{r.repo_name}/{r.rel_path}" for r in list_tree(spark, root).collect()} == plain


def assigned(spark, root):
    return B.plan_files(list_tree(spark, root))


def test_categories(spark, root):
    got = {(r.repo_name, r.category, r.rel_in_category) for r in assigned(spark, root).collect()}
    assert ("alpha", "docs", "_static/x.md") in got
    assert ("alpha", "docs", "y.md") in got  # below .github/docs
    assert ("alpha", "docs", "examples/x.md") in got and ("alpha", "examples", "x.md") in got
    assert ("beta", "other", "README.md") in got and ("beta", "other", "deep/n.txt") in got
    assert not any(r == "gamma" for r, _, _ in got)  # a target folder without wanted files
    assert not any(".git/" in p or p.endswith(".MD") or "main.py" in p for _, _, p in got)


def converted(spark, root):
    return convert_files(read_contents(assigned(spark, root), root))


def test_routes_and_failures(spark, root):
    rows = {r.rel_path: r for r in converted(spark, root).filter("category = 'docs'").collect()}
    assert rows["docs/api.json"].dest_path == "alpha/docs/api_api_spec.md"
    assert rows["docs/api.json"].is_api_spec and rows["docs/a.py"].is_sdk_file
    assert rows["docs/list.json"].route == "json" and rows["docs/list.json"].markdown == "[1, 2]"
    assert rows["docs/bytes.txt"].size == 10
    failed = {p: r.error for p, r in rows.items() if r.error}
    assert failed == {
        "docs/broken.json": "not convertible: bad_json",
        "docs/odd.json": "not convertible: api",
        "docs/bad.ipynb": "not convertible: notebook",
    }
    assert all(r.markdown is not None for r in rows.values() if not r.error)


def test_collisions_keep_one(spark, root):
    rows = R.drop_failed(converted(spark, root))
    kept = {r.dest_path: r.rel_path for r in S.drop_collision_losers(rows).collect()}
    assert kept["alpha/docs/a.md"] == "docs/a.ipynb"
    assert kept["beta/other/README.md"] == "lib/README.md"
    assert len(kept) == len({r.dest_path for r in rows.collect()})
    losers = {r.dest_path: r.losers for r in S.collisions(rows).filter("losers > 0").collect()}
    assert losers == {"alpha/docs/a.md": 2, "beta/other/README.md": 1}
    errors = {r.error: r.n_files for r in B.error_counts(converted(spark, root)).collect()}
    assert errors["destination taken"] == 3


def test_tree_to_corpora_and_back(spark, root, tmp_path):
    built = B.build_from_tree(spark, root, str(tmp_path / "out"), 0.5)
    rows = {r.file_path: r for r in built.standard.collect()}
    assert set(rows) == {
        "alpha/docs/_static/x.md", "alpha/docs/y.md", "alpha/docs/examples/x.md", "alpha/examples/x.md", "alpha/docs/a.md",
        "alpha/docs/deep/er/still/going/on/z.txt", "alpha/docs/api_api_spec.md", "alpha/docs/marked.json",
        "alpha/docs/bytes.txt", "alpha/docs/empty.md", "beta/other/README.md", "beta/other/deep/n.txt",
    }
    assert rows["alpha/docs/a.md"].title == "a.ipynb"
    assert rows["alpha/docs/api_api_spec.md"].content == "# API Reference: T\n\nVersion: Unknown\n\n## Endpoints\n\n"
    assert rows["alpha/examples/x.md"].file_size == 15
    for kind in ("standard", "sft", "code_gen"):
        assert load_corpus(spark, str(tmp_path / "out"), kind).count() == len(rows)
    test = W.read_csv(spark, str(tmp_path / "out"), "test").count()
    assert test == sum(r.split == "test" for r in rows.values()) > 0


def test_export_and_rebuild(spark, root, tmp_path):
    kept = S.drop_collision_losers(R.drop_failed(converted(spark, root)))
    tree = str(tmp_path / "md")
    written = {r.dest_path: r.n_bytes for r in W.export_tree(kept, tree).collect()}
    assert all(os.path.getsize(f"{tree}/{p}") == n for p, n in written.items())
    os.makedirs(f"{tree}/dataset/docs")
    open(f"{tree}/dataset/docs/skip.md", "w").write("reserved")
    open(f"{tree}/alpha/docs/raw.py", "w").write("x = 1")
    open(f"{tree}/alpha/docs/noted.py", "w").write("# note")
    built = B.rebuild_existing(spark, tree, str(tmp_path / "out"))
    got = {(r.repo_name, r.category, r.file_name) for r in built.standard.collect()}
    assert ("alpha", "docs", "api_api_spec.md") in got and ("alpha", "docs", "noted.py") in got
    assert not {n for _, _, n in got} & {"skip.md", "raw.py", "list.json", "servers.json"}


def test_documentation_predicate(spark):
    cases = {
        "a.md": ("", True), "a.RST": ("", True), "a.json": ('{"servers": "# "}', False), "b.json": ('{"a": "# "}', True),
        "c.json": ('{"a": 1}', False), "d.json": ("{bad **", True), "e.py": ("x__y", True), "f.py": ("x", False),
        "g.json": ('["openapi", "# "]', True), "h.JSON": ('{"openapi": "# "}', True),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "p string, c string")
    got = {r.p: r.d for r in df.select("p", R.is_documentation(F.col("p"), F.col("c")).alias("d")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_hot_repository_is_spread(spark):
    """A repository with most files: the fallback join key is salted."""
    data = [("hot", f"src/f{i}.md", f"hot/src/f{i}.md") for i in range(2000)] + [("cold", "docs/a.md", "cold/docs/a.md")]
    df = spark.createDataFrame(data, "repo_name string, rel_path string, path string")
    assert S.assign_categories(df).groupBy("category").count().orderBy("category").collect() == [("docs", 1), ("other", 2000)]
