"""Catalog rules, extension points and writers."""

import glob
import json

from pyspark.sql import functions as F

from leafmill.operators import catalog as C
from leafmill.operators import maps
from leafmill.operators import routing as R
from leafmill.schema import CATALOG_DDL, CSV_COLUMNS, RECORD_COLUMNS
from leafmill.operators.metadata import standardise
from leafmill.sinks import writers as W
from leafmill.sources.listing import read_folder_listing, read_repo_listing


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_repository_urls(spark):
    rows = [
        ("org/tool", None, "https://github.com/org/tool", "org/tool", "tool"),
        ("github.com/o/r/", None, "https://github.com/o/r/", "o/r", "r"),
        ("http://github.com/o/r", "", "http://github.com/o/r", "o/r", "r"),
        ("any", "https://host/x/y//", "https://host/x/y//", "x/y", "y"),
    ]
    df = spark.createDataFrame([(n, "repository", "github", u, 0) for n, u, *_ in rows], CATALOG_DDL)
    got = [tuple(r) for r in C.with_repository(df).select("repo_url", "full_name", "short_name").collect()]
    assert got == [r[2:] for r in rows]


def test_entered_urls(spark):
    df = names(spark, " o/r ", "github.com/o/r", "https://h/o/r", "alone")
    assert [r[0] for r in df.select(C.entered_url(F.col("name"))).collect()] == [
        "https://github.com/o/r", "https://github.com/o/r", "https://h/o/r", "alone",
    ]


def test_inference_search_append_remove(spark):
    catalog = C.infer_entries(names(spark, "org", " github.com/a/b ", "x/y", "  "))
    assert [tuple(r)[:3] for r in catalog.collect()] == [
        ("org", "organization", "huggingface"), ("github.com/a/b", "repository", "github"), ("x/y", "repository", "huggingface"),
    ]
    assert C.search(catalog, "GITHUB").count() == 1 and C.search(catalog, "ORG").count() == 1
    assert C.search(catalog, "").count() == 3
    more = C.append_if_absent(catalog, spark.createDataFrame([("organization", "org", "s"), ("organization", "new", "s")], "type string, name string, source string"))
    assert more.count() == 4
    assert C.remove(catalog, catalog.filter("name = 'org'")).count() == 2
    changed = catalog.filter("name = 'org'").withColumn("num_files", F.lit(5).cast("long"))
    assert C.remove(catalog, changed).count() == 3


def test_listings(spark, tmp_path):
    (tmp_path / "repos.json").write_text(json.dumps([{"name": "a", "clone_url": "u", "stars": 3}, {"name": "b"}]))
    assert [tuple(r) for r in read_repo_listing(spark, str(tmp_path / "repos.json")).collect()] == [("a", "u")]
    items = [("r1", "Docs", "dir"), ("r1", "x", "file"), ("r2", "docs", "file"), ("r2", "src", "dir")]
    (tmp_path / "folders.json").write_text(json.dumps([dict(zip(("repo_name", "name", "type"), i)) for i in items]))
    got = C.has_target_folder(read_folder_listing(spark, str(tmp_path / "folders.json"))).collect()
    assert {tuple(r) for r in got} == {("r1", True), ("r2", False)}


def test_excluded_globs(spark):
    df = spark.createDataFrame([("a/b.bin",), (".gitignore",), ("a/.git/x",), ("m.safetensors",), ("ok.md",)], "rel_path string")
    assert [r[0] for r in R.exclude_globs(df).collect()] == ["a/.git/x", "ok.md"]


def test_maps(spark):
    df = names(spark, "a", "bb")
    assert {tuple(r) for r in maps.map_rows(df, lambda r: {"n": len(r["name"])}, "n long").collect()} == {("a", 1), ("bb", 2)}
    assert [r[0] for r in maps.map_files(df, lambda r: r if len(r["name"]) > 1 else None, "name string").collect()] == ["bb"]
    assert maps.expand_files(df, lambda r: [{"c": c} for c in r["name"]], "c string").count() == 3


AWKWARD = ['say "hi", ok', "two\nlines", "  outer  ", "", "a,b", "back\\slash", "'single'", '"']


def records(spark):
    rows = [(f"n{i}", t, t, "train" if i % 2 else "test") for i, t in enumerate(AWKWARD)]
    return standardise(spark.createDataFrame(rows, "file_name string, title string, description string, split string"))


def test_csv_round_trip(spark, tmp_path):
    out = str(tmp_path)
    W.write_csv(records(spark), out)
    got = {r.file_name: r for r in W.read_csv(spark, out).collect()}
    assert {k: (r.title, r.description) for k, r in got.items()} == {f"n{i}": (t, t) for i, t in enumerate(AWKWARD)}
    assert list(got["n0"].asDict()) == CSV_COLUMNS and got["n0"].is_api_spec is False
    assert {r.file_name for r in W.read_csv(spark, out, "train").collect()} == {f"n{i}" for i in range(1, len(AWKWARD), 2)}


def test_csv_reads_no_text(spark, tmp_path):
    W.write_corpus(records(spark), str(tmp_path))
    saved = spark.read.parquet(str(tmp_path / "dataset"))
    plan = saved.select(*CSV_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_published_corpus(spark, tmp_path):
    counts = {r.split: r.n_records for r in W.publish(records(spark), str(tmp_path), "x-docs").collect()}
    assert counts == {"train": 4, "test": 4}
    manifest = json.loads(open(glob.glob(str(tmp_path / "x-docs/manifest/*.json"))[0]).read())
    assert manifest["records"] == counts and manifest["name"] == "x-docs"
    assert {f["name"] for f in json.loads(manifest["schema"])["fields"]} == set(RECORD_COLUMNS)


def test_default_names():
    assert W.default_name("o/r", "standard") == "o-r-docs"
    assert W.default_name("o/r", "sft") == "o-r-docs-sft"
    assert W.default_name(None, "code_gen") == "documentation-dataset-code-gen"
