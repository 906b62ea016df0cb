"""No size cut, strict JSON, exact values, text that stays where it is."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill import session as session_module
from leafmill.functions import jsontext as J
from leafmill.operators import catalog as C
from leafmill.operators import joins, maps
from leafmill.operators.convert import convert_files
from leafmill.operators.metadata import file_type
from leafmill.operators.routing import is_api_spec, keep_documentation, with_route
from leafmill.operators.split import split_by_source
from leafmill.plans import build as B

LONG = "x" * 25_000_000


def files(spark, **content):
    rows = [("r", f"docs/{n}", f"r/docs/{n}", n, "docs", t, len(t)) for n, t in content.items()]
    df = spark.createDataFrame(rows, "repo_name string, rel_path string, path string, rel_in_category string, category string, content string, length long")
    return df.withColumn("modified", F.timestamp_seconds(F.lit(0)))


def test_long_strings_and_deep_nesting_convert(spark):
    book = {"cells": [{"cell_type": "code", "source": "1", "outputs": [{"output_type": "stream", "text": LONG}]}], "metadata": {}}
    spec = {"openapi": "3", "info": {"description": LONG}, "paths": {}}
    deep = "[" * 1200 + "]" * 1200
    given = files(spark, **{"a.ipynb": json.dumps(book), "b.json": json.dumps(spec), "c.json": deep, "d.json": '{"paths": {}, "x": ' + deep + "}"})
    got = {r.rel_in_category: r for r in convert_files(given).select("rel_in_category", "route", "error", F.length("markdown").alias("n")).collect()}
    assert [got[n].error for n in ("a.ipynb", "b.json", "c.json")] == [None] * 3
    assert got["a.ipynb"].n > len(LONG) and got["b.json"].n > len(LONG) and got["c.json"].route == "json" and got["d.json"].route == "api"


def valid(t):
    try:
        json.loads(t)
        return True
    except ValueError:
        return False


def judged(spark, texts, keys):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return df.select("t", J.checked(F.col("t")).isNotNull().alias("ok"), J.has_any_key(F.col("t"), keys).alias("keyed"))


def test_json_is_judged_as_python_does(spark):
    rnd = random.Random(1)
    texts = ['{"x": NaN}', "{'x': 1}", '{"x": "a\nb"}', "1 2", "", "nul", '"a', "[1,]", "\ufeff{}", "-Infinity", '{"openapi": NaN}', '{"\\ud800": 1}', "{}", " [] "]
    texts += ["".join(rnd.choice('{}[]",:1a ') for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    for r in judged(spark, texts, ["openapi"]).collect():
        assert r.ok == valid(r.t), r.t
        assert r.keyed == (r.t == '{"openapi": NaN}')


def test_json_is_judged_as_python_does_on_broken_texts(spark):
    rnd = random.Random(2)
    nines, marks = "9" * 4301, "{}[]\",:1a -+.eE\\\n\tu0NaINF"
    texts = ["INF", "-INF", "+Infinity", "-NaN", '["INF"]', '["\\"INF"]', '["\\\\",INF]', '["+I"]', "1,2", "1],[2", "1}", "[1],", '"x":1', '1,"x":2', '1],"x":[2']
    texts += ["01", "1.", ".5", "1e", "1E+5", "-0", "+1", "\x0b1", "\xa01", '"\x7f"', '"\t"', '"\\x"', '"\\u12"', "/*c*/1", "{a:1}", "[]\x00", "0x10", "1d", "\u0663"]
    texts += [nines, nines[1:], "-" + nines, "1." + nines, nines + ".0", nines + "e1", "1e-" + "0" * 4400 + "5", f'"{nines}"', f"[{nines}]", f'{{"a":[1.0,{nines},2.5]}}']
    texts += ['"' + '\\"' * 30_000 + '"', '["' + '\\"' * 30_000 + '",INF]', "[" * 5000 + "]" * 5000, "[" * 5000 + "]" * 4999]
    for _ in range(3000):
        chars = list(rnd.choice(['{"openapi": "3", "x": [1, 2.5e3, -1, true, null, "a\\n\\u00e9"]}', '[NaN, -Infinity, {"swagger": {}}]']))
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(chars))
            chars[at : at + rnd.randrange(0, 3)] = rnd.choice(marks)
        texts.append("".join(chars))
    for r in judged(spark, texts, ["openapi", "swagger"]).collect():
        value = json.loads(r.t) if valid(r.t) else None
        assert r.ok == valid(r.t), r.t[:80]
        assert r.keyed == (isinstance(value, dict) and not {"openapi", "swagger"}.isdisjoint(value)), r.t[:80]


def test_keys_are_found_whatever_they_hold(spark):
    deep = "[" * 5000 + "]" * 5000
    values = ["null", "[1]", "{}", '{"s":1}', '{"s":null}', '"x"', "1.5", "NaN", "true", deep, '"' + "x" * 3_000_000 + '"']
    yes = [f'{{"openapi":{v}}}' for v in values] + [f' {{"x":{v},\n"swagger" : {v}}}' for v in values] + ['{"open\\u0061pi":1}', '{"openapi":1,"openapi":{}}']
    no = [f'{{"x":{v}}}' for v in values] + [f'[{{"openapi":{v}}}]' for v in values] + ["{ }", '{"":1}', '{"Openapi":1}', '{"_misfit":1}', '{"x":{"openapi":1}}', '{"s":1,"m":2,"v":3,"k":4}']
    got = {r.t: r.keyed for r in judged(spark, yes + no, ["openapi", "swagger"]).collect()}
    assert [t[:60] for t in yes if not got[t]] == [] and [t[:60] for t in no if got[t]] == []


def test_judging_needs_no_python_worker(spark):
    given = files(spark, **{"a.json": "{}", "b.md": "# b"})
    for made in (with_route(given), keep_documentation(given, "path"), given.filter(is_api_spec(F.col("content")))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_long_extension_is_kept(spark):
    ext = "e" * 3000
    assert spark.range(1).select(file_type(F.lit("a." + ext)).alias("t")).first().t == ext


def test_maps_keep_values_exact(spark):
    rows = [(9007199254740993, True, [1, None], None), (None, None, None, "t")]
    df = spark.createDataFrame(rows, "n long, b boolean, l array<int>, s string").withColumn("at", F.timestamp_seconds(F.lit(5)))
    seen = maps.map_rows(df, lambda r: {"shown": repr((r["n"], r["b"], r["l"]))}, "shown string").orderBy(F.asc_nulls_last("n")).collect()
    assert [tuple(r)[:4] for r in seen] == rows and seen[0].shown == repr(rows[0][:3]) and seen[1].shown == "(None, None, None)"
    assert seen[0]["at"] == df.first()["at"]


def test_catalog_defaults_and_doubles(spark):
    ddl = "name string, type string, source string, url string, num_files long"
    old = spark.createDataFrame([("a/b", "repository", None, None, 0), ("q", None, None, None, 0)], ddl)
    new = spark.createDataFrame([("c/d", "repository", None, None, 0)] * 2 + [("q", None, None, None, 0), ("a/b", "repository", None, None, 1)], ddl)
    assert sorted(r.name for r in C.append_if_absent(old, new).collect()) == ["a/b", "c/d", "q"]
    tree = files(spark, **{"a.md": "# a"})
    untyped = spark.createDataFrame([("o/r", None, None, None, 0)], ddl)
    assert B.convert_repositories(tree, untyped).count() == 1


def test_copies_of_one_source_share_its_split(spark):
    rows = [("r", c, f"p{i}", f"{c}/p{i}") for i in range(200) for c in ("docs", "examples")]
    got = split_by_source(spark.createDataFrame(rows, "repo_name string, category string, path string, file_path string"))
    per = got.groupBy("path").agg(F.countDistinct("split").alias("n")).agg(F.max("n").alias("n")).first()
    assert per.n == 1
    assert {r.split: r.n for r in got.groupBy("split").agg(F.countDistinct("path").alias("n")).collect()} == {"train": 160, "test": 40}


@pytest.mark.parametrize("small", [0, 10])
def test_joins_by_size_agree(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "SMALL_ROWS", small)
    monkeypatch.setattr(joins, "SALT_ROWS", 7)
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)], "k string, i long")
    few = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    assert {(r.i, r.v) for r in joins.sized_join(big, few, ["k"], "inner", "i").collect()} == {(i, 1) for i in range(90) if i % 3} | {(3, 2)}
    assert joins.sized_join(big, few.select("k"), ["k"], "left_anti", "i").count() == 29


def test_no_text_moves_in_a_repository_job(spark):
    given = files(spark, **{"a.md": "# a", "b.py": "x = 1"})
    plan = B.convert_repositories(given)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    assert not moved


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session_module.scratch(Cluster(), "x")


def test_a_job_removes_what_it_wrote_between(spark):
    from leafmill.session import intermediates, written

    with intermediates(spark):
        path = written(spark.range(3), "between").inputFiles()[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
