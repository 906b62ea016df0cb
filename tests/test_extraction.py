"""OpenAPI, notebook and Python source operators on hand-written inputs."""

import json
import re

from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.operators import notebook as N
from leafmill.operators import openapi as A
from leafmill.operators import pysource as Y


def files(spark, *texts, name="f"):
    return spark.createDataFrame(
        [("r", f"r/{name}{i}", t, f"{name}{i}") for i, t in enumerate(texts)],
        "repo_name string, path string, content string, file_name string",
    )


def api(spark, spec):
    text = spec if isinstance(spec, str) else json.dumps(spec)
    return A.with_api_markdown(files(spark, text)).select("api_markdown", "api_markdown_ok").first()


def test_spec_defaults_and_nulls(spark):
    assert api(spark, {"paths": {}})[0] == "# API Reference: Unnamed API\n\nVersion: Unknown\n\n## Endpoints\n\n"
    got = api(spark, {"openapi": "3", "info": {"title": None, "version": 1.5, "description": ""}})[0]
    assert got == "# API Reference: None\n\nVersion: 1.5\n\n\n\n"


def test_spec_order_and_unicode(spark):
    spec = {
        "info": {"title": "Ä"},
        "components": {"schemas": {"Z": {}, "A": {"properties": {}}}},
        "definitions": {"ignored": {}},
        "paths": {
            "/z": {"get": {"responses": {"500": {}, "200": {"description": "d"}}}},
            "/a": {"head": {}, "patch": {"requestBody": {"content": {"j": {"schema": {"t": "é", "l": [1, {"b": None}]}}, "n": {}}}}},
        },
    }
    got = api(spark, spec)[0]
    shown = json.dumps({"t": "é", "l": [1, {"b": None}]}, indent=2)
    assert got == (
        "# API Reference: Ä\n\nVersion: Unknown\n\n## Data Models\n\n### Z\n\n### A\n\n**Properties:**\n\n\n"
        "## Endpoints\n\n### `GET /z`\n\n\n\n\n\n**Responses:**\n\n- `500`: \n- `200`: d\n\n"
        "### `PATCH /a`\n\n\n\n\n\n**Request Body:**\n\nContent-Type: `j`\n\n```json\n" + shown + "\n```\n\nContent-Type: `n`\n\n"
    )


def test_unusable_specs_give_nothing(spark):
    for bad in ('{"paths": [1]}', '{"info": "x", "paths": {}}', '{"paths": {"/a": 1}}', '{"paths": {"/a": {"get": "x"}}}', "{bad", '{"paths": {}, "info": {}} x', "{'paths': {}}", '{"paths": {}, "x": "a\nb"}',
                *(json.dumps({"paths": {"/a": {"get": d}}}) for d in (
                    {"responses": {"500": "text"}}, {"responses": {"500": None}}, {"parameters": "x"}, {"parameters": [{"name": "a"}, "x"]},
                    {"parameters": [{"schema": None}]}, {"requestBody": []}, {"requestBody": {"content": {"j": 1}}}, {"examples": {"e": 1}})),
                '{"components": {"schemas": {"A": {"properties": {"x": true}}}}}', '{"definitions": {"A": {"properties": {"x": {"type": "array", "items": []}}}}}'):
        assert tuple(api(spark, bad)) == (None, False), bad


def test_two_api_versions_side_by_side(spark):
    old = {"swagger": "2.0", "definitions": {"P": {"properties": {"x": {"type": "array"}, "y": {"$ref": "#/a/B"}}}}}
    rows = A.api_properties(files(spark, json.dumps(old), "{}", "[]")).orderBy("property_ordinal").collect()
    assert [(r.model, r.property, r.type) for r in rows] == [("P", "x", "array"), ("P", "y", "[B]")]


def notebook(spark, nb):
    text = nb if isinstance(nb, str) else json.dumps(nb)
    return N.with_notebook_markdown(files(spark, text)).select("notebook_markdown", "notebook_markdown_ok").first()


def test_notebook_mixed_cells(spark):
    nb = {
        "cells": [
            {"cell_type": "markdown", "source": ["# A\n", "b"]},
            {"cell_type": "code", "source": "x", "outputs": [{"output_type": "error", "traceback": ["t1", "t2"]}, {"output_type": "clear"}]},
            {"cell_type": "raw", "source": '["not", "a list"]'},
            {"cell_type": "code", "source": "", "outputs": []},
        ],
        "metadata": {"kernelspec": {"language": "R"}},
        "nbformat": 4,
    }
    assert notebook(spark, nb)[0] == '# f0\n\n# A\nb\n\n```R\nx\n```\n\n    t1\n    t2\n\n["not", "a list"]\n\n```R\n\n```\n'


def test_notebook_version_3(spark):
    nb = {
        "worksheets": [{"cells": [
            {"cell_type": "heading", "level": 2, "source": "Head"},
            {"cell_type": "code", "input": ["a = 1\n", "a"], "outputs": [{"output_type": "pyout", "text": ["1"]}, {"output_type": "display_data", "png": "aGk="}]},
        ]}],
        "nbformat": 3,
    }
    assert notebook(spark, nb)[0] == "# f0\n\n## Head\n\n```\na = 1\na\n```\n\n    1\n\n    [image output]\n"


def test_not_a_notebook(spark):
    for bad in ("", "x", "[]", "{}", '{"cells": 3}'):
        assert notebook(spark, bad)[1] is False, bad


RICH = '''import a
from b import c

@one
@two.three(x=1)
def first(p, q: List[Tuple[int, str], x] = [1, 2], *args, r=f(2), **kw) -> Dict[str, int]:
    """Top.

    Parameters:
        p (int): the p
        q: line one
           line two
    Raises:
        X: no
    Returns:
        a mapping
    Examples:
    ```python
    first(1)
    ```
    ```
    first(2)
    ```
    """
    class Inner: pass

def second() -> int | None:
    pass

def third(a,):
    """Example:
    see

        one
          two

        three
    end
        four
    """

async def undef (self):
    return """late"""
class Kid(Base[int], x.Y):
    """Kid doc."""
    def go(self): return 1
'''


def functions(spark, source):
    return Y.py_functions(files(spark, source)).orderBy("ordinal").collect()


def test_function_records(spark):
    rows = functions(spark, RICH)
    names = [m[1] for m in re.finditer(P.FUNCTION, RICH, re.DOTALL)]
    assert [r.name for r in rows] == names
    first = rows[0]
    assert [(p.name, p.type, p.default) for p in first.parameters][:2] == [("p", None, None), ("q", "List[Tuple[int, str], x] ", "[1, 2]")]
    assert ("r", None, "f(2") in [tuple(p) for p in first.parameters]
    assert first.return_type == "Dict[str, int]"
    assert {k: tuple(v) for k, v in first.parameter_info.items()} == {"p": ("int", "the p"), "q": (None, "line one\n           line two")}
    assert tuple(first.return_info) == (None, "a mapping")
    assert first.examples == ["first(1)", "first(2)"]
    assert first.full_definition.startswith("@one\n@two.three(x=1)\ndef first(")


def test_union_return_swallows_the_next_function(spark):
    """A return type with ``|`` is outside the pattern; the match runs on."""
    rows = functions(spark, RICH)
    swallowed = [r for r in rows if r.name == "second"][0]
    assert swallowed.full_definition.startswith("def second() -> int | None:")
    assert "third" not in [r.name for r in rows]


def test_indented_examples(spark):
    source = 'def t(a):\n    """Example:\n    see\nplain\n        one\n          two\n\n        three\nend\n        four\n    """\n'
    assert functions(spark, source)[0].examples == ["see", "one\ntwo\n\nthree", "four"]


def test_classes_and_methods(spark):
    classes = Y.py_classes(files(spark, RICH))
    got = {r.name: r for r in classes.collect()}
    assert set(got) == {"Inner", "Kid"}
    assert got["Kid"].parents == "Base[int], x.Y" and got["Kid"].docstring == "Kid doc."
    methods = [(r["class"], r.method, r.signature, r.docstring) for r in Y.py_methods(classes).filter("class = 'Kid'").collect()]
    assert methods == [("Kid", "go", "go(self)", "")]


def test_modules(spark):
    row = Y.py_modules(files(spark, RICH, "x = 1")).orderBy("path").collect()
    assert row[0].imports == ["import a", "from b import c"]
    assert row[1].docstring is None and row[1].imports == []


def test_markdown_of_a_bare_source(spark):
    got = Y.with_python_markdown(files(spark, "x = 1")).first().python_markdown
    assert got == (
        "# f0\n\n## SDK Documentation\n\nThis file contains documentation for `f0`.\n\n"
        "## Original Code\n\n```python\nx = 1\n```\n"
    )


def test_markdown_agrees_with_records(spark):
    df = files(spark, RICH)
    text = Y.with_python_markdown(df).first().python_markdown
    assert text.count("**Definition:**") == len(functions(spark, RICH))
    assert "Inherits from: `Base[int], x.Y`\n\nKid doc.\n\n#### Methods\n\n##### `go(self)`\n\n" in text
    assert "**Returns:**\n\na mapping\n\n" in text
    assert "| `p` | `int` | the p |\n| `q` | `List[Tuple[int, str], x] ` | line one\n           line two |\n" in text


def test_scanner_sees_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "content string").select(Y.scan_source("content").alias("s"))
    assert [tuple(r.s) if r.s else None for r in df.coalesce(1).collect()] in ([(None, None), ([], [])], [None, ([], [])])


def test_many_files_in_one_batch(spark):
    df = files(spark, *[f"def f{i}(a):\n    pass" for i in range(300)])
    assert Y.py_functions(df).select(F.count_distinct("name")).first()[0] == 300
