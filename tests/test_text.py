"""Column expressions against Python's own string and `re` behaviour."""

import os.path
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions import text as X
from leafmill.operators import corpora as K
from leafmill.operators import metadata as M

FENCED = "```python\nx = f(1)\n```\n\n```\ndef a(x):\n    pass\n\ndef b(y) -> int:\n    def inner(z):\n        pass\nclass Q(B):\n  def m(self): pass\n\nclass R:\n  pass\n```\n"
CASES = [
    "", "#", "# only", "# only\n", "# T\n\n", "#!shebang\nbody", "# T\n\n\n## S\ntext", "no heading here",
    "## H2 only\n\ntext", "#\n\nlater", "# T\ntext\n#x", "a\n# T  \nb", "# Zeile\u2028weiter\n\nabsatz", "x" * 500,
    " \t# no\n", "#  a\r# b\n\nc", "# T\n\n  para \u00a0 \n\nmore", FENCED, "```json\n{}\n```", "``` unclosed\nf(1)",
    "```\n def g(a):\n  pass\n```", "import os\nfrom a import b\nfrom x\nimport\n imported", "from a\nimport b",
    "```python f(x) ```", "```py\nf()\n```", "### a\n#\tb\n####c", "```\ndef f(x\ndef g(y):\n  1\n```",
    "```\nundef h(a, (b)) -> List[int] :\n  h(\n)\n```", "```\nclass A:class B(C, d.E):\n\nclass C(x=1):\n```",
    "```\n\x1c def k():\n pass\x1f\n```", "# \x85T\n\n\x1d p \x1e",
]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.repartition(3).select("i", expression.alias("v")).orderBy("i").select("v").collect()]


def brute_blocks(c):
    return re.findall(P.CODE_FENCE, c, re.DOTALL)


def brute_definitions(c, pattern, keyword):
    found = []
    for block in brute_blocks(c):
        for m in re.finditer(pattern, block, re.DOTALL):
            tail = block[m.start() :]
            found.append(tail.split(f"\n{keyword} ", 1)[0].strip())
    return found


BRUTE = {
    "strip": (lambda c: X.strip(c), str.strip),
    "title": (lambda c: M.title(c, F.lit("name.md")), lambda c: m[1] if (m := re.search(P.TITLE, c, re.M)) else "name.md"),
    "description": (
        M.description,
        lambda c: (m[1] if (m := re.search(P.PARAGRAPH_AFTER_TITLE, c, re.S)) else c[:200]).strip(),
    ),
    "imports": (K.imports, lambda c: re.findall(P.IMPORT_LINE, c, re.M)),
    "blocks": (K.code_blocks, brute_blocks),
    "examples": (
        lambda c: K.example_blocks(K.code_blocks(c)),
        lambda c: [b.strip() for b in brute_blocks(c) if re.search(P.CALL, b) and not b.strip().startswith("def ")],
    ),
    "functions": (
        lambda c: K.function_definitions(K.code_blocks(c)),
        lambda c: brute_definitions(c, P.FUNCTION, "def"),
    ),
    "classes": (
        lambda c: K.class_definitions(K.code_blocks(c)),
        lambda c: brute_definitions(c, P.CLASS_HEADER, "class"),
    ),
    "headings": (
        lambda c: F.transform(K.headings(c), lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])),
        lambda c: [f"{len(a)}:{b.strip()}" for a, b in re.findall(P.HEADING, c, re.M)],
    ),
    "calls": (lambda c: K.calls(F.array(c)), lambda c: re.findall(P.CALL, c)),
}


@pytest.mark.parametrize("name", BRUTE)
def test_matches_python_on_edge_cases(spark, name):
    build, expected = BRUTE[name]
    assert column(spark, CASES, build(F.col("c"))) == [expected(c) for c in CASES]


PIECES = st.sampled_from(["```", "```python", "\n", "def f(x):", "def ", "class A:", "class B(C):", "\ndef g(a) -> int:", "\nclass D:", "# ", "## h", " ", "f(1)", "import os", "from a import b", "text", ")", "(", ":", "\t"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=40, max_size=60))
def test_matches_python_on_random_documents(spark, documents):
    for build, expected in BRUTE.values():
        assert column(spark, documents, build(F.col("c"))) == [expected(c) for c in documents]


NAMES = ["a.md", ".bashrc", "a.tar.gz", "noext", "..x", "a.", ".a.b", "dir.d/file", "x/..hidden.txt", "A.MD", ""]


def test_extension_and_names(spark):
    assert column(spark, NAMES, X.extension(F.col("c"))) == [os.path.splitext(os.path.basename(n))[1] for n in NAMES]
    assert column(spark, NAMES, X.stem(F.col("c"))) == [os.path.splitext(os.path.basename(n))[0] for n in NAMES]
    assert column(spark, NAMES, X.dirname(F.col("c"))) == [os.path.dirname(n) for n in NAMES]


def test_decoding(spark):
    cases = [b"plain", b"a\r\nb\rc\n", b"\xff\xfeA", b"ok \xef\xbf\xbd kept \xc3", b"\xef\xbb\xbfbom", b"", b"\xe2\x82", "\u00e9\u20ac\U0001f600".encode()]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary")
    got = [r.t for r in rows.select("i", X.decode_text(F.col("b")).alias("t")).orderBy("i").collect()]
    assert got == [c.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in cases]


def test_iso_time(spark):
    row = spark.sql("SELECT timestamp_micros(1704067200000000) a, timestamp_micros(1704067200001500) b")
    got = row.select(X.iso_time(F.col("a")), X.iso_time(F.col("b"))).first()
    assert tuple(got) == ("2024-01-01T00:00:00", "2024-01-01T00:00:00.001500")


def test_standard_schema(spark):
    from leafmill.schema import RECORD_COLUMNS

    df = M.standardise(spark.createDataFrame([("x", 5, True, "extra")], "title string, file_size int, is_sdk_file boolean, other string"))
    assert df.columns == RECORD_COLUMNS
    row = df.first()
    assert (row.title, row.file_size, row.content, row.is_api_spec, row.is_sdk_file) == ("x", 5, "", False, True)
    lost = M.standardise(df, compat_flags=True).first()
    assert (lost.is_api_spec, lost.is_sdk_file) == (False, False)
