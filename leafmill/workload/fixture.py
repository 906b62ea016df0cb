"""The derived ``files`` view: a source tree made from the ``documents`` table.

One SQL text for Spark and DuckDB, free of backslashes; only the three
functions in ``DIALECT`` differ. Every file carries its document's whole text,
so the work of the queries grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.session import scratch

DIALECT = {
    "spark": {
        "micros_to_time": "timestamp_micros",
        "bytes": "octet_length",
    },
    "duckdb": {
        "micros_to_time": "make_timestamp",
        "bytes": "strlen",
    },
}


class _Text:
    """Builds a ``concat(...)`` from literal text and ``{{sql}}`` holes.

    Newlines, double quotes, single quotes, back ticks and backslashes become
    ``chr`` calls, so that both engines read the same literal.
    """

    SPECIAL = {"\n": 10, '"': 34, "'": 39, "`": 96, "\\": 92}

    @classmethod
    def sql(cls, template: str) -> str:
        parts = []
        for index, piece in enumerate(template.replace("{{", "\0").replace("}}", "\0").split("\0")):
            if index % 2:
                parts.append(piece)
                continue
            plain = ""
            for char in piece:
                if char in cls.SPECIAL:
                    if plain:
                        parts.append(f"'{plain}'")
                        plain = ""
                    parts.append(f"chr({cls.SPECIAL[char]})")
                else:
                    plain += char
            if plain:
                parts.append(f"'{plain}'")
        return f"concat({', '.join(parts)})"


ID = "CAST(doc_id AS STRING)"
ESCAPED = (
    "replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))),"
    " chr(10), concat(chr(92), 'n'))"
)
FIRST_LINE = "split_part(text, chr(10), 1)"

PYTHON = '''"""{{%(first)s}}"""
import os
from lib{{CAST(doc_id %% 5 AS STRING)}} import x

@trace
@cache.keep(size=1)
def f{{%(id)s}}(a, b: int = 2, *args, c: Dict[str, int] = None, d="z") -> Optional[str]:
    """Run number {{%(id)s}}.

    Args:
        a (str): first value
        b: second value
           on two lines
        d (int): replaced
        d: kept

    Returns:
        str: what came out

    Examples:
        intro
            f{{%(id)s}}(1)

            f{{%(id)s}}(2)
        end
            g()
    """
    return g(a)

class C{{%(id)s}}(Base, mixins.Extra):
    """Class number {{%(id)s}}."""

    def m(self, n: int = 1) -> str:
        """Method text."""
        return str(n)

    def q(self):
        # no docstring here
        return 1

def last(x):
    return x

class D{{%(id)s}}:
    size = {{CAST(n_chars AS STRING)}}

# {{replace(text, chr(10), concat(chr(10), '# '))}}
''' % {"first": FIRST_LINE, "id": ID}

NOTEBOOK = (
    '{"cells":[{"cell_type":"markdown","source":"# N{{%(id)s}}\\n\\n{{%(esc)s}}"},'
    '{"cell_type":"code","source":["x = f({{%(id)s}})\\n","y = 1"],"outputs":['
    '{"output_type":"stream","name":"stdout","text":["out {{%(id)s}}\\n","more"]},'
    '{"output_type":"display_data","data":{"image/png":"aGk=","text/plain":"Fig"} },'
    '{"output_type":"execute_result","data":{"text/plain":"{{%(id)s}}"} }]},'
    '{"cell_type":"raw","source":"[{{%(id)s}}]"}],"nbformat":4,"nbformat_minor":5,'
    '"metadata":{{CASE WHEN doc_id %% 2 = 0 THEN %(lang)s ELSE %(none)s END}}}'
) % {
    "id": ID,
    "esc": ESCAPED,
    "lang": _Text.sql('{"language_info":{"name":"python"}}'.replace("}}", "} }")),
    "none": "concat(chr(123), chr(125))",
}

OPENAPI = (
    '{"openapi":"3.0.0","info":{"title":"API {{%(id)s}}","version":"1.{{CAST(doc_id %% 10 AS STRING)}}",'
    '"description":"{{%(esc)s}}"},"components":{"schemas":{"User":{"description":"A user","properties":{'
    '"id":{"type":"integer","description":"key"},"tags":{"type":"array","items":{"type":"string"} },'
    '"friends":{"type":"array","items":{"$ref":"#/components/schemas/User"} },'
    '"owner":{"$ref":"#/components/schemas/Team"},"extra":{} } },'
    '"Team{{%(id)s}}":{"properties":{"n":{"type":"number"} } } } },'
    '"paths":{"/items/k{{CAST(doc_id %% 7 AS STRING)}}":{"parameters":[],"get":{"summary":"List",'
    '"description":"Lists {{CAST(n_chars AS STRING)}}","parameters":['
    '{"name":"q","in":"query","required":true,"schema":{"type":"string"},"description":"filter"},'
    '{"name":"n","type":"integer"},{"in":"path","required":false}],'
    '"responses":{"200":{"description":"ok","content":{"application/json":{"schema":'
    '{"$ref":"#/components/schemas/User"} },"text/plain":{"schema":{"type":"string"} } } },'
    '"404":{"description":"none"} } },'
    '"post":{"summary":"Add","requestBody":{"content":{"application/json":{"schema":'
    '{"$ref":"#/components/schemas/User"} },"application/xml":{"schema":{"type":"object","size":{{%(id)s}} } } } },'
    '"responses":{"201":{} },"examples":{"one":{"value":{"id":{{%(id)s}},"on":true} },'
    '"two":{"value":"plain"},"three":{} } } },'
    '"/items/{id}":{"delete":{"summary":"Del"},"options":{"summary":"no"} } } }'
) % {"id": ID, "esc": ESCAPED}

SWAGGER = (
    '{"swagger":"2.0","info":{"title":"Old {{%(id)s}}"},"definitions":{"Pet":{"properties":{"name":'
    '{"type":"string","description":"called"} } },"Bare":{} },'
    '"paths":{"/pets":{"get":{"responses":{"200":{"description":"ok"} } } } } }'
) % {"id": ID}

MARKDOWN = '''{{CASE WHEN doc_id %% 4 = 0 THEN '' ELSE concat('# ', %(first)s, chr(10), chr(10)) END}}{{text}}

## Usage

```python
import pkg{{CAST(doc_id %% 7 AS STRING)}}
r = call({{%(id)s}})
```

```python
def h{{%(id)s}}(x):
    return x
```

### More  code

```
class K{{%(id)s}}(Base):
    def run(self, x: int = 1) -> str:
        return x

def top{{%(id)s}}(a, b):
    pass
class Z:
    def inner(self):
        pass
```

from late{{CAST(doc_id %% 3 AS STRING)}} import thing

```json
{"a": 1}
```
''' % {"first": FIRST_LINE, "id": ID}


def _plain_json() -> str:
    return _Text.sql('{"k":{{%s}},"note":"**{{%s}}**"}' % (ID, ESCAPED))


def files_cte(engine: str) -> str:
    """``base`` and ``files`` as CTEs, to be put after ``WITH``."""
    d = DIALECT[engine]
    return f"""
base AS (
  SELECT doc_id, source AS repo_name, text, n_chars,
    CASE WHEN source IN ('src0', 'src1') THEN 'lib'
         WHEN doc_id % 97 = 5 THEN '.git/docs'
         ELSE CASE CAST(floor(doc_id / 20.0) AS INT) % 8
           WHEN 0 THEN 'docs' WHEN 1 THEN 'examples' WHEN 2 THEN 'cookbook' WHEN 3 THEN 'Cookbooks'
           WHEN 4 THEN 'documentation' WHEN 5 THEN 'tutorials' WHEN 6 THEN 'lib' ELSE 'docs/examples' END
    END AS folder,
    CASE WHEN source = 'src1' AND CAST(floor(doc_id / 20.0) AS INT) % 5 = 0
         THEN concat('d', {ID}, '/readme')
         ELSE concat('d', CAST(doc_id % 3 AS STRING), '/doc_', {ID}) END AS stem,
    CASE CAST((doc_id * 7 + floor(doc_id / 20.0)) AS INT) % 6
      WHEN 0 THEN 'md' WHEN 1 THEN 'rst' WHEN 2 THEN 'txt' WHEN 3 THEN 'py' WHEN 4 THEN 'ipynb' ELSE 'json' END AS ext
  FROM documents),
texts AS (
  SELECT doc_id, repo_name, ext,
    concat(folder, '/', stem, '.', CASE WHEN ext = 'md' AND doc_id % 101 = 3 THEN 'MD' ELSE ext END) AS rel_path,
    CASE ext
      WHEN 'py' THEN {_Text.sql(PYTHON)}
      WHEN 'ipynb' THEN {_Text.sql(NOTEBOOK)}
      WHEN 'json' THEN CASE doc_id % 3
        WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN {_Text.sql(OPENAPI)} ELSE {_Text.sql(SWAGGER)} END
        WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN {_Text.sql('{"k":{{%s}},"servers":[]}' % ID)} ELSE {_plain_json()} END
        ELSE concat(chr(123), 'bad ', {ID}) END
      ELSE {_Text.sql(MARKDOWN)}
    END AS content
  FROM base),
files AS (
  SELECT doc_id, repo_name, ext, rel_path, concat(repo_name, '/', rel_path) AS path, content,
    CAST({d["bytes"]}(content) AS BIGINT) AS length,
    {d["micros_to_time"]}((1704067200 + doc_id) * 1000000 + (doc_id % 3) * 1500) AS modified
  FROM texts)"""


_WRITTEN: dict[tuple[str, str], str] = {}


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as one lazy plan, spread over all tasks."""
    tasks = spark.sparkContext.defaultParallelism
    source = f"FROM (SELECT /*+ REPARTITION({tasks}) */ * FROM parquet.`{sf_dir}/documents.parquet`)"
    return spark.sql(f"WITH {files_cte('spark').replace('FROM documents', source)} SELECT * FROM files")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a table, which is what a checkout is to the operators.

    Derived by Spark and written to the shared scratch folder once per
    application, so that plans show the operators over a pruned scan and not
    over the expressions that make up the texts.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = scratch(spark, "files")
        derive(spark, sf_dir).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
