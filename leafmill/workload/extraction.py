"""OpenAPI, notebook and Python source checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.operators import notebook as N
from leafmill.operators import openapi as A
from leafmill.operators import pysource as Y
from leafmill.workload import golden
from leafmill.workload import registry as G
from leafmill.workload.fixture import _Text
from leafmill.workload.registry import files, of_type, query, rx

# --- OpenAPI ------------------------------------------------------------------------

METHODS = "('get', 'post', 'put', 'delete', 'patch')"
SPECS = G.FILES + f""",
specs AS (SELECT repo_name, path, content FROM files WHERE ext = 'json' AND json_valid(content)),
sections AS (
  SELECT repo_name, path, coalesce(json_extract(content, '$.components.schemas'), json_extract(content, '$.definitions')) AS section
  FROM specs),
models AS (
  SELECT s.repo_name, s.path, m.key AS model, m.value AS body,
    row_number() OVER (PARTITION BY s.path ORDER BY m.rowid) - 1 AS model_ordinal
  FROM (SELECT * FROM sections WHERE section IS NOT NULL) s, json_each(s.section) m),
endpoints AS (
  SELECT s.repo_name, s.path, p.key AS endpoint, upper(m.key) AS method, m.value AS d,
    row_number() OVER (PARTITION BY s.path ORDER BY p.rowid, m.rowid) - 1 AS endpoint_ordinal
  FROM specs s, json_each(s.content, '$.paths') p, json_each(p.value) m WHERE m.key IN {METHODS})"""


def get(column: str, path: str, default: str = "''") -> str:
    return f"coalesce(json_extract_string({column}, '$.{path}'), {default})"


def specs(spark, sf):
    return of_type(spark, sf, ".json")


@query("api_specs", SPECS + f""" SELECT repo_name, path, {get('content', 'info.title', "'Unnamed API'")} AS title,
  {get('content', 'info.version', "'Unknown'")} AS version, json_extract_string(content, '$.info.description') AS description FROM specs""")
def api_specs(spark, sf):
    return A.api_specs(specs(spark, sf))


@query("api_models", SPECS + " SELECT repo_name, path, model_ordinal, model, json_extract_string(body, '$.description') AS description FROM models")
def api_models(spark, sf):
    return A.api_models(specs(spark, sf))


@query("api_properties", SPECS + f""" SELECT repo_name, path, model, property_ordinal, property,
  CASE WHEN {get('value', 'type', "'object'")} = 'array' AND json_exists(value, '$.items') THEN 'array of ' ||
         CASE WHEN json_exists(value, '$.items."$ref"') THEN '[' || split_part(json_extract_string(value, '$.items."$ref"'), '/', -1) || ']'
              ELSE {get('value', 'items.type', "'object'")} END
       WHEN json_exists(value, '$."$ref"') THEN '[' || split_part(json_extract_string(value, '$."$ref"'), '/', -1) || ']'
       ELSE {get('value', 'type', "'object'")} END AS type,
  {get('value', 'description')} AS description
  FROM (SELECT m.*, p.*, row_number() OVER (PARTITION BY m.path, model ORDER BY n) - 1 AS property_ordinal
    FROM models m, (SELECT key AS property, value, rowid AS n FROM json_each(m.body, '$.properties')) p)""")
def api_properties(spark, sf):
    return A.api_properties(specs(spark, sf))


@query("api_endpoints", SPECS + f" SELECT repo_name, path, endpoint_ordinal, method, endpoint, {get('d', 'summary')} AS summary, {get('d', 'description')} AS description FROM endpoints")
def api_endpoints(spark, sf):
    return A.api_endpoints(specs(spark, sf))


@query("api_parameters", SPECS + f""" SELECT repo_name, path, method, endpoint,
  row_number() OVER (PARTITION BY path, endpoint_ordinal ORDER BY n) - 1 AS parameter_ordinal,
  {get('value', 'name', "'None'")} AS name, {get('value', 'in', "'unknown'")} AS location,
  coalesce(json_extract_string(value, '$.schema.type'), json_extract_string(value, '$.type'), 'unknown') AS type,
  CASE WHEN json_extract_string(value, '$.required') = 'true' THEN 'required' ELSE 'optional' END AS need,
  {get('value', 'description')} AS description FROM endpoints e, (SELECT key, value, rowid AS n FROM json_each(e.d, '$.parameters')) p""")
def api_parameters(spark, sf):
    return A.api_parameters(specs(spark, sf))


@query("api_request_bodies", SPECS + """ SELECT repo_name, path, method, endpoint,
  row_number() OVER (PARTITION BY path, endpoint_ordinal ORDER BY n) - 1 AS body_ordinal, key AS content_type,
  split_part(json_extract_string(value, '$.schema."$ref"'), '/', -1) AS schema_ref,
  CASE WHEN NOT json_exists(value, '$.schema."$ref"') THEN CAST(json_extract(value, '$.schema') AS VARCHAR) END AS schema_json
  FROM endpoints e, (SELECT key, value, rowid AS n FROM json_each(e.d, '$.requestBody.content')) p""")
def api_request_bodies(spark, sf):
    return A.api_request_bodies(specs(spark, sf))


@query("api_responses", SPECS + f""", statuses AS (
  SELECT repo_name, path, method, endpoint, row_number() OVER (PARTITION BY path, endpoint_ordinal ORDER BY n) - 1 AS response_ordinal,
    key AS status, {get('value', 'description')} AS description, json_extract(value, '$.content') AS content
  FROM endpoints e, (SELECT key, value, rowid AS n FROM json_each(e.d, '$.responses')) p)
  SELECT s.* EXCLUDE (content), CAST(c.key AS VARCHAR) AS content_type, split_part(json_extract_string(c.value, '$.schema."$ref"'), '/', -1) AS schema_ref
  FROM statuses s, (SELECT key, value FROM json_each(s.content)) c WHERE content IS NOT NULL
  UNION ALL SELECT * EXCLUDE (content), NULL, NULL FROM statuses WHERE content IS NULL""")
def api_responses(spark, sf):
    return A.api_responses(specs(spark, sf))


@query("api_examples", SPECS + """ SELECT repo_name, path, method, endpoint,
  row_number() OVER (PARTITION BY path, endpoint_ordinal ORDER BY n) - 1 AS example_ordinal, key AS name,
  CAST(json_extract(value, '$.value') AS VARCHAR) AS value_json FROM endpoints e, (SELECT key, value, rowid AS n FROM json_each(e.d, '$.examples')) p""")
def api_examples(spark, sf):
    return A.api_examples(specs(spark, sf))


def markdown_sql(route: str) -> str:
    return G.CONVERTED + f" SELECT category, path, strlen(markdown) AS n_bytes, md5(markdown) AS markdown_md5 FROM named WHERE route = '{route}'"


WITH_DOCUMENT = G.FILES + f", sources AS (SELECT f.*, d.text, d.n_chars, {G.basename('f.path')} AS fname FROM files f JOIN documents d USING (doc_id))"


def _digest(df, column):
    return df.select("path", F.octet_length(column).cast("long").alias("n_bytes"), F.md5(column).alias("markdown_md5"))


def _expected(where: str, text: str) -> str:
    return WITH_DOCUMENT + f" SELECT path, strlen(m) AS n_bytes, md5(m) AS markdown_md5 FROM (SELECT path, {text} AS m FROM sources WHERE {where})"


@query(
    "api_markdown",
    _expected("ext = 'json' AND doc_id % 3 = 0", f"CASE WHEN doc_id % 2 = 0 THEN {_Text.sql(golden.OPENAPI)} ELSE {_Text.sql(golden.SWAGGER)} END"),
)
def api_markdown(spark, sf):
    from leafmill.operators.routing import is_api_spec

    rows = specs(spark, sf).filter(is_api_spec(F.col("content")))
    return _digest(A.with_api_markdown(rows), "api_markdown")


# --- notebooks ------------------------------------------------------------------------


def notebooks(spark, sf):
    return of_type(spark, sf, ".ipynb")


@query("notebook_cells", G.FILES + """,
cells AS (
  SELECT repo_name, path, c.value AS cell, coalesce(json_extract_string(f.content, '$.metadata.language_info.name'), '') AS language,
    row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS cell_ordinal
  FROM files f, (SELECT value, rowid AS n FROM json_each(f.content, '$.cells')) c WHERE ext = 'ipynb')
SELECT repo_name, path, language, cell_ordinal, json_extract_string(cell, '$.cell_type') AS cell_type,
  CASE WHEN json_type(cell, '$.source') = 'ARRAY' THEN array_to_string(CAST(json_extract(cell, '$.source') AS VARCHAR[]), '')
       ELSE json_extract_string(cell, '$.source') END AS source,
  coalesce(json_array_length(cell, '$.outputs'), 0) AS n_outputs,
  CASE WHEN json_extract_string(cell, '$.cell_type') = 'code' THEN array_to_string([
     array_to_string(CAST(json_extract(cell, '$.outputs[0].text') AS VARCHAR[]), ''), '[image output]',
     json_extract_string(cell, '$.outputs[2].data."text/plain"')], chr(10)) ELSE '' END AS output_text
FROM cells""")
def notebook_cells(spark, sf):
    return N.notebook_cells(notebooks(spark, sf))


@query("notebook_markdown", _expected("ext = 'ipynb'", _Text.sql(golden.NOTEBOOK)))
def notebook_markdown(spark, sf):
    rows = notebooks(spark, sf).withColumn("file_name", F.substring_index("path", "/", -1))
    return _digest(N.with_notebook_markdown(rows), "notebook_markdown")


# --- Python sources --------------------------------------------------------------------

DEF = rx(P.FUNCTION, "s")
PY = G.FILES + f""",
sources AS (SELECT repo_name, path, doc_id, content FROM files WHERE ext = 'py'),
marked AS (SELECT *, string_split(regexp_replace(content, '(?s)({P.FUNCTION.replace("'", "''")})', chr(1) || '\\1', 'g'), chr(1)) AS pieces FROM sources),
functions AS (
  SELECT repo_name, path, doc_id, content, i - 2 AS ordinal, pieces[i] AS piece, regexp_extract(pieces[i], {DEF}, 0) AS head,
    regexp_extract(pieces[i], {DEF}, 1) AS name, trim(regexp_extract(pieces[i], {DEF}, 2)) AS params,
    nullif(trim(regexp_extract(pieces[i], {DEF}, 3)), '') AS return_type
  FROM (SELECT *, unnest(range(2, len(pieces) + 1)) AS i FROM marked)),
documented AS (
  SELECT *, trim(regexp_extract(substring(piece, length(head) + 1), '(?s)\"\"\"(.*?)\"\"\"', 1), ' ' || chr(10)) AS docstring FROM functions)"""


def sources(spark, sf):
    return of_type(spark, sf, ".py")


def functions(spark, sf):
    return Y.py_functions(sources(spark, sf))


@query("py_functions", PY + " SELECT repo_name, path, ordinal, name, return_type, docstring FROM documented")
def py_functions(spark, sf):
    return functions(spark, sf).select("repo_name", "path", "ordinal", "name", "return_type", "docstring")


@query("py_definitions", PY + """ SELECT path, ordinal, CASE WHEN ordinal = 0 THEN '@trace' || chr(10) || '@cache.keep(size=1)' || chr(10) ELSE '' END || head AS full_definition FROM functions""")
def py_definitions(spark, sf):
    return functions(spark, sf).select("path", "ordinal", "full_definition")


TYPED = rx("^" + P.TYPED_PARAMETER)
PLAIN = rx("^" + P.PLAIN_PARAMETER)


@query("py_parameters", PY + f""", parts AS (
  SELECT repo_name, path, ordinal, name AS function, trim(part) AS part, pos FROM (
    SELECT *, unnest(string_split(regexp_replace(params, '(\\[[^\\]]*),', '\\1' || chr(2), 'g'), ',')) AS raw, generate_subscripts(string_split(regexp_replace(params, '(\\[[^\\]]*),', '\\1' || chr(2), 'g'), ','), 1) AS pos,
    FROM functions), (SELECT 1) one, (SELECT replace(raw, chr(2), ',') AS part) s)
  SELECT repo_name, path, ordinal, function, row_number() OVER (PARTITION BY path, ordinal ORDER BY pos) - 1 AS parameter_ordinal,
    regexp_extract(part, {PLAIN}, 1) AS name,
    CASE WHEN regexp_matches(part, {TYPED}) THEN regexp_extract(part, {TYPED}, 2) END AS type,
    nullif(CASE WHEN regexp_matches(part, {TYPED}) THEN regexp_extract(part, {TYPED}, 3) ELSE regexp_extract(part, {PLAIN}, 2) END, '') AS "default"
  FROM parts WHERE regexp_matches(part, {PLAIN})""")
def py_parameters(spark, sf):
    return Y.py_parameters(functions(spark, sf))


@query("py_parameter_docs", PY + """ SELECT repo_name, path, ordinal, name AS function, unnest(['a', 'b', 'd']) AS parameter,
  unnest(['str', NULL, NULL]) AS type, unnest(['first value', 'second value' || chr(10) || '           on two lines', 'kept']) AS description
  FROM documented WHERE contains(docstring, 'Args:')""")
def py_parameter_docs(spark, sf):
    return Y.py_parameter_docs(functions(spark, sf))


@query("py_returns", PY + r""", sections AS (SELECT *, trim(regexp_extract(docstring, '(?s)Returns:(.*?)(?:Raises:|Yields:|Examples:|\z)', 1), ' ' || chr(10)) AS section FROM documented WHERE contains(docstring, 'Returns:'))
  SELECT path, ordinal, trim(split_part(section, ':', 1)) AS type, trim(substring(section, strpos(section, ':') + 1)) AS description FROM sections""")
def py_returns(spark, sf):
    return functions(spark, sf).filter("return_info IS NOT NULL").select("path", "ordinal", "return_info.*")


@query("py_examples", PY + """ SELECT repo_name, path, ordinal, name AS function, 0 AS example_ordinal,
  concat('intro', chr(10), name, '(1)', chr(10), chr(10), name, '(2)', chr(10), 'end', chr(10), 'g()') AS example
  FROM documented WHERE contains(docstring, 'Examples:')""")
def py_examples(spark, sf):
    return Y.py_examples(functions(spark, sf))


@query("py_modules", PY + r""" SELECT path, trim(regexp_extract(content, '(?s)\"\"\"(.*?)\"\"\"', 1), ' ' || chr(10)) AS docstring,
  array_to_string(regexp_extract_all(content, '(?m)^(?:from|import)\s+.*?$'), chr(10)) AS imports FROM sources""".replace('\\"', '"'))
def py_modules(spark, sf):
    modules = Y.py_modules(sources(spark, sf))
    return modules.select("path", "docstring", F.array_join("imports", "\n").alias("imports"))


HEADER = rx(P.CLASS_HEADER)
CLASSES = PY + f""",
pieces AS (SELECT *, unnest(string_split(content, 'class')[2:]) AS after, generate_subscripts(string_split(content, 'class')[2:], 1) AS pos FROM sources),
classes AS (
  SELECT repo_name, path, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS ordinal,
    regexp_extract('class' || after, {HEADER}, 1) AS name, regexp_extract('class' || after, {HEADER}, 2) AS parents,
    substring('class' || after, length(regexp_extract('class' || after, {HEADER}, 0)) + 1) AS body
  FROM pieces WHERE regexp_matches('class' || after, '^' || {HEADER}))"""


@query("py_classes", CLASSES + """ SELECT repo_name, path, ordinal, name, parents,
  trim(regexp_extract(body, '(?s)\"\"\"(.*?)\"\"\"', 1), ' ' || chr(10)) AS docstring, md5(body) AS body_md5 FROM classes""")
def py_classes(spark, sf):
    classes = Y.py_classes(sources(spark, sf))
    return classes.select("repo_name", "path", "ordinal", "name", "parents", "docstring", F.md5("body").alias("body_md5"))


@query("py_methods", CLASSES + f""", marks AS (
    SELECT *, string_split(regexp_replace(body, '(?s)({P.FUNCTION.replace("'", "''")})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM classes),
  found AS (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM marks),
  windows AS (SELECT *, parts[i] AS here, array_to_string(parts[i:], '') AS rest, regexp_extract(parts[i], {DEF}, 0) AS head FROM found)
  SELECT repo_name, path, name AS class, ordinal, i - 2 AS method_ordinal, regexp_extract(here, {DEF}, 1) AS method,
    regexp_extract(here, {DEF}, 1) || '(' || regexp_extract(here, {DEF}, 2) || ')' ||
      CASE WHEN regexp_extract(here, {DEF}, 3) <> '' THEN ' -> ' || regexp_extract(here, {DEF}, 3) ELSE '' END AS signature,
    trim(regexp_extract(substring(rest, 1, length(head) + 200), '(?s)\"\"\"(.*?)\"\"\"', 1), ' ' || chr(10)) AS docstring
  FROM windows""")
def py_methods(spark, sf):
    return Y.py_methods(Y.py_classes(sources(spark, sf)))


def _named_sources(spark, sf):
    return sources(spark, sf).withColumn("file_name", F.substring_index("path", "/", -1))


@query("py_markdown", _expected("ext = 'py'", _Text.sql(golden.PYTHON)))
def py_markdown(spark, sf):
    return _digest(Y.with_python_markdown(_named_sources(spark, sf)), "python_markdown")


@query("plain_python_markdown", _expected("ext = 'py'", _Text.sql(golden.PLAIN_PYTHON)))
def plain_python_markdown(spark, sf):
    return _digest(Y.with_plain_python_markdown(_named_sources(spark, sf)), "python_markdown")
