"""Corpus checks: fine-tuning and code-generation columns, sinks, whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.operators import corpora as K
from leafmill.operators import maps
from leafmill.operators import metadata as M
from leafmill.operators import split as T
from leafmill.operators.convert import convert_files
from leafmill.plans import build as B
from leafmill.session import scratch, written
from leafmill.sinks import writers as W
from leafmill.sources.corpus import load_corpus
from leafmill.workload import registry as G
from leafmill.workload.registry import assigned, files, query, raw_records, rx, table


def corpus(spark, sf):
    return K.code_generation_corpus(raw_records(spark, sf))


FENCE = rx(P.CODE_FENCE, "s")
CALL = rx(P.CALL)
NL = "chr(10)"
RAW = G.RAW


def _definitions(pattern: str, keyword: str, name: str) -> str:
    regex = f"(?s)({pattern})".replace("'", "''")
    return f"""
{name}_marked AS (SELECT file_path, block_ordinal, string_split(regexp_replace(block, '{regex}', chr(1) || '\\1', 'g'), chr(1)) AS p FROM blocks),
{name} AS (
  SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY block_ordinal, i) - 1 AS ordinal,
    {G.py_strip(f"split_part(array_to_string(p[i:], ''), {NL} || '{keyword} ', 1)")} AS definition
  FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM {name}_marked))"""


CODE = RAW + f""",
blocks AS (
  SELECT file_path, unnest(regexp_extract_all(content, {FENCE}, 1)) AS block,
    generate_subscripts(regexp_extract_all(content, {FENCE}, 1), 1) - 1 AS block_ordinal FROM records),
{_definitions(P.FUNCTION, 'def', 'functions').strip()},
{_definitions(P.CLASS_HEADER, 'class', 'classes').strip()},
examples AS (
  SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY block_ordinal) - 1 AS ordinal, {G.py_strip('block')} AS example
  FROM blocks WHERE regexp_matches(block, {CALL}) AND NOT starts_with({G.py_strip('block')}, 'def ')),
lists AS (
  SELECT r.*, regexp_extract_all(content, {rx(P.IMPORT_LINE, 'm')}) AS imports,
    coalesce((SELECT list(definition ORDER BY ordinal) FROM functions f WHERE f.file_path = r.file_path), []) AS functions,
    coalesce((SELECT list(definition ORDER BY ordinal) FROM classes f WHERE f.file_path = r.file_path), []) AS classes,
    coalesce((SELECT list(example ORDER BY ordinal) FROM examples f WHERE f.file_path = r.file_path), []) AS examples
  FROM records r),
corpus AS (
  SELECT *, concat('# ', title, {NL}, {NL}, 'Repository: ', repo_name, {NL}, 'Category: ', category, {NL}, 'File Type: ', file_type, {NL}, {NL},
    description, {NL}, {NL},
    CASE WHEN len(imports) > 0 THEN concat('## Imports', {NL}, {NL}, '```python', {NL}, array_to_string(imports, {NL}), {NL}, '```', {NL}, {NL}) ELSE '' END,
    {{classes}}, {{functions}}, {{examples}}, '## Full Content', {NL}, {NL}, content) AS sdk_content
  FROM lists)"""


def _listing(heading: str, column: str) -> str:
    item = f"concat('```python', {NL}, x, {NL}, '```', {NL}, {NL})"
    return (
        f"CASE WHEN len({column}) > 0 THEN concat('## {heading}', {NL}, {NL}, "
        f"array_to_string(list_transform({column}, lambda x: {item}), '')) ELSE '' END"
    )


for _name in ("Classes", "Functions", "Examples"):
    CODE = CODE.replace("{" + _name.lower() + "}", _listing(_name, _name.lower()))


@query("sft_text", RAW + f" SELECT file_path, md5('# ' || title || {NL} || {NL} || content) AS text_md5 FROM records")
def sft_text(spark, sf):
    return K.sft_corpus(raw_records(spark, sf)).select("file_path", F.md5("text").alias("text_md5"))


@query("sft_metadata", RAW + """ SELECT file_path, '{"repo":"' || repo_name || '","category":"' || category || '","type":"' || file_type || '"}' AS metadata FROM records""")
def sft_metadata(spark, sf):
    return K.sft_corpus(raw_records(spark, sf)).select("file_path", "metadata")


@query("imports", RAW + f" SELECT file_path, unnest(i) AS import, generate_subscripts(i, 1) - 1 AS ordinal FROM (SELECT file_path, regexp_extract_all(content, {rx(P.IMPORT_LINE, 'm')}) AS i FROM records)")
def imports(spark, sf):
    rows = raw_records(spark, sf).withColumn("imports", K.imports(F.col("content")))
    return K.exploded(rows, "imports", "import").drop("repo_name")


@query("code_blocks", CODE + " SELECT file_path, block_ordinal AS ordinal, block FROM blocks")
def code_blocks(spark, sf):
    rows = raw_records(spark, sf).withColumn("blocks", K.code_blocks(F.col("content")))
    return K.exploded(rows, "blocks", "block").drop("repo_name")


@query("example_blocks", CODE + " SELECT file_path, ordinal, example FROM examples")
def example_blocks(spark, sf):
    rows = raw_records(spark, sf).withColumn("examples", K.example_blocks(K.code_blocks(F.col("content"))))
    return K.exploded(rows, "examples", "example").drop("repo_name")


@query("function_definitions", CODE + " SELECT file_path, ordinal, definition FROM functions")
def function_definitions(spark, sf):
    rows = raw_records(spark, sf).withColumn("functions", K.function_definitions(K.code_blocks(F.col("content"))))
    return K.exploded(rows, "functions", "definition").drop("repo_name")


@query("class_definitions", CODE + " SELECT file_path, ordinal, definition FROM classes")
def class_definitions(spark, sf):
    rows = raw_records(spark, sf).withColumn("classes", K.class_definitions(K.code_blocks(F.col("content"))))
    return K.exploded(rows, "classes", "definition").drop("repo_name")


@query("heading_outline", RAW + f""" SELECT file_path, generate_subscripts(marks, 1) - 1 AS ordinal, length(unnest(marks)) AS level, {G.py_strip('unnest(words)')} AS text
  FROM (SELECT file_path, regexp_extract_all(content, {rx(P.HEADING, 'm')}, 1) AS marks, regexp_extract_all(content, {rx(P.HEADING, 'm')}, 2) AS words FROM records)""")
def heading_outline(spark, sf):
    rows = raw_records(spark, sf).withColumn("outline", K.headings(F.col("content")))
    return K.exploded(rows, "outline", "h").select("file_path", "ordinal", "h.*")


@query("sdk_content", CODE + " SELECT file_path, strlen(sdk_content) AS n_bytes, md5(sdk_content) AS text_md5 FROM corpus")
def sdk_content(spark, sf):
    return corpus(spark, sf).select("file_path", F.octet_length("sdk_content").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


@query("code_generation_records", CODE + f""" SELECT file_path, title, len(imports) AS n_imports, len(classes) AS n_classes, len(functions) AS n_functions,
  len(examples) AS n_examples, md5(array_to_string(functions, {NL})) AS functions_md5, md5(array_to_string(examples, {NL})) AS examples_md5, md5(sdk_content) AS text_md5 FROM corpus""")
def code_generation_records(spark, sf):
    return corpus(spark, sf).select(
        "file_path",
        "title",
        *[F.size(c).alias(f"n_{c}") for c in ("imports", "classes", "functions", "examples")],
        F.md5(F.array_join("functions", "\n")).alias("functions_md5"),
        F.md5(F.array_join("examples", "\n")).alias("examples_md5"),
        F.md5("text").alias("text_md5"),
    )


@query("instruction_records", CODE + f""" SELECT file_path, md5(concat('<|user|>', {NL}, 'Generate code that follows the SDK documentation guidelines and patterns.', {NL},
  sdk_content, {NL}, '<|assistant|>', {NL}, '# I''ll write code following the SDK documentation')) AS text_md5 FROM corpus""")
def instruction_records(spark, sf):
    return K.instruction_records(corpus(spark, sf)).select("file_path", F.md5("text").alias("text_md5"))


@query("instruction_template", f"""SELECT conv_id, turn, concat('<|user|>', {NL}, 'Generate code that follows the SDK documentation guidelines and patterns.', {NL},
  text, {NL}, '<|assistant|>', {NL}, '# I''ll write code following the SDK documentation') AS text FROM conversations""")
def instruction_template(spark, sf):
    turns = table(spark, sf, "conversations").withColumnRenamed("text", "sdk_content")
    return K.instruction_records(turns).select("conv_id", "turn", "text")


USABLE = f"len(list_filter(examples, lambda x: regexp_matches(x, {CALL}))) > 0 AND len(functions) > 0"


@query("completion_records", CODE + f""" SELECT file_path,
  CASE WHEN {USABLE} THEN concat('# Function definition:', {NL}, {NL}, '```python', {NL}, functions[1], {NL}, '```', {NL}, {NL}, '# Write code that uses this function:') ELSE title END AS prompt,
  CASE WHEN {USABLE} THEN concat('```python', {NL}, examples[1], {NL}, '```') ELSE substring(content, 1, 200) END AS completion FROM corpus""")
def completion_records(spark, sf):
    return K.completion_records(corpus(spark, sf)).select("file_path", "prompt", "completion")


@query("calls", CODE + f" SELECT file_path, ordinal, unnest(regexp_extract_all(example, {rx('(' + P.CALL + ')')}, 1)) AS call FROM examples")
def calls(spark, sf):
    rows = raw_records(spark, sf).withColumn("examples", K.example_blocks(K.code_blocks(F.col("content"))))
    single = K.exploded(rows, "examples", "example")
    return single.select("file_path", "ordinal", F.explode(K.calls(F.array("example"))).alias("call"))


@query("text_only", CODE + " SELECT md5(sdk_content) AS text FROM corpus")
def text_only(spark, sf):
    return K.text_only(corpus(spark, sf)).select(F.md5("text").alias("text"))


# --- extension points ----------------------------------------------------------------


@query("row_map", RAW + " SELECT file_path, length(content) AS n_letters FROM records")
def row_map(spark, sf):
    rows = raw_records(spark, sf).select("file_path", "content")
    return maps.map_rows(rows, lambda r: {"n_letters": len(r["content"])}, "n_letters long").drop("content")


@query("file_map", RAW + " SELECT file_path, upper(file_type) AS kind FROM records WHERE file_type <> 'json'")
def file_map(spark, sf):
    rows = raw_records(spark, sf).select("file_path", "file_type")
    return maps.map_files(
        rows,
        lambda r: None if r["file_type"] == "json" else {"file_path": r["file_path"], "kind": r["file_type"].upper()},
        "file_path string, kind string",
    )


@query("file_expand", RAW + f" SELECT file_path, generate_subscripts(w, 1) AS line_no, length(unnest(w)) AS n_letters FROM (SELECT file_path, string_split(content, {NL}) AS w FROM records)")
def file_expand(spark, sf):
    rows = raw_records(spark, sf).select("file_path", "content")
    return maps.expand_files(
        rows,
        lambda r: [
            {"file_path": r["file_path"], "line_no": i, "n_letters": len(line)}
            for i, line in enumerate(r["content"].split("\n"), 1)
        ],
        "file_path string, line_no long, n_letters long",
    )


@query("column_map", RAW + " SELECT file_path, length(title) AS n_letters FROM records")
def column_map(spark, sf):
    return raw_records(spark, sf).withColumn("n_letters", F.length("title")).select("file_path", "n_letters")


# --- sinks ------------------------------------------------------------------------------

SPLIT_RAW = RAW + f""", split_rows AS ({G.split_sql('records', 'file_path')})"""


def split_records(spark, sf):
    return M.standardise(T.stratified_split(raw_records(spark, sf)))


CSV_SQL = """SELECT file_name, repo_name, category, title, nullif(description, '') AS description, file_type, file_size,
  modification_date AS creation_date, modification_date, split, false AS is_api_spec, false AS is_sdk_file FROM split_rows"""


@query("csv_round_trip", SPLIT_RAW + CSV_SQL.replace("nullif(description, '')", "description"))
def csv_round_trip(spark, sf):
    out = scratch(spark, "csv")
    W.write_csv(split_records(spark, sf), out)
    return W.read_csv(spark, out, "metadata")


@query("csv_test_file", SPLIT_RAW + CSV_SQL.replace("nullif(description, '')", "description") + " WHERE split = 'test'")
def csv_test_file(spark, sf):
    out = scratch(spark, "csv")
    W.write_csv(split_records(spark, sf), out)
    return W.read_csv(spark, out, "test")


def _saved(spark, sf, kind):
    out = scratch(spark, f"corpus-{kind}")
    rows = split_records(spark, sf)
    made = {"standard": lambda d: d, "sft": K.sft_corpus, "code_gen": K.code_generation_corpus}[kind](rows)
    W.write_corpus(made, out, kind)
    return load_corpus(spark, out, kind)


@query("corpus_reload", SPLIT_RAW + " SELECT split, count(*) AS n_records FROM split_rows GROUP BY 1")
def corpus_reload(spark, sf):
    return T.count_by_split(_saved(spark, sf, "standard"))


@query("corpus_round_trip", SPLIT_RAW + " SELECT file_path, split, title, description, md5(content) AS content_md5 FROM split_rows")
def corpus_round_trip(spark, sf):
    return _saved(spark, sf, "standard").select("file_path", "split", "title", "description", F.md5("content").alias("content_md5"))


@query("sft_round_trip", SPLIT_RAW + f" SELECT file_path, split, md5('# ' || title || {NL} || {NL} || content) AS text_md5 FROM split_rows")
def sft_round_trip(spark, sf):
    return _saved(spark, sf, "sft").select("file_path", "split", F.md5("text").alias("text_md5"))


@query("code_generation_round_trip", CODE + f", split_rows AS ({G.split_sql('corpus', 'file_path')}) SELECT file_path, split, md5(sdk_content) AS text_md5 FROM split_rows")
def code_generation_round_trip(spark, sf):
    return _saved(spark, sf, "code_gen").select("file_path", "split", F.md5("text").alias("text_md5"))


@query("published_corpus", SPLIT_RAW + " SELECT split, count(*) AS n_records FROM split_rows GROUP BY 1")
def published_corpus(spark, sf):
    return W.publish(split_records(spark, sf), scratch(spark, "published"), W.default_name("org/tool", "standard"))


@query("converted_tree", G.CONVERTED + " SELECT dest_path, path, route, strlen(markdown) AS n_bytes, md5(markdown) AS markdown_md5 FROM winners")
def converted_tree(spark, sf):
    made = B.R.drop_failed(written(convert_files(assigned(spark, sf)), "converted"))
    kept = B.S.drop_collision_losers(made, written(B.S.collision_losers(made), "losers"))
    path = W.write_converted(kept, scratch(spark, "tree"))
    return spark.read.parquet(path).select(
        "dest_path", "path", "route", F.octet_length("markdown").cast("long").alias("n_bytes"), F.md5("markdown").alias("markdown_md5")
    )


# --- whole jobs ---------------------------------------------------------------------------


def built_records(spark, sf):
    made = written(B.convert_repositories(files(spark, sf)), "converted")
    return B.records_from_converted(made)


RECORD_SELECT = """SELECT file_name, file_path, repo_name, category, title, description, file_type, file_size, creation_date,
  modification_date, md5(content) AS content, split, is_api_spec, is_sdk_file FROM records"""


@query("repository_records", G.RECORDS + RECORD_SELECT)
def repository_records(spark, sf):
    return built_records(spark, sf).withColumn("content", F.md5("content"))


@query("corpus_profile", G.RECORDS + " SELECT category, split, count(*) AS n_records, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM records GROUP BY 1, 2")
def corpus_profile(spark, sf):
    rows = built_records(spark, sf)
    return rows.groupBy("category", "split").agg(F.count(F.lit(1)).alias("n_records"), F.sum("file_size").alias("n_bytes"))


@query("build_error_counts", G.CONVERTED + """ SELECT 'not convertible: bad_json' AS error, count(*) AS n_files FROM named WHERE markdown IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'destination taken', (SELECT count(*) FROM kept) - (SELECT count(*) FROM winners)
  WHERE (SELECT count(*) FROM kept) > (SELECT count(*) FROM winners)""")
def build_error_counts(spark, sf):
    return B.error_counts(written(B.convert_repositories(files(spark, sf)), "converted"))


EXISTING = G.FILES + f""",
found AS (
  SELECT *, string_split(rel_path, '/')[1] AS category, path AS file_path FROM files
  WHERE string_split(rel_path, '/')[1] IN ({G.TARGETS}, 'other')
    AND (suffix(path, '.py') OR suffix(path, '.ipynb') OR suffix(path, '.md') OR suffix(path, '.rst') OR suffix(path, '.txt')
      OR ({G.documentation_sql('path', 'content')}))),
split_rows AS ({G.split_sql('found', 'path')}),
records AS (
  SELECT {G.basename('path')} AS file_name, path AS file_path, repo_name, category, {G.title_sql('content', G.basename('path'))} AS title,
    {G.description_sql('content')} AS description, substring({G.extension('path')}, 2) AS file_type, length AS file_size,
    {G.iso('modified')} AS creation_date, {G.iso('modified')} AS modification_date, content, split, false AS is_api_spec, false AS is_sdk_file
  FROM split_rows WHERE {G.documentation_sql('path', 'content')}) """


@query("existing_records", EXISTING + RECORD_SELECT)
def existing_records(spark, sf):
    return B.existing_records(files(spark, sf)).withColumn("content", F.md5("content"))


# The catalog asks for every second repository by name and one organization
# that owns the repositories whose number ends in 1.
LISTING = "SELECT DISTINCT 'org' || right(source, 1) AS organization, source AS name, 'https://github.com/o/' || source AS clone_url FROM documents"


def _catalog(spark, sf):
    repos = table(spark, sf, "documents").select("source").distinct()
    wanted = repos.filter("CAST(substr(source, 4) AS INT) % 2 = 0").selectExpr(
        "concat('o/', source) AS name", "'repository' AS type", "'github' AS source", "CAST(NULL AS STRING) AS url", "0L AS num_files"
    )
    organization = repos.selectExpr(
        "'org1' AS name", "'organization' AS type", "'github' AS source", "CAST(NULL AS STRING) AS url", "0L AS num_files"
    ).distinct()
    listing = repos.selectExpr(
        "concat('org', right(source, 1)) AS organization", "source AS name", "concat('https://github.com/o/', source) AS clone_url"
    )
    return wanted.unionByName(organization), listing


COUNTS = f"""SELECT repo_name, category, split, count(*) AS n_records, CAST(sum(len(list_transform(
    regexp_extract_all(content, {FENCE}, 1), lambda b: 1))) AS BIGINT) AS n_blocks FROM records"""


@query("catalog_corpus", G.RECORDS + f"""{COUNTS} WHERE CAST(substr(repo_name, 4) AS INT) % 2 = 0 OR suffix(repo_name, '1') GROUP BY 1, 2, 3""")
def catalog_corpus(spark, sf):
    catalog, listing = _catalog(spark, sf)
    built = B.build_catalog(files(spark, sf), catalog, scratch(spark, "job"), listing)
    return built.standard.groupBy("repo_name", "category", "split").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.size(K.code_blocks(F.col("content")))).alias("n_blocks")
    )


@query("organization_corpus", G.RECORDS + " SELECT file_path, split, md5('# ' || title || chr(10) || chr(10) || content) AS text_md5 FROM records WHERE suffix(repo_name, '1')")
def organization_corpus(spark, sf):
    _, listing = _catalog(spark, sf)
    built = B.build_organization(files(spark, sf), "org1", listing, scratch(spark, "job"))
    return built.sft.select("file_path", "split", F.md5("text").alias("text_md5"))
