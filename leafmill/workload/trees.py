"""Scan, category, route and predicate checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import jsontext as J
from leafmill.functions import text as X
from leafmill.operators import metadata as M
from leafmill.operators import routing as R
from leafmill.operators import scan as S
from leafmill.operators import split as T
from leafmill.operators.convert import conversion_errors, convert_files, count_routes
from leafmill.session import written
from leafmill.workload import registry as G
from leafmill.workload.registry import assigned, files, of_type, query, raw_records, table


@query("tree_scan", G.FILES + f" SELECT repo_name, rel_path, length FROM files WHERE NOT list_contains(string_split(rel_path, '/'), '.git') AND {G.SUFFIX}")
def tree_scan(spark, sf):
    return S.select_suffixes(S.exclude_git(files(spark, sf))).select("repo_name", "rel_path", "length")


@query("git_exclusion", G.FILES + " SELECT path FROM files WHERE NOT list_contains(string_split(rel_path, '/'), '.git')")
def git_exclusion(spark, sf):
    return S.exclude_git(files(spark, sf)).select("path")


@query("suffix_filter", G.FILES + f" SELECT path FROM files WHERE {G.SUFFIX}")
def suffix_filter(spark, sf):
    return S.select_suffixes(files(spark, sf)).select("path")


@query(
    "existing_outputs",
    G.FILES + f" SELECT repo_name, string_split(rel_path, '/')[1] AS category, path FROM files "
    f"WHERE string_split(rel_path, '/')[1] IN ({G.TARGETS}, 'other') "
    "AND repo_name NOT IN ('__pycache__', 'dataset', 'sft_dataset', 'code_generation_dataset')",
)
def existing_outputs(spark, sf):
    return S.existing_outputs(files(spark, sf)).select("repo_name", "category", "path")


@query("text_decoding", "SELECT doc_id, md5(text || chr(10) || 'end' || chr(65533)) AS text_md5 FROM documents")
def text_decoding(spark, sf):
    """Windows line ends, a broken byte and a genuine U+FFFD around every text."""
    docs = table(spark, sf, "documents")
    raw = F.concat(
        F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary"),
        F.unhex(F.lit("0DC3656E64EFBFBDFF")),
    )
    return docs.select("doc_id", F.md5(X.decode_text(raw)).alias("text_md5"))


@query("json_documents", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE json_valid(props)")
def json_documents(spark, sf):
    opened = table(spark, sf, "events").select("event_id", J.as_object(F.col("props")).alias("props"))
    return opened.filter(F.col("props").isNotNull()).select("event_id", F.col("props")["k"].alias("k"))


@query("category_assignment", G.ASSIGNED + " SELECT repo_name, category, path FROM assigned")
def category_assignment(spark, sf):
    return assigned(spark, sf).select("repo_name", "category", "path")


@query("path_in_category", G.ASSIGNED + " SELECT category, path, rel_in_category FROM assigned")
def path_in_category(spark, sf):
    return assigned(spark, sf).select("category", "path", "rel_in_category")


@query("destination_path", G.CONVERTED + " SELECT category, path, dest_path FROM named")
def destination_path(spark, sf):
    rows = R.with_route(assigned(spark, sf))
    return S.with_destination(rows, F.col("route") == "api").select("category", "path", "dest_path")


@query("route_counts", G.FILES + f" SELECT {G.ROUTE} AS route, count(*) AS n_files FROM files GROUP BY 1")
def route_counts(spark, sf):
    return count_routes(files(spark, sf))


@query("spec_detection", G.FILES + f" SELECT path, {G.ROUTE} = 'api' AS is_api FROM files WHERE ext = 'json'")
def spec_detection(spark, sf):
    rows = of_type(spark, sf, ".json")
    return rows.select("path", R.is_api_spec(F.col("content")).alias("is_api"))


@query("json_key_detection", "SELECT event_id, coalesce(list_has_any(json_keys(props), ['k']), false) AS has_k FROM events")
def json_key_detection(spark, sf):
    return table(spark, sf, "events").select("event_id", J.has_any_key(F.col("props"), ["k"]).alias("has_k"))


@query("documentation_filter", G.FILES + f" SELECT path FROM files WHERE {G.documentation_sql('path', 'content')}")
def documentation_filter(spark, sf):
    return R.keep_documentation(files(spark, sf), "path").select("path")


@query(
    "existing_candidates",
    G.FILES + " SELECT path FROM files WHERE suffix(path, '.py') OR suffix(path, '.ipynb') OR suffix(path, '.md') "
    f"OR suffix(path, '.rst') OR suffix(path, '.txt') OR ({G.documentation_sql('path', 'content')})",
)
def existing_candidates(spark, sf):
    rows = files(spark, sf)
    return rows.filter(R.is_existing_candidate(F.col("path"), F.col("content"))).select("path")


@query("titles", G.RAW + " SELECT file_path, title FROM records")
def titles(spark, sf):
    return raw_records(spark, sf).select("file_path", "title")


@query("descriptions", G.RAW + " SELECT file_path, description FROM records")
def descriptions(spark, sf):
    return raw_records(spark, sf).select("file_path", "description")


@query("file_facts", G.RAW + " SELECT file_path, file_name, file_type, file_size, modification_date FROM records")
def file_facts(spark, sf):
    return raw_records(spark, sf).select("file_path", "file_name", "file_type", "file_size", "modification_date")


@query(
    "unreadable_records",
    G.FILES + f" SELECT path AS file_path, {G.basename('path')} AS title, '' AS description, 'unknown' AS file_type, "
    "CAST(0 AS BIGINT) AS file_size, '' AS modification_date FROM files WHERE doc_id % 11 = 0",
)
def unreadable_records(spark, sf):
    """Files whose text could not be read still give a record."""
    lost = F.when(F.col("doc_id") % 11 != 0, F.col("content"))
    rows = files(spark, sf).withColumnsRenamed({"path": "file_path", "length": "size"}).withColumn("content", lost)
    return (
        M.with_metadata(rows)
        .filter("content IS NULL")
        .select("file_path", "title", "description", "file_type", "file_size", "modification_date")
    )


@query(
    "standard_records",
    G.RAW + " SELECT file_name, file_path, repo_name, category, title, description, file_type, file_size, "
    "modification_date AS creation_date, modification_date, md5(content) AS content, '' AS split, "
    "false AS is_api_spec, false AS is_sdk_file FROM records",
)
def standard_records(spark, sf):
    return M.standardise(raw_records(spark, sf)).withColumn("content", F.md5("content"))


def converted(spark, sf):
    return convert_files(assigned(spark, sf))


@query("failed_conversions", G.CONVERTED + " SELECT 'not convertible: bad_json' AS error, count(*) AS n_files FROM named WHERE markdown IS NULL")
def failed_conversions(spark, sf):
    return conversion_errors(converted(spark, sf))


@query("successful_conversions", G.CONVERTED + " SELECT category, path, route FROM kept")
def successful_conversions(spark, sf):
    return R.drop_failed(converted(spark, sf)).select("category", "path", "route")


@query("collision_winners", G.CONVERTED + " SELECT dest_path, path FROM winners")
def collision_winners(spark, sf):
    rows = R.drop_failed(converted(spark, sf)).select("dest_path", "path")
    return S.drop_collision_losers(written(rows, "destinations"))


@query("collision_counts", G.CONVERTED + " SELECT dest_path, min(struct_pack(e := " + G.extension("path") + ", p := path)).p AS path, count(*) - 1 AS losers FROM kept GROUP BY 1")
def collision_counts(spark, sf):
    return S.collisions(R.drop_failed(converted(spark, sf)))


@query("excluded_globs", "SELECT doc_id, rel_path FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'w/' || doc_id || '.bin' WHEN 1 THEN doc_id || '.pt' WHEN 2 THEN 'x.pth/' || doc_id WHEN 3 THEN doc_id || '.safetensors' WHEN 4 THEN '.gitignore' || doc_id WHEN 5 THEN 'a/.git/' || doc_id WHEN 6 THEN doc_id || '.ckpt' ELSE doc_id || '.md' END AS rel_path FROM documents) WHERE doc_id % 8 IN (2, 5, 7)")
def excluded_globs(spark, sf):
    names = F.expr(
        "CASE doc_id % 8 WHEN 0 THEN concat('w/', doc_id, '.bin') WHEN 1 THEN concat(doc_id, '.pt') "
        "WHEN 2 THEN concat('x.pth/', doc_id) WHEN 3 THEN concat(doc_id, '.safetensors') "
        "WHEN 4 THEN concat('.gitignore', doc_id) WHEN 5 THEN concat('a/.git/', doc_id) "
        "WHEN 6 THEN concat(doc_id, '.ckpt') ELSE concat(doc_id, '.md') END"
    )
    return R.exclude_globs(table(spark, sf, "documents").select("doc_id", names.alias("rel_path")))


@query("files_by_category", G.ASSIGNED + " SELECT repo_name, category, count(*) AS n_files FROM assigned GROUP BY 1, 2")
def files_by_category(spark, sf):
    return S.count_by_category(assigned(spark, sf))


@query("category_counts", G.ASSIGNED + " SELECT repo_name, category, count(*) AS n_files FROM assigned GROUP BY ROLLUP (repo_name, category)")
def category_counts(spark, sf):
    return S.count_with_totals(assigned(spark, sf))


def _split_rows(spark, sf):
    rows = assigned(spark, sf).select("repo_name", "category", "path")
    return T.stratified_split(rows, path="path")


SPLIT = G.ASSIGNED + f", split_rows AS ({G.split_sql('assigned', 'path')})"


@query("stratified_split", SPLIT + " SELECT repo_name, category, path, split FROM split_rows")
def stratified_split(spark, sf):
    return _split_rows(spark, sf).select("repo_name", "category", "path", "split")


@query("stratified_split_ratios", G.ASSIGNED + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {r} AS ratio, repo_name, category, split, count(*) AS n FROM ({G.split_sql('assigned', 'path', r, 7)}) GROUP BY ALL"
    for r in ("CAST(0.0 AS DOUBLE)", "CAST(0.1 AS DOUBLE)", "CAST(0.9 AS DOUBLE)", "CAST(1.0 AS DOUBLE)")) + ")")
def stratified_split_ratios(spark, sf):
    rows = assigned(spark, sf).select("repo_name", "category", "path")
    parts = [
        T.stratified_split(rows, ratio, 7, path="path")
        .groupBy("repo_name", "category", "split")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ratio", F.lit(ratio))
        for ratio in (0.0, 0.1, 0.9, 1.0)
    ]
    return M.union_records(*parts)


@query("stratified_split_by_source", G.ASSIGNED + """, turns AS (
  SELECT repo_name, path, row_number() OVER (PARTITION BY repo_name ORDER BY md5('42:' || path), path) AS turn,
    CAST(count(*) OVER (PARTITION BY repo_name) AS DOUBLE) AS n FROM (SELECT DISTINCT repo_name, path FROM assigned))
  SELECT repo_name, category, path, CASE WHEN turn <= greatest(1, floor(n * (CAST(1.0 AS DOUBLE) - CAST(0.2 AS DOUBLE)))) THEN 'train' ELSE 'test' END AS split
  FROM assigned JOIN turns USING (repo_name, path)""")
def stratified_split_by_source(spark, sf):
    return T.split_by_source(assigned(spark, sf).select("repo_name", "category", "path"))


@query("split_order", G.ASSIGNED + " SELECT category, path, md5('42:' || path) AS order_hash FROM assigned")
def split_order(spark, sf):
    return assigned(spark, sf).select("category", "path", T.order_hash(F.col("path"), 42).alias("order_hash"))


@query("split_counts", SPLIT + " SELECT split, count(*) AS n_records FROM split_rows GROUP BY 1")
def split_counts(spark, sf):
    return T.count_by_split(_split_rows(spark, sf))


@query("csv_record_counts", SPLIT + " SELECT coalesce(split, 'metadata') AS output, count(*) AS n_records FROM split_rows GROUP BY ROLLUP (split)")
def csv_record_counts(spark, sf):
    return T.count_outputs(_split_rows(spark, sf))


@query("split_partition", SPLIT + " SELECT path, category FROM split_rows WHERE split = 'test'")
def split_partition(spark, sf):
    return T.only(_split_rows(spark, sf), "test").select("path", "category")


@query("combined_splits", SPLIT + " SELECT path, category FROM split_rows")
def combined_splits(spark, sf):
    rows = _split_rows(spark, sf)
    return rows.select("path", "category")


@query("record_union", G.RAW + " SELECT file_path, file_type, CAST(NULL AS VARCHAR) AS tag FROM records UNION ALL SELECT 'again/' || file_path, file_type, 'second' FROM records")
def record_union(spark, sf):
    first = raw_records(spark, sf).select("file_path", "file_type")
    second = first.withColumns({"file_path": F.concat(F.lit("again/"), "file_path"), "tag": F.lit("second")})
    return M.union_records(first, second)


@query("content_prefix", G.FILES + " SELECT path, substring(content, 1, 200) AS prefix FROM files")
def content_prefix(spark, sf):
    return files(spark, sf).select("path", F.substring("content", 1, 200).alias("prefix"))


@query("pass_through", G.CONVERTED + " SELECT category, path, dest_path, md5(content) AS text_md5, length AS size FROM named WHERE route IN ('copy', 'json')")
def pass_through(spark, sf):
    rows = converted(spark, sf).filter("route IN ('copy', 'json')")
    return rows.select("category", "path", "dest_path", F.md5("markdown").alias("text_md5"), "size")

