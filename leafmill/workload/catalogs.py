"""Catalog checks, over ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import catalog as C
from leafmill.sources.listing import normalise_listing
from leafmill.workload import registry as G
from leafmill.workload.registry import files, query, table

# One catalog row per page: names in all the forms users type.
NAME = (
    "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('github.com/org', page_id, '/tool') "
    "WHEN 2 THEN concat('org', page_id % 40) WHEN 3 THEN concat('Team', page_id % 30, '/Repo') "
    "ELSE concat('https://github.com/o', page_id, '/r/') END"
)
URL = "CASE WHEN page_id % 10 < 3 THEN url END"
CATALOG = f"""WITH catalog AS (
  SELECT {NAME} AS name, CASE WHEN page_id % 5 = 2 THEN 'organization' ELSE 'repository' END AS type,
    CASE WHEN page_id % 2 = 0 THEN 'github' ELSE 'huggingface' END AS source, {URL} AS url,
    CASE WHEN page_id % 3 > 0 THEN page_id END AS num_files
  FROM pages)"""


def catalog(spark, sf):
    return table(spark, sf, "pages").selectExpr(
        f"{NAME} AS name",
        "CASE WHEN page_id % 5 = 2 THEN 'organization' ELSE 'repository' END AS type",
        "CASE WHEN page_id % 2 = 0 THEN 'github' ELSE 'huggingface' END AS source",
        f"{URL} AS url",
        "CASE WHEN page_id % 3 > 0 THEN page_id END AS num_files",
    )


REPO_URL = """CASE WHEN url IS NOT NULL THEN url WHEN contains(name, 'github.com') AND starts_with(name, 'http') THEN name
  WHEN contains(name, 'github.com') THEN 'https://' || name ELSE 'https://github.com/' || name END"""


@query("repo_listing", "SELECT CAST(page_id AS VARCHAR) AS name, url AS clone_url FROM pages WHERE page_id % 4 > 0")
def repo_listing(spark, sf):
    listing = table(spark, sf, "pages").selectExpr(
        "CAST(page_id AS STRING) AS name", "CASE WHEN page_id % 4 > 0 THEN url END AS clone_url", "html AS more"
    )
    return normalise_listing(listing)


@query("repository_urls", CATALOG + f""", located AS (SELECT name, {REPO_URL} AS repo_url FROM catalog),
  parts AS (SELECT *, string_split(rtrim(repo_url, '/'), '/') AS p FROM located)
  SELECT name, repo_url, p[-2] || '/' || p[-1] AS full_name, p[-1] AS short_name FROM parts""")
def repository_urls(spark, sf):
    return C.with_repository(catalog(spark, sf)).select("name", "repo_url", "full_name", "short_name")


@query("entered_urls", f"""SELECT page_id, CASE WHEN starts_with(e, 'http://') OR starts_with(e, 'https://') OR NOT contains(e, '/') THEN e
  WHEN starts_with(e, 'github.com/') THEN 'https://' || e ELSE 'https://github.com/' || e END AS repo_url FROM (SELECT page_id, {NAME} AS e FROM pages)""")
def entered_urls(spark, sf):
    typed = table(spark, sf, "pages").selectExpr("page_id", f"concat('  ', {NAME}, ' ') AS e")
    return typed.select("page_id", C.entered_url(F.col("e")).alias("repo_url"))


@query("catalog_inference", f"""SELECT name, CASE WHEN contains(name, '/') THEN 'repository' ELSE 'organization' END AS type,
  CASE WHEN contains(name, 'github.com') THEN 'github' ELSE 'huggingface' END AS source, CAST(0 AS BIGINT) AS num_files
  FROM (SELECT {NAME} AS name FROM pages)""")
def catalog_inference(spark, sf):
    names = table(spark, sf, "pages").selectExpr(f"concat({NAME}, ' ') AS name")
    return C.infer_entries(names).drop("url")


@query("catalog_search", CATALOG + " SELECT * FROM catalog WHERE contains(lower(name), 'hub') OR contains(lower(type), 'hub') OR contains(lower(source), 'hub')")
def catalog_search(spark, sf):
    return C.search(catalog(spark, sf), "HUB")


@query("catalog_append", CATALOG + """, new AS (SELECT DISTINCT 'organization' AS type, concat('org', page_id % 60) AS name, 'github' AS source FROM pages)
  SELECT * FROM catalog UNION ALL BY NAME SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.type = n.type AND c.name = n.name)""")
def catalog_append(spark, sf):
    new = table(spark, sf, "pages").selectExpr(
        "'organization' AS type", "concat('org', page_id % 60) AS name", "'github' AS source"
    ).distinct()
    return C.append_if_absent(catalog(spark, sf), new)


@query("catalog_remove", CATALOG + """ SELECT * FROM catalog c WHERE NOT (type = 'organization' AND coalesce(num_files, 0) % 2 = 0)""")
def catalog_remove(spark, sf):
    gone = catalog(spark, sf).filter("type = 'organization' AND coalesce(num_files, 0) % 2 = 0")
    return C.remove(catalog(spark, sf), gone)


@query("target_folder_listing", G.FILES + f""" SELECT repo_name, bool_or(lower(string_split(rel_path, '/')[1]) IN ({G.TARGETS})) AS has_target
  FROM files GROUP BY 1""")
def target_folder_listing(spark, sf):
    listing = files(spark, sf).selectExpr("repo_name", "split(rel_path, '/')[0] AS name", "'dir' AS type")
    return C.has_target_folder(listing)
