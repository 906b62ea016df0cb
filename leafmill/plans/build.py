"""Composed jobs.

Order of work, and what moves:

1. slim: list files, choose categories. No text yet.
2. read text of the chosen files and convert it, one map-only stage, written
   once as the ``converted`` table under the scratch folder.
3. slim again: collisions and split cuts from a few columns of that table,
   written as small tables. Being files, their size is known to the planner,
   which then broadcasts them only if they are small and joins by a spread
   (salted or unique) key if they are not.
4. one pass over ``converted`` to the standard corpus; then ``converted`` and the small tables are removed,
   and the other corpora are written from the standard one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import catalog as C
from leafmill.operators import routing as R
from leafmill.operators import scan as S
from leafmill.operators.convert import conversion_errors, convert_files
from leafmill.operators.corpora import code_generation_corpus, sft_corpus
from leafmill.operators.joins import sized_join
from leafmill.operators.metadata import standardise, with_metadata
from leafmill.operators.split import apply_cuts, split_cuts
from leafmill.session import intermediates, written
from leafmill.sinks.writers import write_corpus, write_csv
from leafmill.sources.tree import list_tree, read_contents, read_tasks

SLIM = ["repo_name", "rel_path", "path", "length", "modified"]


@dataclass
class Corpora:
    standard: DataFrame
    sft: DataFrame
    code_generation: DataFrame


def plan_files(files: DataFrame) -> DataFrame:
    """Chosen (file, category) rows without text."""
    return S.with_path_in_category(S.assign_categories(files))


def convert_repositories(
    files: DataFrame, catalog: DataFrame | None = None, listing: DataFrame | None = None
) -> DataFrame:
    """A files table with text to converted rows, optionally of a catalog only.

    All that is needed from elsewhere is two facts per repository (is it wanted,
    does it have a target folder); both are found on slim columns and joined by
    measured size. Category and inner path follow from the row, so no text moves.
    """
    if catalog is not None:
        slim = choose_repositories(files.select(*SLIM), catalog, listing)
        repos = written(slim.select("repo_name").distinct(), "repositories")
        files = sized_join(files, repos, ["repo_name"], "left_semi", "path")
    return convert_files(plan_files(files))


def read_repositories(spark: SparkSession, root: str) -> DataFrame:
    """Tree below ``root`` to converted rows; text is read after the choice, by
    as many tasks as its bytes ask for."""
    chosen = written(plan_files(written(list_tree(spark, root), "manifest")), "plan")
    return convert_files(read_contents(chosen, root, read_tasks(chosen)))


def records_from_converted(
    converted: DataFrame, test_ratio: float = 0.2, seed: int = 42, compat_flags: bool = False
) -> DataFrame:
    """Written conversions to split, documentation-only standard records."""
    kept = R.drop_failed(converted)
    losers = written(S.collision_losers(kept), "losers")
    unique = S.drop_collision_losers(kept, losers).withColumnRenamed("dest_path", "file_path")
    cuts = written(split_cuts(unique, test_ratio, seed), "cuts")
    rows = apply_cuts(unique, cuts, seed).withColumn("content", F.col("markdown"))
    return standardise(with_metadata(R.keep_documentation(rows)), compat_flags)


def existing_records(files: DataFrame, test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Records of an already converted tree, read again as it is."""
    found = S.existing_outputs(files).withColumnsRenamed({"path": "file_path", "length": "size"})
    candidates = found.filter(R.is_existing_candidate(F.col("file_path"), F.col("content")))
    # The text is looked at once to find the candidates' keys, and once to make the records.
    keys = written(candidates.select("repo_name", "category", "file_path"), "candidates")
    cuts = written(split_cuts(keys, test_ratio, seed), "cuts")
    rows = apply_cuts(candidates, cuts, seed)
    return standardise(with_metadata(R.keep_documentation(rows)))


def build_corpora(records: DataFrame) -> Corpora:
    return Corpora(records, sft_corpus(records), code_generation_corpus(records))


def save_standard(records: DataFrame, output_dir: str) -> DataFrame:
    """Write the standard corpus and read it back; what the records were made from is not needed after that."""
    return records.sparkSession.read.parquet(write_corpus(records, output_dir, "standard")).select(*records.columns)


def save_derived(saved: DataFrame, output_dir: str) -> Corpora:
    """Write the other corpora and the CSVs from the written standard corpus."""
    corpora = build_corpora(saved)
    write_corpus(corpora.sft, output_dir, "sft")
    write_corpus(corpora.code_generation, output_dir, "code_gen")
    write_csv(saved, output_dir)
    return corpora


def save_corpora(records: DataFrame, output_dir: str) -> Corpora:
    """Write the standard corpus, then the others and the CSVs from it."""
    return save_derived(save_standard(records, output_dir), output_dir)


def build_from_tree(
    spark: SparkSession, root: str, output_dir: str, test_ratio: float = 0.2, seed: int = 42
) -> Corpora:
    """All repositories below ``root`` to written corpora."""
    with intermediates(spark):
        converted = written(read_repositories(spark, root), "converted")
        saved = save_standard(records_from_converted(converted, test_ratio, seed), output_dir)
    return save_derived(saved, output_dir)


def rebuild_existing(
    spark: SparkSession, tree: str, output_dir: str, test_ratio: float = 0.2, seed: int = 42
) -> Corpora:
    """A converted tree ``<repo>/<category>/**`` to written corpora.

    Listing, layout and suffix rules come first; only what passes is read.
    """
    with intermediates(spark):
        manifest = written(S.existing_outputs(list_tree(spark, tree)).drop("category"), "manifest")
        files = written(read_contents(manifest, tree, read_tasks(manifest)), "existing")
        saved = save_standard(existing_records(files, test_ratio, seed), output_dir)
    return save_derived(saved, output_dir)


def choose_repositories(files: DataFrame, catalog: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Files of the catalog's repositories.

    A repository entry names one checkout by its short name. An organization
    entry stands for all repositories of ``listing`` (``organization, name,
    clone_url``). One repository asked for twice is processed once.
    """
    repositories = C.with_repository(catalog.filter("coalesce(type, 'repository') <> 'organization'")).select(
        F.col("short_name").alias("repo_name")
    )
    if listing is not None:
        organizations = catalog.filter("type = 'organization'").select(F.col("name").alias("organization"))
        repositories = repositories.unionByName(
            listing.filter(F.col("clone_url").isNotNull())
            .join(organizations.distinct(), "organization", "left_semi")
            .select(F.col("name").alias("repo_name"))
        )
    return sized_join(files, written(repositories.distinct(), "wanted"), ["repo_name"], "left_semi", "path")


def build_catalog(
    files: DataFrame,
    catalog: DataFrame,
    output_dir: str,
    listing: DataFrame | None = None,
    test_ratio: float = 0.2,
    seed: int = 42,
) -> Corpora:
    """All configured repositories of a files table to written corpora."""
    with intermediates(files.sparkSession):
        converted = written(convert_repositories(files, catalog, listing), "converted")
        saved = save_standard(records_from_converted(converted, test_ratio, seed), output_dir)
    return save_derived(saved, output_dir)


def build_organization(
    files: DataFrame, organization: str, listing: DataFrame, output_dir: str, test_ratio: float = 0.2
) -> Corpora:
    """One organization by name: a catalog of one row."""
    row = files.sparkSession.createDataFrame(
        [(organization, "organization", "github", None, 0)],
        "name string, type string, source string, url string, num_files long",
    )
    return build_catalog(files, row, output_dir, listing, test_ratio)


def error_counts(converted: DataFrame) -> DataFrame:
    """What was left out: conversions by reason, and rows beaten in collisions."""
    beaten = S.collision_losers(R.drop_failed(converted)).agg(F.count(F.lit(1)).alias("n_files"))
    return conversion_errors(converted).unionByName(
        beaten.filter("n_files > 0").select(F.lit("destination taken").alias("error"), "n_files")
    )
