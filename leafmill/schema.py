"""The standard record and the constants every operator agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: they must equal the source tool's for equal results. -------
FILE_SUFFIXES = [".md", ".rst", ".txt", ".py", ".ipynb", ".json"]
TARGET_FOLDERS = ["docs", "examples", "cookbook", "cookbooks", "documentation", "tutorials"]
FALLBACK_CATEGORY = "other"
SPEC_ROUTE_KEYS = ["swagger", "openapi", "paths"]
SPEC_DOC_KEYS = ["swagger", "openapi", "paths", "components", "servers"]
MARKDOWN_MARKS = ["# ", "## ", "```", "**", "__"]
HTTP_METHODS = ["get", "post", "put", "delete", "patch"]
RESERVED_FOLDERS = ["__pycache__", "dataset", "sft_dataset", "code_generation_dataset"]
CORPUS_FOLDERS = {
    "standard": "dataset",
    "sft": "sft_dataset",
    "code_gen": "code_generation_dataset",
}
CSV_COLUMNS = [
    "file_name", "repo_name", "category", "title", "description", "file_type",
    "file_size", "creation_date", "modification_date", "split", "is_api_spec",
    "is_sdk_file",
]
EXCLUDED_GLOBS = ["*.bin", "*.pt", "*.pth", "*.ckpt", "*.safetensors", ".git*"]
DESCRIPTION_CHARS = 200
# ------------------------------------------------------------------------------

RECORD_DEFAULTS: list[tuple[str, T.DataType, object]] = [
    ("file_name", T.StringType(), ""),
    ("file_path", T.StringType(), ""),
    ("repo_name", T.StringType(), ""),
    ("category", T.StringType(), ""),
    ("title", T.StringType(), ""),
    ("description", T.StringType(), ""),
    ("file_type", T.StringType(), ""),
    ("file_size", T.LongType(), 0),
    ("creation_date", T.StringType(), ""),
    ("modification_date", T.StringType(), ""),
    ("content", T.StringType(), ""),
    ("split", T.StringType(), ""),
    ("is_api_spec", T.BooleanType(), False),
    ("is_sdk_file", T.BooleanType(), False),
]
RECORD_COLUMNS = [name for name, _, _ in RECORD_DEFAULTS]

CATALOG_DDL = "name string, type string, source string, url string, num_files long"
