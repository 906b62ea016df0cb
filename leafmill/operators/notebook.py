"""Notebooks as a cell table and as Markdown.

The rendering is this package's own small definition: Markdown and raw cells
verbatim, code cells fenced with the kernel language, text outputs indented by
four spaces (an output without plain text shows its Markdown, HTML or LaTeX),
images as a placeholder line, blocks separated by blank lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import jsontext as J
from leafmill.functions import text as X
from leafmill.functions.reuse import built_once

# Version 3 notebooks keep their cells in worksheets and their code in `input`.
CELL = (
    "struct<cell_type:string,source:variant,input:variant,level:int,language:string,"
    "outputs:array<variant>>"
)
NOTEBOOK_DDL = (
    f"struct<cells:array<{CELL}>,worksheets:array<struct<cells:array<{CELL}>>>,"
    "metadata:struct<language_info:struct<name:string>,kernelspec:struct<language:string>>>"
)
IMAGE_LINE = "[image output]"


def multiline(v: Column, path: str = "$") -> Column:
    """A notebook text: a string, or an array of strings to be concatenated."""
    return F.coalesce(
        F.array_join(F.try_variant_get(v, path, "array<string>"), ""),
        F.try_variant_get(v, path, "string"),
    )


def output_text(o: Column) -> Column:
    """Text of one output, NULL when it has nothing to show."""
    kind = F.try_variant_get(o, "$.output_type", "string")
    image = F.coalesce(
        F.try_variant_get(o, "$.data['image/png']", "variant"),
        F.try_variant_get(o, "$.data['image/jpeg']", "variant"),
        F.try_variant_get(o, "$.data['image/svg+xml']", "variant"),
        F.try_variant_get(o, "$.png", "variant"),
        F.try_variant_get(o, "$.jpeg", "variant"),
        F.try_variant_get(o, "$.svg", "variant"),
    )
    plain = F.coalesce(multiline(o, "$.text"), multiline(o, "$.data['text/plain']"))
    trace = F.array_join(F.try_variant_get(o, "$.traceback", "array<string>"), "\n")
    rich = F.coalesce(*[multiline(o, f"$.data['text/{kind}']") for kind in ("markdown", "html", "latex")])
    shown = F.when(image.isNotNull(), F.lit(IMAGE_LINE)).otherwise(F.coalesce(plain, rich))
    return F.when(kind.isin("error", "pyerr"), trace).otherwise(shown)


def indent(c: Column) -> Column:
    """Four spaces before every line that is not empty."""
    return F.regexp_replace(c, r"(?md)^(?=.)", "    ")


def opened(content: Column) -> Column:
    return J.parsed(content, NOTEBOOK_DDL)


def cells(nb: Column) -> Column:
    """Version-4 cells as ``array<struct<cell_type,source,outputs>>``."""

    def as_v4(c: Column) -> Column:
        source = F.coalesce(multiline(c["source"]), multiline(c["input"]), F.lit(""))
        heading = c["cell_type"] == "heading"
        return F.struct(
            F.when(heading, "markdown").otherwise(c["cell_type"]).alias("cell_type"),
            F.when(
                heading, F.concat(F.repeat(F.lit("#"), F.coalesce(c["level"], F.lit(1))), F.lit(" "), source)
            ).otherwise(source).alias("source"),
            F.filter(
                F.transform(F.coalesce(c["outputs"], F.array().cast("array<variant>")), output_text),
                lambda t: t.isNotNull(),
            ).alias("outputs"),
        )

    found = F.coalesce(nb["cells"], F.flatten(F.transform(nb["worksheets"], lambda w: w["cells"])))
    return F.transform(found, as_v4)


def language(nb: Column) -> Column:
    meta = nb["metadata"]
    return F.coalesce(meta["language_info"]["name"], meta["kernelspec"]["language"], F.lit(""))


def render(cell: Column, lang: Column) -> Column:
    code = X.text("```", lang, "\n", cell["source"], "\n```")
    outputs = F.transform(cell["outputs"], lambda t: indent(F.regexp_replace(t, r"\n+\z", "")))
    return F.when(
        cell["cell_type"] == "code", F.array_join(F.concat(F.array(code), outputs), "\n\n")
    ).otherwise(cell["source"])


@built_once
def _markdown_steps(source: str, name: str) -> dict[str, Column]:
    blocks = F.transform("_cells", lambda c: render(c, F.col("_lang")))
    return {
        "opened": opened(F.col(source)),
        "cells": cells(F.col("_nb")),
        "language": language(F.col("_nb")),
        "markdown": X.text("# ", F.col(name), "\n\n", F.array_join(blocks, "\n\n"), "\n"),
    }


def with_notebook_markdown(
    files: DataFrame, source: str = "content", name: str = "file_name", target: str = "notebook_markdown"
) -> DataFrame:
    """Add the Markdown of each notebook, and ``<target>_ok``; NULL and false
    when it is none."""
    step = _markdown_steps(source, name)
    staged = files.withColumn("_nb", step["opened"])
    staged = staged.withColumns({"_cells": step["cells"], "_lang": step["language"]})
    return staged.withColumns({target: step["markdown"], f"{target}_ok": F.col("_cells").isNotNull()}).drop(
        "_nb", "_cells", "_lang"
    )


def notebook_cells(files: DataFrame) -> DataFrame:
    """One row per cell, in order."""
    nb = files.withColumn("_nb", opened(F.col("content")))
    keep = ["repo_name", "path", language(F.col("_nb")).alias("language")]
    return X.one_row_per(nb, keep, cells(F.col("_nb")), "cell_ordinal", "c").select(
        "repo_name",
        "path",
        "language",
        "cell_ordinal",
        F.col("c.cell_type").alias("cell_type"),
        F.col("c.source").alias("source"),
        F.size("c.outputs").alias("n_outputs"),
        F.array_join("c.outputs", "\n").alias("output_text"),
    )
