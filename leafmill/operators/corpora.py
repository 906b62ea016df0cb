"""Standard records to fine-tuning and code-generation corpora.

All columns are built-in expressions over ``content``; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions.reuse import built_once
from leafmill.functions.text import SENTINEL, found, java, join_all, matches, one_row_per, strip, text
from leafmill.schema import DESCRIPTION_CHARS

# --- Fixed values: template texts that must equal the source tool's. ----------
INSTRUCTION = "Generate code that follows the SDK documentation guidelines and patterns."
RESPONSE = "# I'll write code following the SDK documentation"
PROMPT_HEAD = "# Function definition:"
PROMPT_TAIL = "# Write code that uses this function:"
# ------------------------------------------------------------------------------


def sft_text(title: Column, content: Column) -> Column:
    return text("# ", title, "\n\n", content)


def sft_metadata(repo: Column, category: Column, kind: Column) -> Column:
    return F.to_json(F.struct(repo.alias("repo"), category.alias("category"), kind.alias("type")))


def sft_corpus(records: DataFrame) -> DataFrame:
    """Records plus ``text`` and ``metadata``."""
    return records.withColumns(
        {
            "text": sft_text(F.col("title"), F.col("content")),
            "metadata": sft_metadata(F.col("repo_name"), F.col("category"), F.col("file_type")),
        }
    )


def imports(content: Column) -> Column:
    return matches(content, P.IMPORT_LINE, 0, "m")


def code_blocks(content: Column) -> Column:
    """Contents of fenced blocks, fences paired in order."""
    return matches(content, P.CODE_FENCE, 1, "s")


def example_blocks(blocks: Column) -> Column:
    """Stripped blocks that call something and do not begin with a definition."""
    chosen = F.filter(blocks, lambda b: found(b, P.CALL) & ~strip(b).startswith("def "))
    return F.transform(chosen, strip)


def _definitions(blocks: Column, pattern: str, keyword: str) -> Column:
    """Every match, extended to the next top-level ``keyword`` line or the end.

    Matches are marked in the whole block first, so a match that swallows later
    lines behaves as one. The marked block is then cut before each top-level
    keyword; inside a piece every mark starts one result that runs to the
    piece's end. The work is proportional to the text that comes out.
    """
    mark = F.lit(SENTINEL)

    def marked(b: Column) -> Column:
        return F.regexp_replace(F.replace(b, mark, F.lit("")), java(f"({pattern})", "s"), SENTINEL + "$1")

    pieces = F.flatten(F.transform(blocks, lambda b: F.split(marked(b), f"(?=\n{SENTINEL}?{keyword} )")))
    parts = F.transform(pieces, lambda piece: F.split(piece, SENTINEL))

    def results(p: Column) -> Column:
        starts = F.sequence(F.lit(2), F.size(p))
        return F.transform(starts, lambda i: strip(F.array_join(F.slice(p, i, F.size(p)), "")))

    # sequence(2, 1) would count down, so pieces without a mark leave first.
    return F.flatten(F.transform(F.filter(parts, lambda p: F.size(p) > 1), results))


def function_definitions(blocks: Column) -> Column:
    return _definitions(blocks, P.FUNCTION, "def")


def class_definitions(blocks: Column) -> Column:
    return _definitions(blocks, P.CLASS_HEADER, "class")


def headings(content: Column) -> Column:
    """``array<struct<level,text>>`` of heading lines, code comments included."""
    return F.zip_with(
        matches(content, P.HEADING, 1, "m"),
        matches(content, P.HEADING, 2, "m"),
        lambda marks, words: F.struct(F.length(marks).alias("level"), strip(words).alias("text")),
    )


def _listing(heading: str, items: Column) -> Column:
    block = F.transform(items, lambda x: text("```python\n", x, "\n```\n\n"))
    return F.when(F.size(items) > 0, text(heading, "\n\n", join_all(block))).otherwise("")


@built_once
def sdk_content() -> Column:
    """The assembled document of a code-generation record."""
    c = F.col
    return text(
        "# ", c("title"), "\n\n",
        "Repository: ", c("repo_name"), "\n",
        "Category: ", c("category"), "\n",
        "File Type: ", c("file_type"), "\n\n",
        c("description"), "\n\n",
        F.when(
            F.size("imports") > 0,
            text("## Imports\n\n```python\n", F.array_join("imports", "\n"), "\n```\n\n"),
        ).otherwise(""),
        _listing("## Classes", c("classes")),
        _listing("## Functions", c("functions")),
        _listing("## Examples", c("examples")),
        "## Full Content\n\n", c("content"),
    )


@built_once
def _code_columns() -> dict[str, Column]:
    return {
        "imports": imports(F.col("content")),
        "classes": class_definitions(F.col("_blocks")),
        "functions": function_definitions(F.col("_blocks")),
        "examples": example_blocks(F.col("_blocks")),
        "heading_structure": headings(F.col("content")),
    }


def code_generation_corpus(records: DataFrame) -> DataFrame:
    """Records plus extracted code, heading outline and assembled text."""
    staged = records.withColumn("_blocks", code_blocks(F.col("content"))).withColumns(_code_columns())
    return staged.drop("_blocks").withColumn("sdk_content", sdk_content()).withColumn("text", F.col("sdk_content"))


def instruction_records(corpus: DataFrame) -> DataFrame:
    """User/assistant template around ``sdk_content``."""
    return corpus.withColumn(
        "text", text("<|user|>\n", INSTRUCTION, "\n", F.col("sdk_content"), "\n<|assistant|>\n", RESPONSE)
    )


def calls(examples: Column) -> Column:
    return F.flatten(F.transform(examples, lambda x: matches(x, f"({P.CALL})", 1)))


def completion_records(corpus: DataFrame) -> DataFrame:
    """Prompt and completion from the first function and example, else from title and text."""
    usable = F.exists("examples", lambda x: found(x, P.CALL)) & (F.size("functions") > 0)
    return corpus.withColumns(
        {
            "prompt": F.when(
                usable,
                text(PROMPT_HEAD, "\n\n```python\n", F.get("functions", F.lit(0)), "\n```\n\n", PROMPT_TAIL),
            ).otherwise(F.col("title")),
            "completion": F.when(usable, text("```python\n", F.get("examples", F.lit(0)), "\n```")).otherwise(
                F.substring("content", 1, DESCRIPTION_CHARS)
            ),
        }
    )


def text_only(corpus: DataFrame) -> DataFrame:
    return corpus.select("text")


def exploded(corpus: DataFrame, column: str, value: str) -> DataFrame:
    """One row per element of an extracted list, with its position."""
    return one_row_per(corpus, ["repo_name", "file_path"], column, "ordinal", value)
