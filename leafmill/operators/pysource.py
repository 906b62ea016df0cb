"""Python sources: functions, parameters, docstrings, classes, Markdown.

One Arrow-batched scanner reports what needs character offsets (where a match
ends, what follows it). Everything else is columns over its result: parameter
records, docstring sections, examples, and the assembly of the Markdown.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions.reuse import built_once
from leafmill.functions.text import SENTINEL, first_match, found, join_all, matches, one_row_per, strip, text
from leafmill.session import slim_batches

FOUND_DDL = (
    "functions array<struct<name:string,parts:array<string>,returns:string,body:string,definition:string>>,"
    "classes array<struct<name:string,parents:string,body:string,"
    "methods:array<struct<name:string,params:string,returns:string,window:string>>>>"
)

# ``P.FUNCTION`` in two halves without backtracking: where a function may begin, and what may end its
# parameters. A source with no such end is read once, not once for each beginning.
_BEGIN = re.compile(r"def\s++([a-zA-Z0-9_]++)\s*+\(")
_END = re.compile(r"\)\s*+(?:->(?:\s*+([a-zA-Z0-9_\[\]\.\'\"<>, ]++)|(?=\s*+:)[^\S ]*+( ))\s*+)?:")
_CLASS = re.compile(P.CLASS_WITH_BODY, re.DOTALL)
_DECORATOR = re.compile(P.DECORATOR, re.MULTILINE)


# --- scanner ---------------------------------------------------------------------


def parameter_parts(params: str) -> list[str]:
    """Pieces between commas outside square brackets; a ``)`` always ends one."""
    pieces, begin, depth = [], 0, 0
    for at, char in enumerate(params):
        depth += (char == "[") - (char == "]")
        if char == ")" or (char == "," and depth == 0):
            pieces.append(params[begin:at].strip())
            begin = at + 1
    if begin < len(params):
        pieces.append(params[begin:].strip())
    return pieces


def signatures(source: str) -> Iterator[tuple[int, int, str, str, str | None]]:
    """Begin, end, name, parameters and return type of each match of ``P.FUNCTION``, in linear time."""
    begin = _BEGIN.search(source)
    while begin:
        end = _END.search(source, begin.end())
        if not end:
            return
        yield begin.start(), end.end(), begin[1], source[begin.end() : end.start()], end[1] or end[2]
        begin = _BEGIN.search(source, end.end())


def find_functions(source: str) -> list[dict]:
    spans = [m.span() for m in _DECORATOR.finditer(source)]
    starts = [s for s, _ in spans]
    result = []
    for first, last, name, params, returns in signatures(source):
        after = source.find("def ", last)
        begin = source.rfind("\n", 0, first) + 1
        end = source.find("\n", last)
        # The earliest decorator that begins inside the window above the line.
        at = bisect_right(starts, begin - P.DECORATOR_WINDOW)
        if at < len(spans) and spans[at][1] <= begin:
            begin = starts[at]
        result.append(
            {
                "name": name,
                "parts": parameter_parts(params.strip()),
                "returns": returns.strip() if returns else None,
                "body": source[last : after if after >= 0 else None],
                "definition": source[begin : end if end >= 0 else None].strip(),
            }
        )
    return result


def find_classes(source: str) -> list[dict]:
    return [
        {
            "name": c[1],
            "parents": c[2] or "",
            "body": c[3],
            "methods": [
                {"name": name, "params": params, "returns": returns or "", "window": c[3][first : last + P.METHOD_WINDOW]}
                for first, last, name, params, returns in signatures(c[3])
            ],
        }
        for c in _CLASS.finditer(source)
    ]


def _scan(sources: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "functions": sources.map(find_functions, na_action="ignore"),
            "classes": sources.map(find_classes, na_action="ignore"),
        },
        dtype=object,
    )


def scan_source(source: Column | str) -> Column:
    """Functions and classes of each source; NULL text gives NULL lists.

    Marked nondeterministic only to keep the optimizer from pushing later
    filters below it, which would scan the sources a second time.
    """
    return F.pandas_udf(_scan, FOUND_DDL).asNondeterministic()(source)


# --- columns over the scanner's result --------------------------------------------


def docstring(body: Column) -> Column:
    """First triple-quoted text; empty when there is none."""
    return strip(first_match(body, P.DOCSTRING, 1, "s"))


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parameter_records(parts: Column) -> Column:
    """``array<struct<name,type,default>>``; pieces such as ``*args`` are dropped."""
    typed, plain = r"\A" + P.TYPED_PARAMETER, r"\A" + P.PLAIN_PARAMETER

    def record(p: Column) -> Column:
        has_type = found(p, typed)
        return F.struct(
            first_match(p, plain, 1).alias("name"),
            F.when(has_type, first_match(p, typed, 2)).alias("type"),
            _null_if_empty(F.when(has_type, first_match(p, typed, 3)).otherwise(first_match(p, plain, 2))).alias("default"),
        )

    return F.filter(F.transform(parts, record), lambda r: r["name"] != "")


def parameter_info(doc: Column) -> Column:
    """``map<name, struct<type,description>>`` of the parameter section."""
    section = strip(first_match(doc, P.PARAMETER_SECTION, 1, "s"))
    names, kinds, notes = (matches(section, P.PARAMETER_ENTRY, g, "s") for g in (1, 2, 3))
    listed = F.arrays_zip(names.alias("name"), kinds.alias("type"), notes.alias("note"))
    # A name that is described again keeps its last description.
    last = F.filter(listed, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["name"]))
    return F.map_from_entries(
        F.transform(
            last,
            lambda e: F.struct(
                e["name"],
                F.struct(_null_if_empty(e["type"]).alias("type"), strip(e["note"]).alias("description")),
            ),
        )
    )


def return_info(doc: Column) -> Column:
    """``struct<type,description>`` of the return section; NULL when it is missing."""
    section = strip(first_match(doc, P.RETURN_SECTION, 1, "s"))
    typed = r"\A" + P.TYPED_RETURN
    has_type = found(section, typed, "s")
    return F.when(
        doc.contains("Returns:"),
        F.struct(
            F.when(has_type, strip(first_match(section, typed, 1, "s"))).alias("type"),
            F.when(has_type, strip(first_match(section, typed, 2, "s"))).otherwise(section).alias("description"),
        ),
    )


def docstring_examples(doc: Column) -> Column:
    """Fenced blocks of the example section, else its runs of indented lines."""
    section = strip(first_match(doc, P.EXAMPLE_SECTION, 1, "s"))
    fenced = matches(section, P.CODE_FENCE, 1, "s")

    def line(raw: Column) -> Column:
        bare = strip(raw)
        return F.when(bare == "", "").when(raw.startswith("    "), bare).otherwise(SENTINEL)

    marked = F.array_join(F.transform(F.split(section, "\n"), line), "\n")
    # Lines that are not indented end a run; blank lines stay inside one.
    runs = F.split(F.concat(marked, F.lit("\n" + SENTINEL)), "\n?" + SENTINEL)
    indented = F.filter(
        F.transform(runs, lambda r: F.regexp_replace(r, r"\A\n+", "")), lambda r: r != ""
    )
    return F.when(F.size(fenced) > 0, fenced).otherwise(indented)


def function_records(functions: Column) -> Column:
    """The nested function records from the scanner's functions."""
    with_doc = F.transform(
        functions, lambda f: F.struct(f.alias("f"), docstring(f["body"]).alias("doc"))
    )
    return F.transform(
        with_doc,
        lambda x: F.struct(
            x["f"]["name"].alias("name"),
            parameter_records(x["f"]["parts"]).alias("parameters"),
            x["f"]["returns"].alias("return_type"),
            x["doc"].alias("docstring"),
            parameter_info(x["doc"]).alias("parameter_info"),
            return_info(x["doc"]).alias("return_info"),
            docstring_examples(x["doc"]).alias("examples"),
            x["f"]["definition"].alias("full_definition"),
        ),
    )


# --- tables -------------------------------------------------------------------------

KEY = ("repo_name", "path")


def py_functions(files: DataFrame) -> DataFrame:
    """One row per function with the nested record; ``ordinal`` = order in the file."""
    slim_batches(files.sparkSession)
    scanned = files.select(*KEY, scan_source("content").alias("_found"))
    return one_row_per(scanned, [*KEY], function_records(F.col("_found.functions")), "ordinal", "f").select(*KEY, "ordinal", "f.*")


def py_parameters(functions: DataFrame) -> DataFrame:
    return functions.select(
        *KEY, "ordinal", F.col("name").alias("function"), F.posexplode("parameters").alias("parameter_ordinal", "p")
    ).select(*KEY, "ordinal", "function", "parameter_ordinal", "p.*")


def py_parameter_docs(functions: DataFrame) -> DataFrame:
    return functions.select(
        *KEY, "ordinal", F.col("name").alias("function"), F.explode("parameter_info").alias("parameter", "v")
    ).select(*KEY, "ordinal", "function", "parameter", "v.*")


def py_examples(functions: DataFrame) -> DataFrame:
    return functions.select(
        *KEY, "ordinal", F.col("name").alias("function"), F.posexplode("examples").alias("example_ordinal", "example")
    )


def module_docstring(content: Column) -> Column:
    return F.when(found(content, P.DOCSTRING, "s"), docstring(content))


def py_modules(files: DataFrame) -> DataFrame:
    """One row per source: module docstring (NULL when absent) and imports."""
    return files.select(
        *KEY,
        module_docstring(F.col("content")).alias("docstring"),
        matches(F.col("content"), P.MODULE_IMPORT, 0, "m").alias("imports"),
    )


def py_classes(files: DataFrame) -> DataFrame:
    slim_batches(files.sparkSession)
    scanned = files.select(*KEY, scan_source("content").alias("_found"))
    return one_row_per(scanned, [*KEY], "_found.classes", "ordinal", "c").select(
        *KEY,
        "ordinal",
        F.col("c.name").alias("name"),
        F.col("c.parents").alias("parents"),
        docstring(F.col("c.body")).alias("docstring"),
        F.col("c.body").alias("body"),
        F.col("c.methods").alias("methods"),
    )


def _signature(m: Column) -> Column:
    return text(
        m["name"], "(", m["params"], ")",
        F.when(m["returns"] != "", text(" -> ", m["returns"])).otherwise(""),
    )


def py_methods(classes: DataFrame) -> DataFrame:
    return classes.select(
        *KEY, F.col("name").alias("class"), "ordinal", F.posexplode("methods").alias("method_ordinal", "m")
    ).select(
        *KEY,
        "class",
        "ordinal",
        "method_ordinal",
        F.col("m.name").alias("method"),
        _signature(F.col("m")).alias("signature"),
        docstring(F.col("m.window")).alias("docstring"),
    )


# --- Markdown -------------------------------------------------------------------------


def _section(heading: str, items: Column, block) -> Column:
    """A heading and its blocks; nothing at all when the list is empty."""
    return F.when(F.size(items) > 0, text(heading, "\n\n", join_all(F.transform(items, block)))).otherwise("")


def _paragraph(c: Column) -> Column:
    return F.when(c != "", text(c, "\n\n")).otherwise("")


def _fence(c: Column) -> Column:
    return text("```python\n", c, "\n```\n\n")


def _doc_paragraph(body: Column) -> Column:
    """The docstring as a paragraph, kept even if it is blank."""
    return F.when(found(body, P.DOCSTRING, "s"), text(docstring(body), "\n\n")).otherwise("")


def _method_block(m: Column) -> Column:
    return text("##### `", _signature(m), "`\n\n", _doc_paragraph(m["window"]))


def _class_block(c: Column) -> Column:
    return text(
        "### `", c["name"], "`\n\n",
        F.when(c["parents"] != "", text("Inherits from: `", c["parents"], "`\n\n")).otherwise(""),
        _doc_paragraph(c["body"]),
        _section("#### Methods", c["methods"], _method_block),
    )


def _function_block(f: Column) -> Column:
    def shown(p: Column) -> Column:
        return text(
            p["name"],
            F.when(p["type"].isNotNull(), text(": ", p["type"])).otherwise(""),
            F.when(p["default"].isNotNull(), text(" = ", p["default"])).otherwise(""),
        )

    def table_row(p: Column) -> Column:
        known = F.coalesce(F.map_contains_key(f["parameter_info"], p["name"]), F.lit(False))
        note = f["parameter_info"][p["name"]]
        kind = F.coalesce(p["type"], F.when(known, F.coalesce(note["type"], F.lit("None"))), F.lit(""))
        return text("| `", p["name"], "` | `", kind, "` | ", F.coalesce(note["description"], F.lit("")), " |\n")

    table = F.when(
        F.size(f["parameter_info"]) > 0,
        text(
            "**Parameters:**\n\n| Name | Type | Description |\n|------|------|-------------|\n",
            join_all(F.transform(f["parameters"], table_row)),
            "\n",
        ),
    ).otherwise("")
    returns = F.when(
        f["return_info"].isNotNull(),
        text(
            "**Returns:**\n\n",
            F.when(F.coalesce(f["return_info"]["type"], F.lit("")) != "", text("Type: `", f["return_info"]["type"], "`\n\n")).otherwise(""),
            f["return_info"]["description"],
            "\n\n",
        ),
    ).otherwise("")
    return text(
        "### `", f["name"], "(", F.array_join(F.transform(f["parameters"], shown), ", "), ")",
        F.when(F.coalesce(f["return_type"], F.lit("")) != "", text(" -> ", f["return_type"])).otherwise(""),
        "`\n\n",
        _paragraph(f["docstring"]),
        table,
        returns,
        _section("**Examples:**", f["examples"], _fence),
        "**Definition:**\n\n",
        _fence(f["full_definition"]),
    )


def _module_section(content: Column) -> Column:
    module = module_docstring(content)
    return F.when(module.isNotNull(), text("## Module Description\n\n", module, "\n\n")).otherwise("")


def _original(content: Column) -> Column:
    return text("## Original Code\n\n```python\n", content, "\n```\n")


@built_once
def _markdown_steps(source: str, name: str) -> dict[str, Column]:
    imports = F.when(
        F.size("_imports") > 0, text("## Imports\n\n", _fence(F.array_join("_imports", "\n")))
    ).otherwise("")
    markdown = text(
        "# ", F.col(name), "\n\n",
        "## SDK Documentation\n\n",
        "This file contains documentation for `", F.col(name), "`.\n\n",
        _module_section(F.col(source)),
        imports,
        _section("## Classes", F.col("_found.classes"), _class_block),
        _section("## Functions", F.col("_functions"), _function_block),
        _original(F.col(source)),
    )
    return {
        "functions": function_records(F.col("_found.functions")),
        "imports": matches(F.col(source), P.MODULE_IMPORT, 0, "m"),
        "markdown": markdown,
    }


def with_python_markdown(
    files: DataFrame, source: str = "content", name: str = "file_name", target: str = "python_markdown"
) -> DataFrame:
    """Add the full Markdown of each source; NULL text gives NULL."""
    step = _markdown_steps(source, name)
    slim_batches(files.sparkSession)
    staged = files.withColumn("_found", scan_source(F.col(source)))
    staged = staged.withColumns({"_functions": step["functions"], "_imports": step["imports"]})
    return staged.withColumn(target, step["markdown"]).drop("_found", "_functions", "_imports")


def with_plain_python_markdown(
    files: DataFrame, source: str = "content", name: str = "file_name", target: str = "python_markdown"
) -> DataFrame:
    """The short variant: docstrings, or else comments, and the code. No Python at all."""

    def body_note(body: Column) -> Column:
        comments = matches(body, P.COMMENT, 1, "m")
        return F.when(found(body, P.DOCSTRING, "s"), text(docstring(body), "\n\n")).otherwise(
            F.when(F.size(comments) > 0, text(F.array_join(comments, "\n"), "\n\n")).otherwise("")
        )

    content = F.col(source)
    functions = F.arrays_zip(
        *[matches(content, P.PLAIN_FUNCTION, g, "s").alias(n) for g, n in ((1, "name"), (2, "params"), (3, "body"))]
    )
    classes = F.arrays_zip(*[matches(content, P.PLAIN_CLASS, g, "s").alias(n) for g, n in ((1, "name"), (2, "body"))])
    staged = files.withColumns({"_functions": functions, "_classes": classes})
    markdown = text(
        "# ", F.col(name), "\n\n",
        _module_section(content),
        _section(
            "## Functions", F.col("_functions"),
            lambda f: text("### `", f["name"], "(", f["params"], ")`\n\n", body_note(f["body"])),
        ),
        _section(
            "## Classes", F.col("_classes"), lambda c: text("### `", c["name"], "`\n\n", body_note(c["body"]))
        ),
        _original(content),
    )
    return staged.withColumn(target, markdown).drop("_functions", "_classes")
