"""OpenAPI / Swagger documents as tables, and as one Markdown text per document.

The JSON is opened level by level in source order. Both forms share the same
column functions; the Markdown is assembled inside the row, so it costs no
shuffle and no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import jsontext as J
from leafmill.functions.reuse import built_once
from leafmill.functions.text import join_all, let, one_row_per, text
from leafmill.schema import HTTP_METHODS

KEY = ("repo_name", "path")
ENDPOINT = [*KEY, "method", "endpoint"]


# --- shared extraction ---------------------------------------------------------


def info(spec: Column) -> Column:
    return J.as_object(spec["info"])


def model_section(spec: Column) -> Column:
    """Text of the schema section: ``components.schemas``, else ``definitions``."""
    components = J.as_object(spec["components"])
    return F.when(J.has(components, "schemas"), components["schemas"]).otherwise(spec["definitions"])


def property_type(details: Column) -> Column:
    """Rendered type of a schema property (``details`` is one opened object)."""
    declared = J.get(details, "type", "object")
    items = J.as_object(details["items"])
    item_type = F.when(J.has(items, "$ref"), text("[", J.ref_name(items["$ref"]), "]")).otherwise(
        J.get(items, "type", "object")
    )
    return (
        F.when((declared == "array") & J.has(details, "items"), text("array of ", item_type))
        .when(J.has(details, "$ref"), text("[", J.ref_name(details["$ref"]), "]"))
        .otherwise(declared)
    )


def endpoints(spec: Column) -> Column:
    """Ordered ``array<struct<path,method,details>>`` of the five HTTP methods."""
    return F.flatten(
        F.transform(
            J.entries(spec["paths"]),
            lambda p: F.transform(
                F.filter(J.entries(p["value"]), lambda m: m["key"].isin(HTTP_METHODS)),
                lambda m: F.struct(
                    p["key"].alias("path"),
                    m["key"].alias("method"),
                    J.as_object(m["value"]).alias("details"),
                ),
            ),
        )
    )


def parameters(details: Column) -> Column:
    """Parameter objects of an endpoint; empty when there are none."""
    return F.coalesce(J.parsed(details["parameters"], J.OBJECT_LIST), F.array().cast(J.OBJECT_LIST))


def parameter_type(p: Column) -> Column:
    return J.get(J.as_object(p["schema"]), "type", J.get(p, "type", "unknown"))


def parameter_need(p: Column) -> Column:
    return F.when(J.truthy(p["required"]), "required").otherwise("optional")


def body_contents(details: Column) -> Column:
    return J.entries(J.as_object(details["requestBody"])["content"])


def schema_ref(content_details: Column) -> Column:
    """Last segment of ``schema.$ref``; NULL when the schema is no reference."""
    schema = J.as_object(J.as_object(content_details)["schema"])
    return F.when(J.has(schema, "$ref"), J.ref_name(schema["$ref"]))


def example_blob(example: Column) -> Column:
    """JSON text of an example's value; a bare string gets its quotes back."""
    value = J.as_object(example)["value"]
    is_string = F.schema_of_variant(J.parsed(example, "struct<value:variant>")["value"]) == "STRING"
    quoted = F.to_json(F.array(value))
    return F.when(is_string, quoted.substr(F.lit(2), F.length(quoted) - 2)).otherwise(
        F.coalesce(value, F.lit("null"))
    )


def is_convertible(spec: Column) -> Column:
    """The parts the renderer opens have the shape it needs.

    A document that fails here yields no file at all.
    """

    def object_or_absent(obj: Column, key: str) -> Column:
        return ~J.has(obj, key) | J.as_object(obj[key]).isNotNull()

    paths_ok = ~J.has(spec, "paths") | F.coalesce(
        F.forall(J.entries(spec["paths"]), lambda p: J.as_object(p["value"]).isNotNull()), F.lit(False)
    )
    methods_ok = F.forall(endpoints(spec), lambda e: e["details"].isNotNull())
    return (
        spec.isNotNull()
        & object_or_absent(spec, "info")
        & object_or_absent(spec, "components")
        & object_or_absent(spec, "paths")
        & paths_ok
        & methods_ok
    )


# --- Markdown, inside the row --------------------------------------------------


def _property_lines(model: Column) -> Column:
    def line(entry: Column) -> Column:
        return let(
            J.as_object(entry["value"]),
            lambda d: text("- `", entry["key"], "` (", property_type(d), "): ", J.get(d, "description", ""), "\n"),
        )

    lines = join_all(F.transform(J.entries(model["properties"]), line))
    return F.when(J.has(model, "properties"), text("**Properties:**\n\n", lines, "\n")).otherwise("")


def _models(section: Column) -> Column:
    def block(entry: Column) -> Column:
        return let(
            J.as_object(entry["value"]),
            lambda m: text(
                "### ", entry["key"], "\n\n",
                F.when(J.has(m, "description"), text(J.get(m, "description", ""), "\n\n")).otherwise(""),
                _property_lines(m),
            ),
        )

    blocks = J.entries(section)
    return F.when(F.size(blocks) > 0, text("## Data Models\n\n", join_all(F.transform(blocks, block)))).otherwise("")


def _parameter_lines(d: Column) -> Column:
    def line(p: Column) -> Column:
        return text(
            "- `", J.get(p, "name", "None"), "` (", J.get(p, "in", "unknown"), ", ", parameter_type(p), ", ",
            parameter_need(p), "): ", J.get(p, "description", ""), "\n",
        )

    rows = parameters(d)
    return F.when(
        F.size(rows) > 0, text("**Parameters:**\n\n", join_all(F.transform(rows, line)), "\n")
    ).otherwise("")


def _body(d: Column, pretty: Column) -> Column:
    def block(entry: Column) -> Column:
        schema = J.as_object(entry["value"])["schema"]
        ref = schema_ref(entry["value"])
        shown = (
            F.when(ref.isNotNull(), text("Schema: `", ref, "`\n\n"))
            .when(schema.isNotNull(), text("```json\n", pretty[schema], "\n```\n\n"))
            .otherwise("")
        )
        return text("Content-Type: `", entry["key"], "`\n\n", shown)

    blocks = join_all(F.transform(body_contents(d), block))
    return F.when(J.has(d, "requestBody"), text("**Request Body:**\n\n", blocks)).otherwise("")


def _responses(d: Column) -> Column:
    def refs(response: Column) -> Column:
        found = F.transform(J.entries(response["content"]), lambda c: schema_ref(c["value"]))
        return join_all(F.transform(F.filter(found, lambda r: r.isNotNull()), lambda r: text("  Schema: `", r, "`\n")))

    def line(entry: Column) -> Column:
        return let(
            J.as_object(entry["value"]),
            lambda r: text("- `", entry["key"], "`: ", J.get(r, "description", ""), "\n", refs(r)),
        )

    lines = join_all(F.transform(J.entries(d["responses"]), line))
    return F.when(J.has(d, "responses"), text("**Responses:**\n\n", lines, "\n")).otherwise("")


def _examples(d: Column, pretty: Column) -> Column:
    def block(entry: Column) -> Column:
        value = F.when(
            J.has(J.as_object(entry["value"]), "value"),
            text("```json\n", pretty[example_blob(entry["value"])], "\n```\n\n"),
        ).otherwise("")
        return text("Example: ", entry["key"], "\n\n", value)

    blocks = join_all(F.transform(J.entries(d["examples"]), block))
    return F.when(J.has(d, "examples"), text("**Examples:**\n\n", blocks)).otherwise("")


def _endpoint(e: Column, pretty: Column) -> Column:
    d = e["details"]
    return text(
        "### `", F.upper(e["method"]), " ", e["path"], "`\n\n",
        J.get(d, "summary", ""), "\n\n",
        J.get(d, "description", ""), "\n\n",
        _parameter_lines(d), _body(d, pretty), _responses(d), _examples(d, pretty),
    )


def _json_blobs(found: Column) -> Column:
    """Distinct JSON texts of a document that are shown indented."""

    def of(e: Column) -> Column:
        schemas = F.transform(
            F.filter(body_contents(e["details"]), lambda c: schema_ref(c["value"]).isNull()),
            lambda c: J.as_object(c["value"])["schema"],
        )
        examples = F.transform(
            F.filter(J.entries(e["details"]["examples"]), lambda x: J.has(J.as_object(x["value"]), "value")),
            lambda x: example_blob(x["value"]),
        )
        return F.concat(schemas, examples)

    return F.array_distinct(F.filter(F.flatten(F.transform(found, of)), lambda b: b.isNotNull()))


@built_once
def _markdown_steps(source: str) -> dict[str, Column]:
    spec, head = F.col("_spec"), info(F.col("_spec"))
    intro = text(
        "# API Reference: ", J.get(head, "title", "Unnamed API"), "\n\n",
        "Version: ", J.get(head, "version", "Unknown"), "\n\n",
        F.when(J.has(head, "description"), text(J.get(head, "description", ""), "\n\n")).otherwise(""),
    )
    body = F.when(
        J.has(spec, "paths"),
        text(
            "## Endpoints\n\n",
            join_all(F.transform(F.col("_endpoints"), lambda e: _endpoint(e, F.col("_pretty")))),
        ),
    ).otherwise("")
    return {
        "opened": J.as_object(F.col(source)),
        "checked": F.when(F.col("_renderable") & is_convertible(spec), spec),
        "endpoints": F.when(spec.isNotNull(), endpoints(spec)),
        "blobs": _json_blobs(F.col("_endpoints")),
        "markdown": F.when(spec.isNotNull(), text(intro, _models(model_section(spec)), body)),
    }


def with_api_markdown(files: DataFrame, source: str = "content", target: str = "api_markdown") -> DataFrame:
    """Add the Markdown of each document, and ``<target>_ok``; NULL and false
    when it cannot be converted."""
    step = _markdown_steps(source)
    opened = files.withColumn("_renderable", J.renderable(F.col(source)))
    opened = opened.withColumn("_spec", step["opened"]).withColumn("_spec", step["checked"]).drop("_renderable")
    opened = opened.withColumn("_endpoints", step["endpoints"]).withColumn("_blobs", step["blobs"])
    opened = opened.withColumn("_pretty", J.indented(F.when(F.size("_blobs") > 0, F.col("_blobs"))))
    return opened.withColumns(
        {target: step["markdown"], f"{target}_ok": F.col("_spec").isNotNull()}
    ).drop("_spec", "_endpoints", "_blobs", "_pretty")


# --- tables ---------------------------------------------------------------------


def _specs(files: DataFrame) -> DataFrame:
    return files.select(*KEY, J.as_object(F.col("content")).alias("spec"))


def api_specs(files: DataFrame) -> DataFrame:
    """One row per document: title, version, description (NULL when absent)."""
    objects = F.filter(F.array("spec"), lambda s: s.isNotNull())
    rows = one_row_per(_specs(files), [*KEY], objects, "_at", "spec")
    return rows.select(*KEY, info(F.col("spec")).alias("i")).select(
        *KEY,
        J.get(F.col("i"), "title", "Unnamed API").alias("title"),
        J.get(F.col("i"), "version", "Unknown").alias("version"),
        F.col("i")["description"].alias("description"),
    )


def _models_opened(files: DataFrame) -> DataFrame:
    rows = one_row_per(_specs(files), [*KEY], J.entries(model_section(F.col("spec"))), "model_ordinal", "m")
    return rows.select(*KEY, "model_ordinal", F.col("m.key").alias("model"), J.as_object(F.col("m.value")).alias("body"))


def api_models(files: DataFrame) -> DataFrame:
    return _models_opened(files).select(
        *KEY, "model_ordinal", "model", F.col("body")["description"].alias("description")
    )


def api_properties(files: DataFrame) -> DataFrame:
    entries = J.entries(F.col("body")["properties"])
    return (
        one_row_per(_models_opened(files), [*KEY, "model"], entries, "property_ordinal", "p")
        .withColumn("d", J.as_object(F.col("p.value")))
        .select(
            *KEY,
            "model",
            "property_ordinal",
            F.col("p.key").alias("property"),
            property_type(F.col("d")).alias("type"),
            J.get(F.col("d"), "description", "").alias("description"),
        )
    )


def _endpoints_opened(files: DataFrame) -> DataFrame:
    rows = one_row_per(_specs(files), [*KEY], endpoints(F.col("spec")), "endpoint_ordinal", "e")
    return rows.select(
        *KEY,
        "endpoint_ordinal",
        F.upper("e.method").alias("method"),
        F.col("e.path").alias("endpoint"),
        F.col("e.details").alias("d"),
    )


def api_endpoints(files: DataFrame) -> DataFrame:
    return _endpoints_opened(files).select(
        *KEY,
        "endpoint_ordinal",
        "method",
        "endpoint",
        J.get(F.col("d"), "summary", "").alias("summary"),
        J.get(F.col("d"), "description", "").alias("description"),
    )


def api_parameters(files: DataFrame) -> DataFrame:
    p = F.col("p")
    return (
        one_row_per(_endpoints_opened(files), ENDPOINT, parameters(F.col("d")), "parameter_ordinal", "p")
        .select(
            *KEY,
            "method",
            "endpoint",
            "parameter_ordinal",
            J.get(p, "name", "None").alias("name"),
            J.get(p, "in", "unknown").alias("location"),
            parameter_type(p).alias("type"),
            parameter_need(p).alias("need"),
            J.get(p, "description", "").alias("description"),
        )
    )


def api_request_bodies(files: DataFrame) -> DataFrame:
    return (
        one_row_per(_endpoints_opened(files), ENDPOINT, body_contents(F.col("d")), "body_ordinal", "b")
        .withColumn("schema_ref", schema_ref(F.col("b.value")))
        .select(
            *KEY,
            "method",
            "endpoint",
            "body_ordinal",
            F.col("b.key").alias("content_type"),
            "schema_ref",
            F.when(F.col("schema_ref").isNull(), J.as_object(F.col("b.value"))["schema"]).alias("schema_json"),
        )
    )


def api_responses(files: DataFrame) -> DataFrame:
    """One row per (status, content type); a status without content keeps one row."""
    return (
        one_row_per(_endpoints_opened(files), ENDPOINT, J.entries(F.col("d")["responses"]), "response_ordinal", "r")
        .withColumn("body", J.as_object(F.col("r.value")))
        .select(
            *KEY,
            "method",
            "endpoint",
            "response_ordinal",
            F.col("r.key").alias("status"),
            J.get(F.col("body"), "description", "").alias("description"),
            F.explode_outer(J.entries(F.col("body")["content"])).alias("c"),
        )
        .select(
            *KEY,
            "method",
            "endpoint",
            "response_ordinal",
            "status",
            "description",
            F.col("c.key").alias("content_type"),
            schema_ref(F.col("c.value")).alias("schema_ref"),
        )
    )


def api_examples(files: DataFrame) -> DataFrame:
    return (
        one_row_per(_endpoints_opened(files), ENDPOINT, J.entries(F.col("d")["examples"]), "example_ordinal", "x")
        .select(
            *KEY,
            "method",
            "endpoint",
            "example_ordinal",
            F.col("x.key").alias("name"),
            F.when(J.has(J.as_object(F.col("x.value")), "value"), example_blob(F.col("x.value"))).alias("value_json"),
        )
    )
