"""Exact duplicates through content-defined chunk recipes, in DataFrame operations only.

A normalised text is cut where its own content says so, so that equal texts, and
equal long parts of different texts, have equal chunks. Each distinct chunk gets an
identifier that is verified: the identifier is a 64-bit hash plus a number that tells
apart different chunks of one hash. Texts are equal exactly when their ordered
identifier lists (recipes) are. Only distinct chunks are shuffled, once and combined
before the shuffle; afterwards a document travels as its recipe, some eight bytes per
few hundred characters.

Defined results: null and empty texts are equal (the empty recipe). Of equal texts the
smallest doc_id stays, and null ids rank after all others; rows that repeat both id and
text are one row many times, so each of them has ``kept`` true (``distinct_documents``
returns one of them). Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm import texts as X
from leafmill.session import written

#: A chunk has at least so many characters, then ends with the first mark, or at the most.
LEAST, MOST = 256, 4096
#: Ends of chunks: a space after a full stop, or after a word that ends so.
MARK = "(?:[.!?。] |[dns] )"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The ordered chunks; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 2}}}?{MARK}|.{{1,{most}}}"), F.lit(0))


#: Hashes shared by different chunks that the driver will list; chance gives about one in 10^10 chunks.
MOST_DOUBTFUL = 100_000


def doubtful_hashes(parts: DataFrame, chunk_hash: Callable[[Column], Column]) -> list[int]:
    """Hashes that stand for more than one chunk of ``_parts``.

    Equal chunks are combined in each task before they are sent, so a chunk of many
    copies costs one row per task.
    """
    found = parts.select(F.explode(F.array_distinct("_parts")).alias("chunk"))
    distinct = found.select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    rows = distinct.groupBy("h").count().filter("count > 1").select("h").take(MOST_DOUBTFUL + 1)
    if len(rows) > MOST_DOUBTFUL:
        raise ValueError("the chunk hash is too weak for this corpus")
    return [r.h for r in rows]


def with_recipe(
    docs: DataFrame, text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """Adds ``normal`` (the normalised text), ``recipe`` and ``exceptions``.

    ``recipe`` lists the chunks' hashes in order. A hash that verification found to stand
    for one chunk only is an identifier as it is; ``exceptions`` lists, in order, the
    chunks whose hash stands for several, so that equal pairs mean equal texts.
    """
    parts = docs.withColumn("normal", X.one_space(X.whole(F.col(text_col)))).withColumn(
        "_parts", chunks(F.col("normal"))
    )
    doubtful = doubtful_hashes(parts, chunk_hash)
    exceptions = (
        F.filter("_parts", lambda c: F.array_contains(F.lit(doubtful), chunk_hash(c)))
        if doubtful
        else F.array().cast("array<string>")
    )
    return parts.withColumns(
        {"recipe": F.transform("_parts", lambda c: chunk_hash(c)), "exceptions": exceptions}
    ).drop("_parts")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id, ``text_sha256`` of the normalised text, ``keep_id``, ``group_size``, ``kept``.

    Groups are counted in each task before rows meet; the way back is an equi-join of
    slim rows, whose hot recipes adaptive execution splits.
    """
    slim = with_recipe(docs.select(id_col, text_col), text_col, **how).select(
        F.col(id_col), "recipe", "exceptions", F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256")
    )
    slim = written(slim, "recipes")
    groups = slim.groupBy("recipe", "exceptions").agg(
        F.min(id_col).alias("keep_id"), F.count("*").alias("group_size")
    )
    both = slim.join(groups, ["recipe", "exceptions"])
    return both.select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; texts move once, by id."""
    own, again = X.free_name(docs.columns, "_sha"), X.free_name(docs.columns, "_nth")
    kept = classify(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_keep"), F.col("text_sha256").alias("_keep_sha")).distinct()
    marked = docs.withColumn(own, F.sha2(X.one_space(X.whole(F.col(text_col))).cast("binary"), 256))
    stay = marked.join(kept, F.col(id_col).eqNullSafe(F.col("_keep")) & (F.col(own) == F.col("_keep_sha")), "left_semi")
    nth = F.row_number().over(W.partitionBy(id_col, own).orderBy(text_col))
    return stay.withColumn(again, nth).filter(F.col(again) == 1).drop(own, again)
