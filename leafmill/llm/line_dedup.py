"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches of descending ids, so whatever a batch meets in the runs has
a larger holder. A batch's line keys are combined (hash, number of documents, largest id)
and sorted, and this is merged with the sorted runs of all earlier batches. Keys that the
runs hold are hits: every document of the batch that has one is in surplus. The others
are new: they become a run of their own, and of the batch's documents only those below the
largest id are in surplus. Runs lie in levels; when a level holds ``FANOUT`` of them they
are merged into one run of the next level and removed, so there are few runs at any
time and each hash is rewritten once per level. As a key enters the runs once, merging
them only interleaves. Whether enough documents have a key is known at the end: the counts
of hits and new keys are added up, and only keys with enough of them keep their verdicts,
one per batch, which then meet the batch's lines.

A key is the line without blanks at its ends, A-Z lower-cased, at least ``LEAST``
characters long. It travels as 96 bits of its hash (a chance collision of two of 10^12
keys has a probability of about 10^-5). Keys combine in each task before they are
shuffled, so a line of a third of all documents is one row per task, and its lines are
dealt by batch as well. A document's text moves once, by its id and a hash of the text,
to meet the list of its own surplus lines. (Rows of one id and hash may share a list: what
goes depends on line and id alone, so the hash only keeps lists short.)

Defined results: a null or empty text is one empty line. Null ids rank below all
others. Rows are documents: repeated rows count one by one, and those of the largest id
all keep their lines. Extra columns stay; ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import texts as X
from leafmill.session import discard, scratch

#: Shortest key, documents that must share it, batches of a corpus, runs of a level.
LEAST, DOCUMENTS, BATCHES, FANOUT = 20, 3, 6, 3


def _keys(lines: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the lines that have a key, the distinct hashes' two parts, and which each line has."""
    key = pc.ascii_lower(pc.utf8_trim(lines, characters=X.BLANK_CHARACTERS))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(key), least).to_numpy(zero_copy_only=False))
    coded = key.take(pa.array(at)).dictionary_encode()
    wide = [xxhash.xxh3_128_intdigest(k.as_py().encode()) for k in coded.dictionary]
    high = np.array([w >> 64 for w in wide], np.uint64).view(np.int64)
    low = np.array([w & 0xFFFFFFFF for w in wide], np.uint32).view(np.int32)
    return at, high, low, coded.indices.to_numpy(zero_copy_only=False)


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """One row per document and distinct key: ``doc``, ``row`` (a hash of its text), ``h``, ``h2``."""

    def found(batches):
        for batch in batches:
            text = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
            lines = pc.split_pattern(text, "\n")
            at, high, low, code = _keys(lines.flatten(), least)
            if not len(at):
                continue
            parent = pc.list_parent_indices(lines).to_numpy()[at].astype(np.int64)
            own = np.unique(parent * len(high) + code)
            at = pa.array(own // len(high))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(high[own % len(high)]), pa.array(low[own % len(high)])],
                names=["doc", "row", "h", "h2"],
            )

    rows = docs.select(F.col(id_col).cast("long"), text_hash(text_col), text_col)
    return rows.mapInArrow(found, "doc long, row int, h long, h2 int")


def text_hash(text_col: str) -> Column:
    return F.hash(X.whole(F.col(text_col)))


def batch_of(docs: DataFrame, id_col: str, batches: int) -> Column:
    """The batch of a ``doc``: about equal parts of the rows, larger ids first, rows of one id together."""
    shares = [n / batches for n in range(batches - 1, 0, -1)]
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares)).first()[0] if shares else []
    earlier = [F.when(F.col("doc") < cut, 1).otherwise(0) for cut in cuts or []]
    number = sum(earlier, F.lit(0))
    return F.when(F.col("doc").isNull(), batches - 1).otherwise(number).cast("int")


class Runs:
    """The runs, by level, and what each batch found in them, as folders on the shared store."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.batches = spark, fanout, [[]], []

    def _known(self, paths: list[str]) -> DataFrame:
        """The keys of runs; a batch's folder is a run without its hits."""
        rows = self.spark.read.schema("h long, h2 int, seen boolean").parquet(*paths)
        return rows.filter("seen IS NOT TRUE").select("h", "h2")

    def add(self, keys: DataFrame) -> None:
        """Merges a batch's keys with the runs, adds the new ones as a run, then compacts each level that is full."""
        own = keys.groupBy("h", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        paths = [p for level in self.levels for p in level]
        if paths:
            known = self._known(paths).withColumn("seen", F.lit(True))
            own = own.hint("merge").join(known, ["h", "h2"], "left")
            own = own.withColumn("seen", F.coalesce("seen", F.lit(False)))
        else:
            own = own.withColumn("seen", F.lit(False))
        path = scratch(self.spark, "line-run-0")
        own = own.withColumn("batch", F.lit(len(self.batches)))
        own.sortWithinPartitions("h", "h2").write.parquet(path)
        self.batches.append(path)
        self.levels[0].append(path)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            path = scratch(self.spark, f"line-run-{level + 1}")
            self._known(full).repartition("h", "h2").sortWithinPartitions("h", "h2").write.parquet(path)
            self.levels[level + 1].append(path)
            for old in full if level else []:  # a batch's folder also holds its counts, which the end needs
                discard(self.spark, old)
            level += 1

    def repeated(self, documents: int) -> DataFrame:
        """Keys of at least so many documents: ``n``, the largest id ``last``, and ``found``, each batch's verdict."""
        rows = self.spark.read.schema("h long, h2 int, n long, last long, batch int, seen boolean").parquet(*self.batches)
        known = rows.groupBy("h", "h2").agg(
            F.sum("n").alias("n"), F.max("last").alias("last"), F.collect_list(F.struct("batch", "seen", "last")).alias("found")
        )
        return known.filter(F.col("n") >= documents)


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    documents: int = DOCUMENTS,
    batches: int = BATCHES,
) -> DataFrame:
    """The rows with surplus lines taken out of their text, and ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    path = scratch(spark, "line-keys")
    dealt = line_keys(docs, id_col, text_col, least).withColumn("batch", batch_of(docs, id_col, batches))
    dealt.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc long, row int, h long, h2 int, batch int").parquet(path)
    runs = Runs(spark)
    for batch in range(batches):
        runs.add(keys.filter(F.col("batch") == batch))
    verdicts = runs.repeated(documents).select("h", "h2", F.inline("found"))
    # A hit has a larger holder in an earlier batch; of a new key's documents the largest id keeps it.
    surplus = keys.join(verdicts, ["h", "h2", "batch"]).filter("seen OR doc < last OR (doc IS NULL AND last IS NOT NULL)")
    # As many entries as the document has distinct lines, at most.
    lists = surplus.groupBy("doc", "row").agg(F.collect_set(F.struct("h", "h2")).alias("gone"))
    doc, row, gone, made = (X.free_name(docs.columns, n) for n in ("_doc", "_row", "_gone", "_made"))
    lists = lists.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("gone").alias(gone))

    @F.arrow_udf("struct<text string, n_lines bigint, n_dropped bigint>")
    def without(text: pa.Array, gone: pa.Array) -> pa.Array:
        rows = []
        for t, g in zip(text, gone, strict=True):
            value = t.as_py() or ""
            total = value.count("\n") + 1
            if not g.is_valid:
                rows.append({"text": value, "n_lines": total, "n_dropped": 0})
                continue
            lines = value.split("\n")
            at, high, low, code = _keys(pa.array(lines, pa.large_string()), least)
            away = {(r["h"], r["h2"]) for r in g.as_py()}
            drop = np.array([(h, l) in away for h, l in zip(high.tolist(), low.tolist(), strict=True)], bool)
            out = set(at[drop[code]].tolist())
            rows.append({"text": "\n".join(x for i, x in enumerate(lines) if i not in out), "n_lines": total, "n_dropped": len(out)})
        kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
        return pa.array(rows, kind)

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (text_hash(text_col) == F.col(row))
    both = docs.select(*kept).join(lists, own, "left")
    out = both.withColumn(made, without(F.col(text_col), F.col(gone)))
    return out.select(
        *[F.col(f"{made}.text").alias(c) if c == text_col else F.col(c) for c in kept],
        f"{made}.n_lines", f"{made}.n_dropped",
    )
