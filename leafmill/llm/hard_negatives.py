"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

Vectors become integer components, and rows are sorted by dimension, label and their place
on a Hilbert curve through all dimensions, of ``BITS`` bits each.
Runs of up to ``BLOCK_ROWS`` rows become Parquet blocks of one label. A block's zone map holds
the smallest and the largest value of each dimension, in columns of its own, which are read
without the vectors.

Interval arithmetic on a zone map bounds the score (inner product) of an anchor with every row
of the block, rounded outwards. Two searches use it:

1. An anchor's positives, the best rows of its label. Its own block gives a floor that
   ``POSITIVES`` rows reach; only blocks of the label whose upper bound reaches it are read.
2. Per positive a window of scores. Only blocks of other labels whose bounds meet a window of
   the anchor are read, and the best ``NEGATIVES`` rows of each window stay.

Anchors are packed into groups of one label. Group and zone maps meet in buckets of zone maps,
group and chosen blocks in units of some blocks; both stream through sorted partitions, so a
task holds one group, or one bucket's zone maps, and a block. A unit gives out its best rows
only, and the best of units follow by a ranking of slim rows. A label with a third of all rows
is just more blocks and groups.

Defined results: rows with a null label or vector, or with a null or non-finite component,
take no part, nor do rows whose integer components' squares sum to more than ``MOST_SQUARE``
(their products would not be exact). Vectors of different lengths never meet. A null id
ranks behind all ids and is no anchor. Rows that repeat an id are rows of their own: each
can be a positive or a negative, and an anchor that repeats gets its results as often.
Scores that are negative give empty windows. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.session import written

#: What is asked for: integer scale, positives of an anchor, negatives of a window, the window in percent.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Bits of a dimension on the curve, rows and bytes of a block, anchors of a group, zone maps of a bucket, blocks of a unit.
BITS, BLOCK_ROWS, BLOCK_BYTES, GROUP, BUCKET, UNIT = 8, 512, 512 << 10, 512, 256, 64
#: So that products, and sums of them, are exact in doubles, and 100 times a score in longs.
MOST_SQUARE = 1 << 53
HIGHEST, NOTHING = (1 << 63) - 1, -(1 << 62)


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of points with coordinates below ``2 ** bits``, as bytes that sort."""
    x = cells.astype(np.uint32).T.copy()  # a row per dimension
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = np.uint32(bit - 1)
        for i in range(len(x)):
            high = x[i] & bit != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned, bit = np.zeros(x.shape[1], np.uint32), top
    while bit > 1:
        turned ^= np.where(x[-1] & bit != 0, bit - 1, 0).astype(np.uint32)
        bit >>= 1
    x ^= turned
    planes = np.stack([x >> np.uint32(b) & np.uint32(1) for b in range(bits - 1, -1, -1)])  # bits, dimensions, points
    packed = np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def cells(vectors: np.ndarray) -> np.ndarray:
    """Coordinates of ``BITS`` bits a dimension, finest where components of vectors of length one lie."""
    near = vectors / SCALE * np.sqrt(vectors.shape[1])
    return np.floor((1 + near / (1 + np.abs(near))) / 2 * (1 << BITS)).clip(0, (1 << BITS) - 1).astype(np.uint32)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (``id``, ``label``, ``anchor``, ``vector``) with integer vectors and their places on the curve."""

    def found(batches):
        for batch in batches:
            values = batch.column(3)
            sizes = np.diff(values.offsets.to_numpy())
            flat = np.floor(SCALE * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                if not dim:
                    continue
                vectors = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                fits = (vectors**2).sum(1) <= MOST_SQUARE
                own, vectors = own[fits], vectors[fits].astype(np.int32)
                if len(own):
                    kept = batch.take(pa.array(own))
                    raw = pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary())
                    keys = pa.array(hilbert_keys(cells(vectors), BITS), pa.binary())
                    yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(np.full(len(own), dim)), keys, raw], names=names)

    names = ["id", "label", "anchor", "dim", "key", "vector"]
    return rows.mapInArrow(found, "id long, label long, anchor boolean, dim long, key binary, vector binary")


def _runs(batches, most):
    """Rows in order as pieces of one dimension and label, of at most ``most(dim)`` rows."""
    held = None
    for batch in batches:
        rows = batch.to_pandas()
        held = rows if held is None else pd.concat([held, rows], ignore_index=True)
        kind = held[["dim", "label"]]
        cuts = [0, *(np.flatnonzero((kind != kind.shift()).any(axis=1).to_numpy()[1:]) + 1).tolist(), len(held)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            size, last = most(int(held["dim"].iloc[a])) if b > a else 1, b == len(held)
            while b - a >= size or (a < b and not last):
                yield held.iloc[a : min(b, a + size)]
                a = min(b, a + size)
            if last:
                held = held.iloc[a:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i4").reshape(-1, dim)


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest scores of each row with their ids, of equal ones the first; changes ``scores``."""
    out, names, rows = [], [], np.arange(len(scores))
    for _ in range(count):
        at = scores.argmax(1)
        out.append(scores[rows, at])
        names.append(ids[at])
        scores[rows, at] = NOTHING
    return np.stack(out, 1), np.stack(names, 1)


def blocks(rows: DataFrame) -> DataFrame:
    """One written row per block (``vectors`` not null) and per anchor (``vectors`` null).

    Blocks: ``block``, ``dim``, ``label``, ``ids``, ``vectors``, ``low``, ``high``. Anchors: ``block`` is their own,
    ``place`` their row in it, ``floor`` a score that enough rows of their label reach.
    """

    def most(dim: int) -> int:
        return max(16, min(BLOCK_ROWS, BLOCK_BYTES // (4 * dim)))

    def packed(batches):
        number = TaskContext.get().partitionId() << 32
        for run in _runs(batches, most):
            dim, label = int(run["dim"].iloc[0]), int(run["label"].iloc[0])
            run = run.sort_values("id", kind="stable")
            ids = run["id"].to_numpy(np.int64)
            vectors = _matrix(run["vector"], dim)
            row = {n: None for n in names} | {"block": number, "dim": dim, "label": label}
            out = [row | {"ids": ids.astype("<i8").tobytes(), "vectors": vectors.tobytes(), "low": vectors.min(0).tobytes(), "high": vectors.max(0).tobytes()}]
            anchors = np.flatnonzero(run["anchor"].to_numpy())
            if len(anchors):
                scores = vectors[anchors].astype(np.float64) @ vectors.T.astype(np.float64)
                scores[np.arange(len(anchors)), anchors] = NOTHING
                enough = len(ids) > POSITIVES
                floors = np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES] if enough else np.full(len(anchors), float(NOTHING))
                for n, floor in zip(anchors.tolist(), floors.tolist(), strict=True):
                    own = run.iloc[n]
                    out.append(row | {"place": n, "id": int(ids[n]), "key": own["key"], "vector": own["vector"], "floor": int(floor)})
            yield pa.RecordBatch.from_pylist(out, schema=kind)
            number += 1

    types = {"ids": pa.binary(), "vectors": pa.binary(), "low": pa.binary(), "high": pa.binary(), "key": pa.binary(), "vector": pa.binary()}
    names = ["block", "dim", "label", "ids", "vectors", "low", "high", "place", "id", "key", "vector", "floor"]
    kind = pa.schema([(n, types.get(n, pa.int64())) for n in names])
    order = ["dim", "label", "key", "id"]
    parts = max(1, -(-rows.count() // (8 * BLOCK_ROWS)))
    dealt = rows.repartitionByRange(min(parts, 100_000), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{n} {'binary' if n in types else 'long'}" for n in names)
    return written(dealt.mapInArrow(packed, schema), "negatives-blocks")


def groups(anchors: DataFrame) -> DataFrame:
    """Anchors packed along the curve: ``grp``, ``dim``, ``label``, ``ids``, ``own`` (block and place), ``vectors``, ``floors``."""

    def packed(batches):
        number = TaskContext.get().partitionId() << 32
        for run in _runs(batches, lambda dim: GROUP):
            numbers = [run[c].to_numpy(np.int64).astype("<i8") for c in ("id", "block", "place", "floor")]
            yield pa.RecordBatch.from_pylist(
                [{
                    "grp": number, "dim": int(run["dim"].iloc[0]), "label": int(run["label"].iloc[0]), "ids": numbers[0].tobytes(),
                    "own": np.stack(numbers[1:3], 1).tobytes(), "vectors": b"".join(run["vector"]), "floors": numbers[3].tobytes(),
                }]
            )
            number += 1

    order = ["dim", "label", "key", "id"]
    parts = max(1, -(-anchors.count() // (4 * GROUP)))
    dealt = anchors.repartitionByRange(parts, *order, "block", "place").sortWithinPartitions(*order, "block", "place")
    schema = "grp long, dim long, label long, ids binary, own binary, vectors binary, floors binary"
    return written(dealt.mapInArrow(packed, schema), "negatives-groups")


def bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that rows of each block can have with each vector, rounded outwards."""
    plus, minus = np.maximum(vectors, 0).astype(np.float64), np.minimum(vectors, 0).astype(np.float64)
    low, high = low.T.astype(np.float64), high.T.astype(np.float64)
    slack = 1e-12 * (np.abs(vectors).astype(np.float64) @ np.maximum(np.abs(low), np.abs(high)))
    return plus @ low + minus @ high - slack, plus @ high + minus @ low + slack


def _windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest negative score for positive scores; empty for ``NOTHING`` and for negative ones."""
    known = scores > NOTHING
    safe = np.where(known, scores, -1)
    low = -(-LOW * safe // 100)
    return np.where(known, low, 1), np.where(known, HIGH * safe // 100, 0)


def reads(packs: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """Which blocks each group's anchors must read: ``grp``, ``block``, ``mask`` (a bit an anchor)."""
    buckets = max(1, -(-zones.count() // BUCKET))
    near = zones.select("dim", F.pmod(F.xxhash64("block"), F.lit(buckets)).alias("bucket"), F.lit(None).cast("long").alias("grp"),
                        "block", "label", "low", "high", *[F.lit(None).cast("binary").alias(c) for c in ("vectors", "limits")])
    far = packs.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), "grp",
                       F.lit(None).cast("long").alias("block"), "label", *[F.lit(None).cast("binary").alias(c) for c in ("low", "high")],
                       "vectors", "limits")

    def found(batches):
        key, numbers, labels, low, high = None, [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["dim"], row["bucket"]) != key:
                    key, numbers, labels, low, high = (row["dim"], row["bucket"]), [], [], [], []
                if row["grp"] is None:
                    numbers.append(row["block"])
                    labels.append(row["label"])
                    low.append(row["low"])
                    high.append(row["high"])
                    continue
                at = np.flatnonzero((np.array(labels, np.int64) == row["label"]) == same)
                if not len(at):
                    continue
                vectors, dim = _matrix([row["vectors"]], row["dim"]), row["dim"]
                least, most = bounds(vectors, _matrix([low[i] for i in at], dim), _matrix([high[i] for i in at], dim))
                limits = np.frombuffer(row["limits"], "<i8").reshape(len(vectors), -1)
                if same:
                    wanted = most >= limits
                else:
                    lows, highs = _windows(limits)
                    wanted = np.zeros(most.shape, bool)
                    for w in range(limits.shape[1]):
                        wanted |= (most >= lows[:, w : w + 1]) & (least <= highs[:, w : w + 1]) & (lows <= highs)[:, w : w + 1]
                masks = np.packbits(wanted, axis=0).T
                chosen = np.flatnonzero(wanted.any(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * len(chosen), pa.int64()), pa.array([numbers[at[i]] for i in chosen], pa.int64()),
                     pa.array([masks[i].tobytes() for i in chosen], pa.binary())],
                    names=["grp", "block", "mask"],
                )

    dealt = near.unionByName(far).repartition("dim", "bucket").sortWithinPartitions("dim", "bucket", F.asc_nulls_first("grp"))
    return dealt.mapInArrow(found, "grp long, block long, mask binary")


def searched(packs: DataFrame, pairs: DataFrame, store: DataFrame, same: bool) -> DataFrame:
    """The best rows of the blocks read, unit by unit: ``grp``, ``anchor`` (its place), ``anchor_id``, ``window``, ``score``, ``id``, ``rank``."""
    none = {"block": "long", "mask": "binary", "names": "binary", "rows": "binary"}
    own = {"dim": "long", "ids": "binary", "own": "binary", "vectors": "binary", "limits": "binary"}
    units = pairs.groupBy("grp").agg(F.ceil(F.count("*") / UNIT).cast("long").alias("units"))
    dealt = pairs.join(units, "grp").withColumn("unit", F.pmod(F.xxhash64("block"), F.col("units")))
    members = dealt.join(store.select("block", F.col("ids").alias("names"), F.col("vectors").alias("rows")), "block")
    members = members.select("grp", "unit", *none, *[F.lit(None).cast(t).alias(n) for n, t in own.items()])
    heads = packs.join(units, "grp").withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    heads = heads.select("grp", "unit", *[F.lit(None).cast(t).alias(n) for n, t in none.items()], *own)

    def found(batches):
        key, state = None, None

        def best():
            scores, ids, known = state["scores"], state["ids"], state["scores"] > NOTHING
            anchor, window, rank = np.nonzero(known)
            columns = (np.full(len(anchor), key[0]), anchor, state["names"][anchor], window, scores[anchor, window, rank], ids[anchor, window, rank])
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["grp"], row["unit"]) != key:
                    if state is not None:
                        yield best()
                    key, state = (row["grp"], row["unit"]), None
                if row["block"] is None:
                    vectors = _matrix([row["vectors"]], row["dim"]).astype(np.float64)
                    limits = np.frombuffer(row["limits"], "<i8").reshape(len(vectors), -1)
                    shape = (len(vectors), 1, POSITIVES) if same else (len(vectors), limits.shape[1], NEGATIVES)
                    state = {"names": np.frombuffer(row["ids"], "<i8"), "vectors": vectors, "limits": _windows(limits), "own": np.frombuffer(row["own"], "<i8").reshape(-1, 2),
                             "scores": np.full(shape, NOTHING), "ids": np.full(shape, HIGHEST), "dim": row["dim"]}
                    continue
                at = np.flatnonzero(np.unpackbits(np.frombuffer(row["mask"], np.uint8))[: len(state["vectors"])])
                names_ = np.frombuffer(row["names"], "<i8")
                scores = (state["vectors"][at] @ _matrix([row["rows"]], state["dim"]).T.astype(np.float64)).astype(np.int64)
                if same:
                    home = np.flatnonzero(state["own"][at, 0] == row["block"])
                    scores[home, state["own"][at[home], 1]] = NOTHING
                for w in range(state["scores"].shape[1]):
                    low, high = (limit[at, w : w + 1] for limit in state["limits"])
                    inside = scores.copy() if same else np.where((scores >= low) & (scores <= high), scores, NOTHING)
                    more, ids = _best(inside, names_, state["scores"].shape[2])
                    more = np.concatenate((state["scores"][at, w], more), 1)
                    ids = np.concatenate((state["ids"][at, w], ids), 1)
                    order = np.lexsort((ids, -more), axis=-1)[:, : state["scores"].shape[2]]
                    state["scores"][at, w] = np.take_along_axis(more, order, 1)
                    state["ids"][at, w] = np.take_along_axis(ids, order, 1)
        if state is not None:
            yield best()

    names = ["grp", "anchor", "anchor_id", "window", "score", "id"]
    both = members.unionByName(heads).repartition("grp", "unit").sortWithinPartitions("grp", "unit", F.asc_nulls_first("block"))
    rows = both.mapInArrow(found, ", ".join(f"{n} long" for n in names))
    order = W.partitionBy("grp", "anchor", "window").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (POSITIVES if same else NEGATIVES))


def mined(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor and positive the negatives of its window: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores."""
    vector = F.col(vector_col).cast("array<double>")
    usable = rows.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(HIGHEST)).alias("id"), F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("vector"),
    )
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    made = blocks(written(placed(usable.filter(finite)), "negatives-rows"))
    store = made.filter("vectors IS NOT NULL")
    packs = groups(made.filter("place IS NOT NULL").select("block", "dim", "label", "place", "id", "key", "vector", "floor"))
    first = packs.withColumn("limits", F.col("floors"))
    zones = store.select("block", "dim", "label", "low", "high")
    best = written(searched(first, written(reads(first, zones, True), "negatives-reads"), store, True), "negatives-positives")

    @F.arrow_udf("binary")
    def limits(found: pa.Array, ids: pa.Array) -> pa.Array:
        out = []
        for own, size in zip(found.to_pylist(), pc.binary_length(ids).to_pylist(), strict=True):
            table = np.full((size // 8, POSITIVES), NOTHING, "<i8")
            for x in own:
                table[x["anchor"], x["rank"] - 1] = x["score"]
            out.append(table.tobytes())
        return pa.array(out, pa.binary())

    # At most GROUP times POSITIVES entries a group.
    lists = best.groupBy("grp").agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("found"))
    second = written(packs.join(lists, "grp").withColumn("limits", limits("found", "ids")).drop("found"), "negatives-windows")
    worst = searched(second, written(reads(second, zones, False), "negatives-reads"), store, False)
    positives = best.select(
        "grp", "anchor", (F.col("rank") - 1).cast("long").alias("window"), "anchor_id", _id("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    negatives = worst.select("grp", "anchor", "window", F.col("rank").cast("int").alias("rank"), _id("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["grp", "anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _id(column: str) -> Column:
    return F.when(F.col(column) != HIGHEST, F.col(column))

