"""Importance resampling towards a target distribution, with features from an automaton's payloads.

A feature is a run of 1 to ``longest`` words, its bucket the CRC-32 of its bytes (words
joined by one space) modulo ``BUCKETS``. A word is a run of bytes between delimiters. The
frequent words form an Aho-Corasick dictionary, each bounded by a delimiter on both sides
and carrying a payload: its CRC and its length. A scan of a portion of text emits the
payloads of its words; the CRC of a longer run is composed from those of adjacent words,
as a CRC is linear over the bits, without looking at the text again. Words outside the
dictionary get their payload from their bytes, so the dictionary only saves work: which
words are in it, at most ``MOST_WORDS``, never changes a result.

1. Words of all texts are counted, and the dictionary is cut at a count that its bound
   allows, found from a histogram of the counts.
2. The automaton passes over source and target once. Buckets of each document are written;
   buckets are summed per task, then per bucket.
3. A bucket's gain compares its smoothed shares of target and source; a document's weight
   is the mean gain of its features. A Gumbel number made from the document's id is added,
   so that the best scores are a draw without replacement, in proportion to the weights.
4. Slim rows of the documents that may be drawn are sorted in ranges; a row's rank is its
   place in its range behind the counts of the ranges before. Nothing is sorted in one task.

Defined results: a null or empty text, or one without words, has no feature and weight 0.
A null id counts as the empty text in the Gumbel number and ranks behind all ids. Rows that
repeat an id are documents of their own, ties of score and id rank in any order of equal
results. An empty target or source gives smoothed shares. Extra columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import texts as X
from leafmill.session import written

#: Hash buckets, scale of gains and scores, seed of the draw, words a drawn document has, share drawn.
BUCKETS, SCALE, SEED, LEAST_WORDS, PERCENT = 10_000, 1000, 2024, 20, 10
#: Words in the dictionary (and their bytes) at most, sightings that make a word worth a place, bytes scanned at once.
MOST_WORDS, MOST_BYTES, SEEN, PORTION = 1 << 17, 4 << 20, 8, 2 << 20
#: Rows of a range when documents are ranked.
RANGE_ROWS = 1 << 20
DELIMITER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Bytes as words see them: A-Z lower-cased, every delimiter a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shift_tables(most: int) -> list[np.ndarray]:
    """Per power of two up to ``most`` bytes, the images of 32 bits when so many zero bytes follow."""
    one = np.empty(32, np.uint64)
    for bit in range(32):
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        one[bit] = value
    tables = [one]
    while 1 << len(tables) <= most:
        tables.append(_applied(tables[-1], tables[-1]))
    return tables


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crc), np.uint64)
    for bit in range(32):
        out ^= (crc >> np.uint64(bit) & np.uint64(1)) * table[bit]
    return out


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of texts put together from those of two parts; ``size`` is the right part's length."""
    out = left.copy()
    for power, table in enumerate(shift_tables(int(size.max(initial=0)))):
        at = np.flatnonzero(size >> power & 1)
        out[at] = _applied(table, out[at])
    return out ^ right


class Dictionary:
    """The automaton over the latin-1 view of folded bytes, and the payloads of its words."""

    def __init__(self, words: list[bytes]):
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint64)
        self.size = np.array([len(w) for w in words], np.int64)
        self.automaton = ahocorasick.Automaton()
        for n, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", n)
        if words:
            self.automaton.make_automaton()

    def payloads(self, folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, CRC and length of each word; the folded bytes begin and end with a space."""
        is_word = np.frombuffer(folded, np.uint8) != 32
        begins = np.flatnonzero(is_word[1:] & ~is_word[:-1]) + 1
        crc, size = np.zeros(len(begins), np.uint64), np.zeros(len(begins), np.int64)
        if len(self.crc) and len(begins):
            found = itertools.chain.from_iterable(self.automaton.iter(folded.decode("latin-1")))
            hits = np.fromiter(found, np.int64).reshape(-1, 2)
            own = hits[:, 1]
            at = np.searchsorted(begins, hits[:, 0] - self.size[own])
            crc[at], size[at] = self.crc[own], self.size[own]
        rest = np.flatnonzero(size == 0)
        if len(rest):
            stops = np.flatnonzero(~is_word[1:] & is_word[:-1])[rest] + 1
            words = [folded[a:b] for a, b in zip(begins[rest].tolist(), stops.tolist(), strict=True)]
            crc[rest] = [zlib.crc32(w) for w in words]
            size[rest] = stops - begins[rest]
        return begins, crc, size


@functools.lru_cache(maxsize=1)
def dictionary(words: tuple[bytes, ...]) -> Dictionary:
    """Built once per worker."""
    return Dictionary(list(words))


def features(payloads, ends: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per run length the features' buckets and documents; ``ends`` are where documents end."""
    begins, crc, size = payloads
    whose = np.searchsorted(ends, begins, "right")
    out = [((crc % np.uint64(BUCKETS)).astype(np.int64), whose)]
    run, tail = crc, size
    for n in range(1, longest):
        if len(crc) <= n:
            break
        # A run and the word behind it: a space, then that word's payload.
        space = joined(run[: len(crc) - n], np.full(len(crc) - n, zlib.crc32(b" "), np.uint64), np.ones(len(crc) - n, np.int64))
        run = joined(space, crc[n:], tail[n:])
        inside = whose[: len(crc) - n] == whose[n:]
        out.append(((run[inside] % np.uint64(BUCKETS)).astype(np.int64), whose[n:][inside]))
    return out


def frequent_words(*tables: DataFrame) -> tuple[bytes, ...]:
    """The words of all texts seen most often, within the dictionary's bounds."""
    folded = [F.split(X.ascii_lower(X.whole(F.col("text"))), DELIMITER + "+") for _ in tables]
    words = None
    for table, column in zip(tables, folded, strict=True):
        own = table.select(F.explode(column).alias("word"))
        words = own if words is None else words.unionByName(own)
    counted = written(words.filter("word <> ''").groupBy("word").count().filter(F.col("count") >= SEEN), "importance-words")
    level = F.floor(F.log2("count") * 8).cast("int")
    held = counted.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes"))
    least, n, size = None, 0, 0
    for row in sorted(held.collect(), key=lambda r: -r.level):  # at most 8 rows a doubling of the count
        n, size = n + row.n, size + row.bytes
        if n > MOST_WORDS or size > MOST_BYTES:
            break
        least = row.level
    if least is None:
        return ()
    return tuple(sorted(r.word.encode() for r in counted.filter(level >= least).select("word").toLocalIterator()))


def scanned(docs: DataFrame, words, longest: int) -> DataFrame:
    """Per row of (``doc``, ``text``): ``doc``, ``n_words``, ``n_features``, ``buckets`` (32-bit numbers), ``counts`` null;
    and per task a row of the ``counts`` of all buckets."""

    def found(batches):
        known, total = dictionary(words.value), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PORTION
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                raw = [(t or b"").translate(_FOLD) for t in texts[a:b].cast(pa.binary()).to_pylist()]
                ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64) + 1
                runs = features(known.payloads(b" " + b" ".join(raw) + b" "), ends, longest)
                n = b - a
                n_words = np.bincount(runs[0][1], minlength=n)
                bucket, whose = (np.concatenate(c) for c in zip(*runs, strict=True))
                total += np.bincount(bucket, minlength=BUCKETS)
                bucket = bucket[np.argsort(whose, kind="stable")].astype("<u4")
                n_features = np.bincount(whose, minlength=n)
                offsets = np.concatenate(([0], np.cumsum(n_features))) * 4
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(bucket)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array(n_words), pa.array(n_features), packed, pa.nulls(n, pa.binary())], names=names
                )
        own = [pa.array([None], pa.int64())] * 3 + [pa.array([None], pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(own, names=names)

    names = ["doc", "n_words", "n_features", "buckets", "counts"]
    return docs.mapInArrow(found, "doc long, n_words long, n_features long, buckets binary, counts binary")


def totals(scans: DataFrame) -> np.ndarray:
    """Sightings of each bucket: tasks' vectors are summed in tasks, so the driver gets few."""

    def summed(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for own in batch.column(0).drop_null().to_pylist():
                total += np.frombuffer(own, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])

    parts = scans.filter("counts IS NOT NULL").select("counts").mapInArrow(summed, "counts binary")
    parts = parts.repartition(16).mapInArrow(summed, "counts binary").collect()
    return sum((np.frombuffer(r.counts, "<i8") for r in parts), np.zeros(BUCKETS, np.int64))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the log of target's smoothed share over the source's, scaled and floored."""
    all_s, all_t = int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    shares = ((t + 1.0) * (all_s + BUCKETS) / ((s + 1.0) * (all_t + BUCKETS)) for s, t in pairs)
    return np.array([math.floor(SCALE * math.log(x)) for x in shares], np.int64)


def weighted(scans: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain."""

    @F.arrow_udf("long")
    def weight(buckets: pa.Array) -> pa.Array:
        out = []
        for own in buckets.to_pylist():
            total = int(gain[np.frombuffer(own, "<u4")].sum())
            out.append(total // (len(own) // 4) if own else 0)
        return pa.array(out, pa.int64())

    docs = scans.filter("counts IS NULL")
    return docs.select("doc", "n_words", "n_features", weight("buckets").alias("weight"))


def gumbel(id_col: str):
    """The scaled Gumbel number of an id: from 32 bits of its salted digest."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list, label: str) -> DataFrame:
    """Adds ``rank``, from 1, in the order given, by sorted ranges and the counts of those before."""
    count = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number of a range in the high bits, a row's place in it in the low 33.
    placed = written(dealt.withColumn("_place", F.monotonically_increasing_id()), label)
    own = F.shiftright("_place", 33)
    sizes = {r.p: r.n for r in placed.groupBy(own.alias("p")).agg(F.count("*").alias("n")).collect()}  # a number a range
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    ahead = rows.sparkSession.createDataFrame(list(before.items()), "_range long, _ahead long")
    both = placed.withColumn("_range", own).join(F.broadcast(ahead), "_range")  # as many rows as ranges
    rank = F.col("_ahead") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return both.withColumn("rank", rank).drop("_range", "_ahead", "_place")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1
) -> DataFrame:
    """Per document its id, ``n_features``, ``weight``, ``score``, and ``rank`` if it is drawn."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("doc"), F.col(target_col).alias("text"))
    words = spark.sparkContext.broadcast(frequent_words(source.select("text"), wanted.select("text")))  # bounded by MOST_WORDS
    scans = written(scanned(source, words, longest), "importance-scans")
    gain = gains(totals(scans), totals(scanned(wanted, words, longest)))
    rows = weighted(scans, gain).withColumn("score", F.col("weight") + gumbel("doc"))
    # A row's number keeps a hot id, or null ids, from being one range.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    able = rows.filter(F.col("n_words") >= LEAST_WORDS)
    first = ranked(able, [F.desc("score"), F.asc_nulls_last("doc"), F.col("n_features"), F.col("row")], "importance-ranks")
    drawn = first.agg(F.floor(F.count("*") * PERCENT / 100)).first()[0]
    out = first.withColumn("rank", F.when(F.col("rank") <= F.lit(drawn), F.col("rank")))
    out = out.unionByName(rows.filter(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc").alias(id_col), "n_features", "weight", "score", "rank")
