"""Repeated byte windows by a depth-limited radix sort of suffixes.

A window is the first ``WINDOW`` bytes of a suffix: suffixes are ordered only so deep, and
suffixes equal to that depth are exactly the repeated windows. The sort goes from the most
significant digit to the least, and only groups of two or more go on to the next digit:

1. The first digit of a window is its smallest ``DIGIT``-byte substring by hash, the
   leftmost of ties. It follows from the window's own bytes, so equal windows agree on it
   and on its place, and neighbouring windows share it: one row stands for the run of
   windows (some thirty) that have the same substring. Sorting rows by it drops all runs
   whose first digit nothing shares.
2. The second digit is the run's whole span of bytes. Of runs equal in both digits the
   earliest stays and the others are repeated whole.
3. Where runs share the first digit but not the span, their windows are sorted one by one
   by the last digit, the window's bytes.

Digits are sorted as 64-bit hashes; a decision always rests on two digits together, 128
bits. Within a group order is (document id, start), so the first is the earliest. Sorted
rows stream through the tasks, which hold one group key, never a group.

A byte is removed if a window that covers it is not the first of its group; windows are
judged on the input. Results list, per document, its repeated runs, and the text moves to
meet that list.

Defined results: a null text is empty, texts shorter than the window lose nothing. A null
id ranks below all others. Rows that repeat id and text are one document several times
and get equal results; rows that share an id only rank by a hash of their text, and are
told apart by 128 bits of it (where no id repeats, the hashes are left out). Extra
columns stay; ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` are replaced.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import texts as X
from leafmill.session import written

#: Bytes of a window and of its first digit; window starts that a task handles at once.
WINDOW, DIGIT, AT_ONCE = 100, 40, 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
LOWEST = -(1 << 63)
ROW = ["doc", "sub", "sub2"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _doubled(raw: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 1, 2, 4 ... ``most`` bytes, by length."""
    h = _mixed((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR))
    out, size = {1: h}, 1
    while size < most and len(h) > size:
        h = _mixed(h[:-size] * np.uint64(pow(_FACTOR, 2 * size + 1, 1 << 64)) + h[size:])
        size *= 2
        out[size] = h
    return out


def _hashes(z: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` bytes, put together from those of powers of two."""
    parts, at = [p for p in sorted(z, reverse=True) if p & size], 0
    count = len(z[1]) - size + 1
    out = np.zeros(count, np.uint64)
    for p in parts:
        out = _mixed(out * np.uint64(_FACTOR) + z[p][at : at + count])
        at += p
    return out


def earlier(keys: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
    """Rows for which a row of the same keys has a smaller place; rows of one place do not count."""
    order = np.lexsort([*place[::-1], *keys[::-1]])
    same = np.ones(len(order), bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    other = np.zeros(len(order), bool)
    for p in place:
        other |= p[order] != p[order][first]
    out = np.zeros(len(order), bool)
    out[order] = same & other
    return out


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= width:
        out = least(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def first_digits(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First digits of the windows at ``starts``, as runs: the digit, the first and the last start."""
    width = WINDOW - DIGIT + 1
    h = _hashes(_doubled(raw, 1 << (DIGIT.bit_length() - 1)), DIGIT)
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    anchors = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == h)
    own = np.searchsorted(anchors, starts)
    todo = np.arange(len(starts))
    while len(todo):  # the window's leftmost anchor that has its smallest hash
        todo = todo[h[anchors[own[todo]]] != least[starts[todo]]]
        own[todo] += 1
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (np.diff(starts) != 1))))
    last = np.append(new[1:], len(starts)) - 1
    return h[anchors[own[new]]], starts[new], starts[last]


def _pieces(texts: list[bytes]):
    """The windows in portions: bytes, window starts in them, document of each, start in the document."""
    raw, starts, whose, shift, size = [], [], [], [], 0
    for n, text in enumerate(texts):
        for begin in range(0, len(text) - WINDOW + 1, AT_ONCE):
            part = text[begin : begin + AT_ONCE + WINDOW - 1]
            if raw and size + len(part) > AT_ONCE + WINDOW:
                yield b"".join(raw), np.concatenate(starts), np.concatenate(whose), np.concatenate(shift)
                raw, starts, whose, shift, size = [], [], [], [], 0
            count = len(part) - WINDOW + 1
            starts.append(np.arange(size, size + count))
            whose.append(np.full(count, n))
            shift.append(np.full(count, begin - size))
            raw.append(part)
            size += len(part)
    if raw:
        yield b"".join(raw), np.concatenate(starts), np.concatenate(whose), np.concatenate(shift)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


def identity(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What names a row: its id and, if any id is null or repeats, two hashes of its text."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    unsure = docs.select(doc.alias("doc")).groupBy("doc").count().filter((F.col("count") > 1) | (F.col("doc") == LOWEST))
    if unsure.isEmpty():
        return [doc, F.lit(0).cast("long"), F.lit(0).cast("long")]
    text = X.whole(F.col(text_col))
    return [doc, F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def keyed(docs: DataFrame, own: list[Column], text_col: str) -> DataFrame:
    """``doc``, ``sub`` and ``sub2`` name a document, ``raw`` has its bytes."""
    return docs.select(*[c.alias(n) for c, n in zip(own, ROW, strict=True)], X.whole(F.col(text_col)).cast("binary").alias("raw"))


def runs(keyed_docs: DataFrame) -> DataFrame:
    """One row per run of windows with one first digit: ``digit``, ``span``, the row, ``run``.

    ``run`` is the first start, times 128, plus the number of starts that follow. Runs
    that a batch already shows to repeat an earlier one of it are settled: they get
    ``-1 - run`` and need not meet their group, so a group of copies sends one row a batch.
    """

    def found(batches):
        for batch in batches:
            texts, parts = batch.column(3).to_pylist(), []
            for raw, starts, whose, shift in _pieces(texts):
                digit, first, last = first_digits(np.frombuffer(raw, np.uint8), starts)
                at = np.searchsorted(starts, first)
                spans = [xxhash.xxh3_64_intdigest(raw[a : b + WINDOW]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                parts.append((digit, np.array(spans, np.uint64), whose[at], (first + shift[at]) * 128 + (last - first)))
            if not parts:
                continue
            digit, span, own, run = (np.concatenate(c) for c in zip(*parts, strict=True))
            row = [batch.column(i).to_numpy()[own] for i in range(3)]
            run = np.where(earlier([digit, span], [*row, run]), -1 - run, run)
            yield pa.RecordBatch.from_arrays([signed(digit), signed(span), *[pa.array(c) for c in (*row, run)]], names=names)

    names = ["digit", "span", *ROW, "run"]
    return keyed_docs.mapInArrow(found, "digit long, span long, doc long, sub long, sub2 long, run long")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy() for c in batch.columns]


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Runs that are repeated whole (``again`` true) and runs whose windows need the last digit."""
    order = ["digit", "span", *ROW, "run"]

    def split(batches):
        held = None  # the last row of the batch before: its digit, span and place
        pending = None  # the first run of a group of one span so far: it is in question once another span comes
        for batch in batches:
            digit, span, doc, sub, sub2, run = _columns(batch)
            settled = run < 0
            if settled.any():
                out = np.flatnonzero(settled)
                columns = (doc[out], sub[out], sub2[out], -1 - run[out], digit[out], np.ones(len(out), bool))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                digit, span, doc, sub, sub2, run = (c[~settled] for c in (digit, span, doc, sub, sub2, run))
            if not len(digit):
                continue
            before = held or (~int(digit[0]), 0, 0, 0, 0, 0)
            prior = [np.concatenate((np.array([b], c.dtype), c[:-1])) for b, c in zip(before, (digit, span, doc, sub, sub2, run), strict=True)]
            same_digit = digit == prior[0]
            same_span = same_digit & (span == prior[1])
            twice = same_span & (doc == prior[2]) & (sub == prior[3]) & (sub2 == prior[4]) & (run == prior[5])  # a repeated row, not a repeated text
            again = same_span & ~twice
            new_span = same_digit & ~same_span
            # A span's first run is in question if its digit has another span, before or after it.
            first_of_digit = np.flatnonzero(~same_digit)
            group = np.cumsum(~same_digit)
            several = np.bincount(group[new_span], minlength=group[-1] + 1) > 0
            asked = new_span | (~same_digit & several[group])
            if pending is not None and same_digit[0] and several[0]:
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in pending] + [pa.array([False])], names=names)
                pending = None
            if len(first_of_digit):
                at = first_of_digit[-1]
                pending = None if several[group[-1]] else (doc[at], sub[at], sub2[at], run[at], digit[at])
            held = tuple(c[-1] for c in (digit, span, doc, sub, sub2, run))
            out = np.flatnonzero(again | asked)
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (doc, sub, sub2, run, digit)] + [pa.array(again[out])], names=names)

    names = [*ROW, "run", "digit", "again"]
    # Settled runs go anywhere; sorted last, they do not come between the others.
    settled = F.col("run") < 0
    spread = F.when(settled, F.xxhash64("doc", "run")).otherwise(F.col("digit"))
    dealt = rows.repartition(spread).sortWithinPartitions(settled, *order)
    return dealt.mapInArrow(split, "doc long, sub long, sub2 long, run long, digit long, again boolean")


def windows(asked: DataFrame, keyed_docs: DataFrame) -> DataFrame:
    """The windows of the runs in question with their last digit: ``digit``, ``window``, the row, ``start``."""
    lists = asked.groupBy(*ROW).agg(F.collect_list(F.struct("run", "digit")).alias("asked"))

    def found(batches):
        for batch in batches:
            asked = batch.column(4)
            for n, raw in enumerate(batch.column(3).to_pylist()):
                own = asked[n].values
                run, digit = (own.field(i).to_numpy() for i in (0, 1))
                first, more = run >> 7, run & 127
                for begin in range(0, len(raw) - WINDOW + 1, AT_ONCE):
                    here = np.flatnonzero((first + more >= begin) & (first < begin + AT_ONCE))
                    if not len(here):
                        continue
                    part = np.frombuffer(raw[begin : begin + AT_ONCE + WINDOW - 1], np.uint8)
                    h = _hashes(_doubled(part, 64), WINDOW)
                    count = more[here] + 1
                    start = np.repeat(first[here] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    which = np.repeat(digit[here], count)
                    inside = (start >= begin) & (start < begin + AT_ONCE)
                    start, which = start[inside], which[inside]
                    at = start - begin
                    size = pa.array(np.full(len(at), n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which), signed(h[at]), *[batch.column(i).take(size) for i in range(3)], pa.array(start)],
                        names=["digit", "window", *ROW, "start"],
                    )

    # A repeated row is one document: its text is needed once.
    once = keyed_docs.join(lists, ROW).select(*ROW, "raw", "asked")
    return once.mapInArrow(found, "digit long, window long, doc long, sub long, sub2 long, start long")


def later_windows(rows: DataFrame) -> DataFrame:
    """The windows that are not the first of their group, as runs of one start."""
    order = ["digit", "window", *ROW, "start"]

    def split(batches):
        held = None
        for batch in batches:
            columns = _columns(batch)
            if not len(columns[0]):
                continue
            before = held or (~int(columns[0][0]), 0, 0, 0, 0, 0)
            digit, window, doc, sub, sub2, start = [np.concatenate((np.array([b], c.dtype), c[:-1])) == c for b, c in zip(before, columns, strict=True)]
            held = tuple(c[-1] for c in columns)
            out = np.flatnonzero(digit & window & ~(doc & sub & sub2 & start))
            yield pa.RecordBatch.from_arrays([*[pa.array(columns[i][out]) for i in (2, 3, 4)], pa.array(columns[5][out] * 128)], names=[*ROW, "run"])

    return rows.repartition("digit", "window").sortWithinPartitions(*order).mapInArrow(split, "doc long, sub long, sub2 long, run long")


def released(spark) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def repeated_runs(docs: DataFrame, own: list[Column], text_col: str = "text") -> DataFrame:
    """The runs of windows that an earlier one equals: the row, named by ``own``, and ``run``."""
    named = keyed(docs, own, text_col)
    passed = written(sorted_runs(runs(named)), "suffix-runs")
    released(docs.sparkSession)
    asked = passed.filter("NOT again").select(*ROW, "run", "digit")
    later = written(later_windows(windows(asked, named)), "suffix-windows")
    released(docs.sparkSession)
    return passed.filter("again").select(*ROW, "run").unionByName(later)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay."""
    X.slim_batches(docs.sparkSession)
    own = identity(docs, id_col, text_col)
    found = repeated_runs(docs, own, text_col)
    *row, runs_, made = (X.free_name(docs.columns, f"_{n}") for n in (*ROW, "runs", "made"))
    lists = found.groupBy(*[F.col(c).alias(n) for c, n in zip(ROW, row, strict=True)]).agg(F.collect_list("run").alias(runs_))

    @F.arrow_udf("struct<n_removed bigint, n_spans bigint, kept binary>")
    def cut(text: pa.Array, runs: pa.Array) -> pa.Array:
        rows = []
        for value, own in zip(text, runs, strict=True):
            raw = value.as_py()
            if not own.is_valid:
                rows.append({"n_removed": 0, "n_spans": 0, "kept": raw})
                continue
            run = own.values.to_numpy()
            change = np.zeros(len(raw) + 1, np.int64)
            np.add.at(change, run >> 7, 1)
            np.add.at(change, (run >> 7) + (run & 127) + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append({"n_removed": int(gone.sum()), "n_spans": spans, "kept": np.frombuffer(raw, np.uint8)[~gone].tobytes()})
        return pa.array(rows, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    text = X.whole(F.col(text_col))
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    kept = [c for c in docs.columns if c not in names]
    same = [value == F.col(name) for value, name in zip(own, row, strict=True)]
    both = docs.join(lists, same, "left").withColumn(made, cut(text.cast("binary"), F.col(runs_)))
    return both.select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), *[F.col(f"{made}.{n}").alias(n) for n in names[1:]])
