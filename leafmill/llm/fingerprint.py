"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is its sequence of words. A word of over ``PIECE`` characters is cut by what it holds:
each character of a script without spaces stands alone, other pieces end at a vowel, digit,
mark or sign (or at ``PIECE`` characters), so an edit changes the pieces around it only. A k-mer
of ``KMER`` words is chosen when the smallest, by hash, of its substrings of ``INNER``
words is the first or the last of them. That depends on the k-mer alone and on nothing
around it, so an edit changes only the k-mers that touch it, and about half of all
k-mers, evenly spread, are anchors wherever the same words stand.

A fingerprint is the ``SKETCH`` anchors of smallest hash among those of the whole text, each with its
place, as one 64-bit number (31 bits of hash, 32 of place); ``sketch=None`` keeps all anchors. The likeness of two fingerprints is the
share of anchors they have in common among the smallest of both together (an estimate of
their anchors' Jaccard similarity, exact with all anchors), where a common anchor counts if its two places
differ by the median shift of all common ones, give or take ``SLACK`` words.

Defined results: null is the empty text, whose fingerprint is empty; two empty
fingerprints have likeness 1, an empty and another 0. A text with words but no chosen
k-mer (always below ``KMER`` words, at times up to two more) has one anchor, its whole
sequence. Equal texts have equal fingerprints.

For the neighbour in descending order of (integer) ids, documents are dealt to ranges that hold
about ``RANGE_ROWS`` documents each by counted quantiles of the ids, up to ``MOST_RANGES`` ranges.
Null ids come last. Rows of one id, or of none, follow each other by the hash of their
text, and are dealt by it where they fill several ranges. Inside a range a window looks one
row ahead; only each range's first document is joined to the range before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm import texts as X
from leafmill.session import written

#: Words of a k-mer and of its inner substring (KMER - INNER + 1 is a power of two), characters of a piece.
KMER, INNER, PIECE = 5, 2, 16
#: Anchors kept, words by which a common anchor may be off, documents of a range, ranges at most.
SKETCH, SLACK, RANGE_ROWS, MOST_RANGES = 64, 64, 2048, 1 << 16

WORD = r"[^\x20\x09-\x0D]"
#: Scripts written without spaces, and characters after which a piece ends.
ALONE = "".join(rf"\p{{Is{name}}}" for name in "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split())
ENDS = r"aeiouAEIOU0-9\p{M}\p{P}\p{S}"
_INSIDE = rf"[^\x20\x09-\x0D{ALONE}{ENDS}]"
#: A short word, else a piece of a longer one.
PIECES = (
    rf"(?<!{WORD}){WORD}{{1,{PIECE}}}+(?!{WORD})"
    rf"|[{ALONE}]|{_INSIDE}{{0,{PIECE - 1}}}+[{ENDS}&&[^{ALONE}]]|{_INSIDE}{{1,{PIECE}}}+"
)


def _from(array: str, first: int) -> Column:
    return F.slice(array, first, F.greatest(F.size(array), F.lit(1)))


def with_fingerprint(df: DataFrame, text_col: str, name: str, sketch: int | None = SKETCH) -> DataFrame:
    """Adds the fingerprint of a text as a sorted list of 64-bit numbers."""
    n = KMER - INNER + 1
    out = df.withColumn("_words", F.regexp_extract_all(X.whole(F.col(text_col)), F.lit(PIECES), F.lit(0)))
    out = out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    inner = F.col("_h")
    for i in range(1, INNER):
        inner = F.zip_with(inner, _from("_h", i + 1), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("_s", F.slice(inner, 1, F.greatest(F.size("_h") - (INNER - 1), F.lit(0))))
    least, width, step = "_s", 1, 0
    while width < n:  # smallest of 2, 4 ... n inner substrings from each place on
        step += 1
        out = out.withColumn(f"_m{step}", F.zip_with(least, _from(least, width + 1), lambda a, b: F.least(a, b)))
        least, width = f"_m{step}", width * 2
    edge = F.filter(
        F.sequence(F.lit(1), F.size("_s") - n + 1),
        lambda i: (F.get(least, i - 1) == F.get("_s", i - 1)) | (F.get(least, i - 1) == F.get("_s", i + n - 2)),
    )
    short = F.when(F.size("_words") == 0, F.array().cast("array<bigint>")).otherwise(
        F.array(F.shiftleft(F.xxhash64("_words").bitwiseAND(F.lit(0x7FFFFFFF)), 32) + 1)
    )

    def anchor(i: Column) -> Column:
        words = [F.get("_h", i - 1 + j) for j in range(KMER)]
        return F.shiftleft(F.xxhash64(*words).bitwiseAND(F.lit(0x7FFFFFFF)), 32) + i

    out = out.withColumn("_a", F.when(F.size("_words") >= KMER, F.sort_array(F.transform(edge, anchor))))
    out = out.withColumn("_a", F.when(F.size(F.coalesce("_a", F.array().cast("array<bigint>"))) == 0, short).otherwise(F.col("_a")))
    first = F.filter("_a", lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get("_a", i - 1), 32)))
    return out.withColumn(name, first if sketch is None else F.slice(first, 1, sketch)).drop("_words", "_h", "_s", *[f"_m{i + 1}" for i in range(step)], "_a")


def with_likeness(df: DataFrame, a: str, b: str, name: str, sketch: int | None = SKETCH) -> DataFrame:
    """Adds the likeness of two fingerprints, from 0 to 1."""
    out = df.withColumns({"_ha": F.transform(a, lambda x: F.shiftright(x, 32)), "_hb": F.transform(b, lambda x: F.shiftright(x, 32))})
    both = F.sort_array(F.array_union("_ha", "_hb"))
    out = out.withColumn("_both", both if sketch is None else F.slice(both, 1, sketch))
    out = out.withColumn("_common", F.filter(F.array_intersect("_ha", "_hb"), lambda x: x <= F.element_at("_both", -1)))

    def place(of: str, hashes: str, x: Column) -> Column:
        return F.get(of, (F.array_position(hashes, x) - 1).cast("int")).bitwiseAND(F.lit(0xFFFFFFFF))

    shift = F.transform("_common", lambda x: place(a, "_ha", x) - place(b, "_hb", x))
    out = out.withColumn("_shift", F.sort_array(shift))
    out = out.withColumn("_middle", F.get("_shift", F.expr("cast(size(_shift) div 2 as int)")))
    near = F.size(F.filter("_shift", lambda s: F.abs(s - F.col("_middle")) <= SLACK))
    value = F.when(F.size("_both") == 0, F.lit(1.0)).otherwise(near / F.size("_both"))
    return out.withColumn(name, value.cast("double")).drop("_ha", "_hb", "_both", "_common", "_shift", "_middle")


def shown(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _counted(bounds: list[int], i: Column, equal: bool) -> Column:
    """How many of the sorted ``bounds`` are below ``i`` (or equal to it): first by steps, then inside one."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))

    def passed(some: Column) -> Column:
        return F.size(F.filter(some, (lambda b: b <= i) if equal else (lambda b: b < i)))

    steps = passed(_numbers(bounds[::step]))
    inside = F.slice(_numbers(bounds), F.greatest((steps - 1) * step + 1, F.lit(1)), F.lit(step))
    return F.when(steps == 0, 0).otherwise((steps - 1) * step + passed(inside))


def with_range(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``_range``, which never falls as id and text hash (``_hash``) grow; negative without an id."""
    total = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    ranges = min(MOST_RANGES, -(-total.named // range_rows))
    bounds: list[int] = []
    if ranges > 1:
        shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
        bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, max(10_000, 4 * ranges)).alias("b")).first().b
    bare = min(MOST_RANGES, -(-(total.n - total.named) // range_rows))
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    part = F.col("_hash").cast("double") / F.lit(2.0**64) + 0.5

    def share(n: Column) -> Column:
        return F.least(F.floor(part * n), n - 1).cast("int")

    hashed = hashed.withColumns({"_low": _counted(bounds, F.col("doc_id"), False), "_high": _counted(bounds, F.col("doc_id"), True)})
    named = F.col("_low") + F.when(F.col("_high") - F.col("_low") > 1, share(F.col("_high") - F.col("_low") + 1)).otherwise(F.col("_high") - F.col("_low"))
    return hashed.withColumn("_range", F.when(F.col("doc_id").isNull(), share(F.lit(bare)) - bare).otherwise(named)).drop("_low", "_high")


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, sketch: int | None = SKETCH) -> DataFrame:
    """Adds ``fp``, and ``next_text`` and ``next_fp`` of the document with the next lower id, the first's for the last.

    ``docs`` has ``doc_id`` and ``text``.
    """
    ranged = with_range(docs, range_rows)
    # The first document of each range: ids and hashes first, then the few texts they name.
    tops = ranged.groupBy("_range").agg(F.max(F.struct("doc_id", "_hash")).alias("_top"))
    tops = written(tops.select("_range", F.col("_top.doc_id").alias("_top_id"), F.col("_top._hash").alias("_top_hash")), "range-tops")
    follow = W.orderBy(F.desc("_range"))
    links = tops.select(F.coalesce(F.lead("_range").over(follow), F.first("_range").over(follow)).alias("_range"), F.col("_range").alias("_before"))
    named = tops.select(F.col("_range").alias("_own"), "_top_id", "_top_hash")
    is_top = (F.col("_range") == F.col("_own")) & (F.col("_hash") == F.col("_top_hash")) & F.col("doc_id").eqNullSafe(F.col("_top_id"))
    heads = ranged.join(named, is_top).groupBy("_range").agg(F.max("text").alias("_text"))
    heads = with_fingerprint(links.join(heads, "_range"), "_text", "_fp", sketch).select("_before", F.struct(F.col("_text").alias("text"), F.col("_fp").alias("fp")).alias("_head"))
    order = W.partitionBy("_range").orderBy(F.desc_nulls_last("doc_id"), F.desc("_hash"), F.desc("text"))
    ahead = with_fingerprint(ranged, "text", "fp", sketch).withColumn("_next", F.lead(F.struct("text", "fp")).over(order))
    both = ahead.join(heads, (F.col("_range") == F.col("_before")) & F.col("_next").isNull(), "left")
    following = F.coalesce("_next", "_head")
    return both.withColumns({"next_text": following["text"], "next_fp": following["fp"]}).drop("_range", "_hash", "_next", "_before", "_head")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per document: ``n_chars``, ``edited`` (its second half from the next document), both fingerprints and likenesses."""
    base = docs.select(F.col(id_col).alias("doc_id"), X.whole(F.col(text_col)).alias("text"))
    both = with_next(base, range_rows, sketch).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    both = both.withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)),
    ).drop("next_text", "text")
    both = with_fingerprint(both, "edited", "edited_fp", sketch)
    both = with_likeness(with_likeness(both, "fp", "edited_fp", "near_edited", sketch), "fp", "next_fp", "near_next", sketch)
    return both.drop("next_fp")
