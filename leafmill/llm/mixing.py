"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, document after document, are packed into blocks of a fixed
length. The mix is a list of slots, cut into output shards. Each source has a quota of
slots, its target in blocks of its own mean length (a source's last block is shorter, and
may be its only one). The counts of sources per shard are a multinomial draw given those
quotas (drawn without putting back, so that totals are met exactly and not only on
average): a pseudorandom permutation of all slots deals every source's quota out over
the shards. The counts then make the slots. A shard's slots of a source take the next
ranks of that source, after those of earlier shards, and a permutation of the shard
interleaves its sources. The r-th slot of a source takes, in its pass ``r / blocks`` over
the source, the block that a permutation of that source and pass assigns to
``r mod blocks``; slots and blocks are joined by that index. A pass takes each block
once, and a quota is at most three passes, so no document comes more than three times.

Permutations are swap-or-not networks: each round either keeps an index or swaps it
with its mirror about a round key, by one hash bit of the pair. They permute any number
of indices exactly, row by row, with nothing stored.

Prefix sums over the documents of a source, which may be a third of the corpus, go over
hash buckets of documents first and within a bucket after, so no task gets a source.

Defined results: a null source is a source of its own and ranks last; a null or empty
text has size 0 and is never taken; repeated rows are packed as rows of their own, and
rows of one id (or none) in the order of a hash of their text, so reruns agree; extra
columns pass through ``mixed_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm import texts as X
from leafmill.session import written

#: Words of a block, slots of an output shard, documents of a prefix-sum bucket.
BLOCK_WORDS, SHARD_SLOTS, BUCKET_ROWS = 64, 4096, 4096
#: Slots that one row stands for before it is spread, shards of a stretch in prefix sums.
PIECE, STRETCH = 16_384, 4096
#: Weights of the sources in order, repeating; a source is passed at most so often.
WEIGHTS, MOST_PASSES = (5, 2, 1), 3
ROUNDS, SEED = 16, 20240607


def word_count(text: Column) -> Column:
    return F.regexp_count(X.whole(text), F.lit(X.WORD)).cast("long")


def permuted(x: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """The place of index ``x`` of [0, ``n``) in the permutation that ``seed`` names."""

    def step(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(seed, r), n) - at, n)
        swap = F.xxhash64(seed, r + rounds, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Per source: ``source_no``, ``source_size``, ``target`` in words.

    ``sizes`` has ``source`` and ``size`` per document. Shares go by weight; a target
    stops at ``most`` times its source, and the excess is shared again by weight. That
    is one water level L with target = min(cap, weight * L): sources that stop are those
    of the smallest cap per weight. One row per source reaches the ordered windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", (F.row_number().over(in_order) - 1).cast("long"))
    weight = F.element_at(F.lit(list(weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * float(most))
    fill = W.orderBy(F.col("_cap") / F.col("weight"), "source_no")
    everything = W.partitionBy(F.lit(0))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_weights": F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("_level", F.col("_left") / F.col("_weights"))
    # The level is that of the first source, in fill order, whose cap it does not reach.
    stays = F.col("_level") * F.col("weight") <= F.col("_cap")
    per = per.withColumn("_final", F.min_by(F.when(stays, F.col("_level")), F.when(stays, F.struct(F.col("_cap") / F.col("weight"), F.col("source_no")))).over(everything))
    level = F.coalesce("_final", F.lit(float("inf")))
    target = F.least("_cap", F.col("weight") * level)
    return per.select("source", "source_no", "source_size", target.alias("target"))


def planned(sizes: DataFrame, block: int = BLOCK_WORDS, **how) -> DataFrame:
    """Targets with each source's blocks, quota of slots, and first slot before shuffling."""
    per = source_targets(sizes, **how).withColumns(
        {
            "blocks": F.ceil(F.col("source_size") / block).cast("long"),
            "quota": F.round(F.col("target") * F.ceil(F.col("source_size") / block) / F.nullif(F.col("source_size"), F.lit(0))).cast("long"),
        }
    ).fillna(0, ["quota"])
    earlier = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumns(
        {
            "first_slot": F.coalesce(F.sum("quota").over(earlier), F.lit(0)),
            "slots": F.sum("quota").over(W.partitionBy(F.lit(0))),
        }
    )


def _spread(rows: DataFrame, plan: DataFrame, *keys: str) -> DataFrame:
    """``rows``, few but about to become one per slot, in as many partitions as slots ask for."""
    # By number: adaptive execution would join them into one.
    slots = plan.agg(F.max("slots")).first()[0] or 0
    wanted = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(4 * wanted, -(-slots // PIECE))), *keys)


def drawn_counts(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The draw: how many ``slots`` of each ``shard`` every source gets, and the source's ``blocks``."""
    runs = plan.filter("quota > 0").withColumn("run", F.explode(F.expr(f"sequence(0L, (quota - 1) div {PIECE})")))
    ranks = _spread(runs, plan, "source_no", "run").withColumn(
        "rank", F.explode(F.expr(f"sequence(run * {PIECE}, least((run + 1) * {PIECE}, quota) - 1)"))
    )
    slot = permuted(F.col("first_slot") + F.col("rank"), F.col("slots"), F.lit(seed).cast("long"))
    dealt = ranks.select("source_no", "blocks", slot.alias("slot"))
    return dealt.groupBy(F.expr(f"slot div {shard_slots}").alias("shard"), "source_no", "blocks").agg(F.count("*").alias("slots"))


def drawn_slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per slot of the mix: ``shard``, ``place`` in it, ``source_no``, block ``index``, ``pass``."""
    counts = written(drawn_counts(plan, shard_slots, seed), "shard-counts")
    before = W.unboundedPreceding, -1
    # A source's slots in earlier shards: over stretches of shards first, so no task gets all shards of a source.
    counts = counts.withColumn("_stretch", F.expr(f"shard div {STRETCH}"))
    sums = counts.groupBy("source_no", "_stretch").agg(F.sum("slots").alias("_sum"))
    lead = W.partitionBy("source_no").orderBy("_stretch").rowsBetween(*before)
    sums = sums.select("source_no", "_stretch", F.coalesce(F.sum("_sum").over(lead), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source_no", "_stretch").orderBy("shard").rowsBetween(*before)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("slots").over(inside), F.lit(0))).join(sums, ["source_no", "_stretch"])
    shard = W.partitionBy("shard")
    counts = counts.withColumns(
        {
            "first_rank": F.col("_base") + F.col("_inside"),
            "first_place": F.coalesce(F.sum("slots").over(shard.orderBy("source_no").rowsBetween(*before)), F.lit(0)),
            "width": F.sum("slots").over(shard),
        }
    )
    each = _spread(counts, plan, "shard", "source_no").withColumn("_nth", F.explode(F.expr("sequence(0L, slots - 1)")))
    each = each.withColumn("rank", F.col("first_rank") + F.col("_nth")).withColumn("pass", F.expr("rank div blocks"))
    own = F.xxhash64(F.lit(seed), "source_no", "pass")
    return each.select(
        "shard",
        permuted(F.col("first_place") + F.col("_nth"), F.col("width"), F.xxhash64(F.lit(seed), "shard")).alias("place"),
        "source_no",
        permuted(F.col("rank") % F.col("blocks"), F.col("blocks"), own).alias("index"),
        "pass",
    )


def shard_counts(slots: DataFrame) -> DataFrame:
    """How many slots of each shard every source has."""
    return slots.groupBy("shard", "source_no").agg(F.count("*").alias("slots"))


def packed(sized: DataFrame, plan: DataFrame, rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``start``, the place of a document's first word in its source's run of words.

    ``sized`` has ``doc_id``, ``source``, ``size``, ``mark`` (a hash of the text).
    """
    buckets = max(1, -(-rows // bucket_rows))
    named = sized.join(
        plan.select(F.col("source").alias("_source"), "source_no", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source")
    named = named.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    sums = named.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_words"))
    lead = W.partitionBy("source_no").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "source_no", "_bucket", F.coalesce(F.sum("_words").over(lead), F.lit(0)).alias("_base")
    )
    inside = W.partitionBy("source_no", "_bucket").orderBy("doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    named = named.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = named.join(sums, ["source_no", "_bucket"])
    return both.withColumn("start", F.col("_base") + F.col("_within")).drop("_bucket", "_base", "_within")


def with_blocks(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block that holds words of it: ``index`` and ``from``/``to`` in the document."""
    pieces = placed.filter("size > 0").withColumn(
        "index", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    )
    return pieces.withColumns(
        {
            "from": F.greatest(F.col("index") * block, "start") - F.col("start"),
            "to": F.least((F.col("index") + 1) * block, F.col("start") + F.col("size")) - F.col("start"),
        }
    )


def _mark() -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64("source", "text")


def _prepared(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _mark().alias("mark"))
    sized = written(sized, "sizes")
    plan = written(planned(sized, **how), "targets")
    return packed(sized, plan, sized.count()), plan


def taken_words(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Per document: ``size``, its source's ``source_size`` and ``target``, ``taken``, and the ``first_shard`` with words of it."""
    placed, plan = _prepared(docs, block=block)
    placed = written(placed, "placed")
    slots = drawn_slots(plan, shard_slots, seed)
    copies = slots.groupBy("source_no", "index").agg(F.count("*").alias("copies"), F.min("shard").alias("shard"))
    copies = written(copies, "copies")  # so that the join knows its size, which the few plan rows hide
    used = with_blocks(placed, block).join(copies, ["source_no", "index"])
    # ``start`` tells apart documents of a source that have words; the rest take nothing.
    taken = used.groupBy(F.col("source_no").alias("_source_no"), F.col("start").alias("_start")).agg(
        F.sum((F.col("to") - F.col("from")) * F.col("copies")).alias("taken"), F.min("shard").alias("first_shard")
    )
    some = placed.filter("size > 0").join(taken, (F.col("source_no") == F.col("_source_no")) & (F.col("start") == F.col("_start")), "left")
    shown = ["doc_id", "size", "source_size", "target"]
    none = placed.filter("size = 0").select(*shown, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return some.select(*shown, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard").unionByName(none)


def _words_and_spans(docs: DataFrame, block: int, seed: int, shard_slots: int) -> tuple[DataFrame, str, str]:
    """One row per document and pass with its columns, its words, and where each span of them goes; the two columns' names.

    Rows that repeat id, source and text share one text row.
    """
    mark, doc, own, spans, words = (X.free_name(docs.columns, n) for n in ("_mark", "_doc", "_own", "_spans", "_words"))
    named, known = X.free_name(docs.columns, "_named"), X.free_name(docs.columns, "_known")
    placed, plan = _prepared(docs, block=block)
    slots = written(drawn_slots(plan, shard_slots, seed), "slots")
    used = with_blocks(placed, block).join(slots, ["source_no", "index"])
    span = F.struct("from", "to", "shard", "place", "start")
    found = used.groupBy("source_no", "start", "pass", F.col("doc_id").alias(doc), F.col("mark").alias(own)).agg(
        F.sort_array(F.collect_list(span)).alias(spans)
    )
    # The id as two plain keys: rows without one meet too, and one shuffle of the texts serves both steps.
    once = docs.withColumns({mark: _mark(), named: _id_text(F.col("doc_id")), known: F.col("doc_id").isNotNull()})
    once = once.dropDuplicates([named, known, mark])
    found = found.select(_id_text(F.col(doc)).alias(named), F.col(doc).isNotNull().alias(known), F.col(own).alias(mark), spans)
    joined = once.join(found, [named, known, mark])
    return joined.withColumn(words, F.regexp_extract_all(F.col("text"), F.lit(X.BLANKS + "*" + X.WORD), F.lit(0))), words, spans


def _id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _cut(words: Column, span: Column) -> Column:
    return F.array_join(F.slice(words, (span["from"] + 1).cast("int"), (span["to"] - span["from"]).cast("int")), "")


def _per_span(words: str, spans: str, made: Callable[[Column, Column], Column]) -> Column:
    """``made(words, span)`` of every span. The words are bound once a row: named inside the
    inner function, the optimizer would put their expression there, and each span would split the whole text again."""
    return F.transform(F.array(F.col(words)), lambda w: F.transform(F.col(spans), lambda s: made(w, s)))[0]


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents: one row per document and pass, its text the words taken in that pass.

    Words keep the blanks before them, so a document taken whole is its text unchanged
    but for blanks at its end.
    """
    joined, words, spans = _words_and_spans(docs, block, seed, shard_slots)
    text = F.array_join(_per_span(words, spans, _cut), "")
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed_shards(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as it is trained on: one row per slot, ``shard``, ``place``, ``source`` and the block's ``text``.

    A block's words come from one or more documents in a row; blanks before a document's first word are one space.
    """
    joined, words, spans = _words_and_spans(docs.select("doc_id", "source", "text"), block, seed, shard_slots)

    def part(w: Column, s: Column) -> Column:
        bare = F.regexp_replace(_cut(w, s), f"^{X.BLANKS}+", "")
        return F.struct(s["shard"].alias("shard"), s["place"].alias("place"), s["start"].alias("start"), bare.alias("part"))

    parts = joined.select("source", F.explode(_per_span(words, spans, part)).alias("_part")).select("source", "_part.*")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda p: p["part"])
    return parts.groupBy("shard", "place", "source").agg(F.array_join(whole, " ").alias("text"))
