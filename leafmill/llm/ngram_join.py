"""Similarity join of documents on their sets of word n-grams, through prefix trees.

A document's set holds its distinct shingles of ``SHINGLE`` words. Two documents link when
their sets' Jaccard similarity is ``PERCENT`` of a hundred or more. Sets are ordered
globally: n-grams that a first pass saw often last, the others by hash before them. (Any
order gives the same links; this one keeps common passages out of the prefixes.)

Documents of equal sets are one class, told by size and 128 bits of hash, and numbered; one
of its rows, told by id and 128 bits of its text's hash, stands for it. Rows of one id (or
of none) may hold different texts and are told apart throughout; ids are labels. Linked sets share k
n-grams among the first ``n - ceil(0.75 n) + k`` of both (k is ``least_shared``, of the
shorter one), so candidates meet by those:
sorted rows of (n-gram, class) stream through the tasks, and n-grams of one class drop
out. Then pairs are compared, and classes found linked become one component, so that pairs
inside a component need no comparison any more. First every class meets one class
of each of its n-grams' groups. Then groups of more than ``SMALL`` classes go in rounds, in
blocks: a block of many pairs gives a random one of each component at a time, which joins
the components of a group of near copies in a few rounds, until all pairs left have been
compared. Last come all pairs of small groups that lie in different components still. So a
group of thousands of near copies takes some rows a member, not a row a pair, and no link
that joins two components can be missed.

Before sets are fetched, a pair must pass exact tests: its lengths, and the bits in which
its parity maps differ, which are at most the n-grams in which the sets do; first in maps
of 256 bits, then in maps of ``FINE_BITS`` bits an n-gram or more. Only sets of the pairs that remain
are made.
Candidates of one class are compared in blocks: the block's sets form a prefix tree, so
sets with the same beginning share its overlap, and a branch is left as soon as overlap
plus what remains cannot reach what its shortest set would need.

Defined results: a null or empty text has no n-gram and links with nothing. Rows that
repeat id and text get equal results, rows that repeat an id with other texts their own. A null id ranks above all ids, and a component of
null ids only has a null id. Extra columns stay; the results' names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import texts as X
from leafmill.llm.components import components
from leafmill.llm.suffix_dedup import released, signed
from leafmill.session import written

SHINGLE, PERCENT = 5, 75
#: An n-gram counts as common from so many sightings; at most so many are told to the tasks
#: (8 MB). Only the order, and so the work, depends on them.
COMMON, MOST_COMMON = 32, 1 << 20
#: N-grams a task counts at once, sets of a tree, classes of a block.
AT_ONCE, TREE_SETS, BLOCK = 1 << 20, 256, 1024
#: Classes of a small group; pairs a class that a larger group's unit gives out at once, and
#: rounds after which it gives all (only groups of very many pairs that may link, but do not, get there).
SMALL, ENOUGH, HOT_ROUNDS = 32, 4, 8
#: Pairs of a component that such a unit gives out at once.
PICKS = 3
#: Bytes of text whose words a task holds at once (a longer single text is held alone).
PORTION = 2 << 20
HIGHEST = (1 << 63) - 1
MAP_WORDS, FINE_BITS = 4, 4
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def portions(batches):
    """Batches of (document, text) in pieces of bounded text, so that memory follows a piece."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // PORTION
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            # A copy: splitting words goes wrong on texts that begin inside their buffer.
            yield batch.take(pa.array(np.arange(a, b)))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text its distinct shingles, as sorted 63-bit hashes."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = pc.ascii_split_whitespace(lower)
    flat, ends = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    hashes = names[coded.indices.to_numpy()[real]] if len(names) else np.empty(0, np.uint64)
    ends = np.concatenate(([0], np.cumsum(real)))[ends]
    grams = hashes[: max(0, len(hashes) - SHINGLE + 1)].copy()
    for j in range(1, SHINGLE):
        grams = _mixed(grams * _FACTOR + hashes[j : j + len(grams)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = grams[a : b - SHINGLE + 1]
        elif b > a:  # the whole short sequence is one shingle
            own = np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=b - a)], np.uint64)
        else:
            own = np.empty(0, np.uint64)
        out.append(np.unique(own >> np.uint64(1)))
    return out


def ordered(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set in global order: common n-grams get the top bit, then numbers are sorted."""
    if not len(common) or not len(own):
        return own
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    often = common[at] == own
    return np.concatenate((own[~often], own[often] | np.uint64(1 << 63)))


def least_shared(n):
    """N-grams that a linked set of ``n`` must share in the prefixes: more for longer sets, which share some by chance."""
    return 1 + n // 50


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + least_shared(n) if n else 0


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= PERCENT * (a + b - overlap) and overlap > 0


def parity_map(own: np.ndarray) -> np.ndarray:
    """Bits of which each n-gram flips one: two maps differ in at most as many bits as their sets in n-grams.

    A power of two of words, with ``FINE_BITS`` bits an n-gram or more: the more, the fewer n-grams flip one bit twice.
    """
    size = 64 * MAP_WORDS
    while size < FINE_BITS * len(own):
        size *= 2
    bits = np.bincount((_mixed(own) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The map that the same set has in ``size`` words."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


#: What tells a row's text apart: its id and two hashes of the text.
ROW = ["doc", "t1", "t2"]


def _row(id_col: str, text_col: str) -> list[Column]:
    text = X.whole(F.col(text_col))
    hashes = [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(HIGHEST)), *hashes]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc, t1, t2 = _row(id_col, text_col)
    return docs.select(doc.alias("doc"), F.col(text_col).alias("text"), t1.alias("t1"), t2.alias("t2"))


def surveyed(texts: DataFrame) -> DataFrame:
    """Two kinds of rows: per document its set's size, hash and parity map; and n-grams a task saw often."""

    def found(batches):
        held, size = [], 0

        def often(held):
            grams, seen = np.unique(np.concatenate(held), return_counts=True)
            grams, seen = grams[seen >= 4], seen[seen >= 4]
            empty = pa.nulls(len(grams), pa.int64())
            columns = [pa.nulls(len(grams), pa.int64()), pa.array(seen.astype(np.int64)), signed(grams), empty]
            columns += [pa.nulls(len(grams), pa.list_(pa.int64())), pa.nulls(len(grams), pa.binary()), empty, empty]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in portions(batches):
            sets = shingle_sets(batch.column(1))
            maps = [parity_map(s) for s in sets]
            wide = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), signed(np.array([w >> 64 for w in wide], np.uint64)),
                 signed(np.array([w & (1 << 64) - 1 for w in wide], np.uint64)),
                 pa.array([folded(m, MAP_WORDS).view(np.int64) for m in maps], pa.list_(pa.int64())), pa.array([m.tobytes() for m in maps], pa.binary()),
                 batch.column(2), batch.column(3)],
                names=names,
            )
            for s in sets:
                held.append(s)
                size += len(s)
                if size > AT_ONCE:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    names = ["doc", "n", "h", "h2", "map", "fine", "t1", "t2"]
    return texts.mapInArrow(found, "doc long, n long, h long, h2 long, map array<long>, fine binary, t1 long, t2 long")


def common_ngrams(survey: DataFrame) -> np.ndarray:
    rows = survey.filter("doc IS NULL").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    top = rows.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toPandas()["h"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def prefixes(texts: DataFrame, common) -> DataFrame:
    """Per row the first n-grams of its ordered set: ``doc``, ``t1``, ``t2``, ``n``, ``first``."""

    def found(batches):
        for batch in portions(batches):
            sets = [ordered(s, common.value) for s in shingle_sets(batch.column(1))]
            first = [s[: prefix_length(len(s))] for s in sets]
            values = pa.array(np.concatenate([*first, np.empty(0, np.uint64)]).view(np.int64))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in first]))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(ends, values)],
                names=[*ROW, "n", "first"],
            )

    return texts.mapInArrow(found, "doc long, t1 long, t2 long, n int, first array<long>")


def shared_ngrams(rows: DataFrame) -> DataFrame:
    """The rows (``gram``, ``node``, ``n``) whose n-gram another class has too, each once."""

    def split(batches):
        held = None  # the last row, not yet given out, and whether the one before had its n-gram
        for batch in batches:
            gram, node, n = (c.to_numpy() for c in batch.columns)
            if not len(gram):
                continue
            before = False
            if held is not None:
                gram, node, n = (np.concatenate((np.array([h], c.dtype), c)) for h, c in zip(held[:3], (gram, node, n), strict=True))
                before = held[3]
            # Rows that repeat id and text stand for their class more than once.
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])))
            gram, node, n = gram[new], node[new], n[new]
            same = gram[1:] == gram[:-1]
            up = np.concatenate(([before], same))
            out = np.flatnonzero(up[:-1] | same)
            held = (gram[-1], node[-1], n[-1], bool(up[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (gram, node, n)], names=names)
        if held is not None and held[3]:
            yield pa.RecordBatch.from_arrays([pa.array([h]) for h in held[:3]], names=names)

    names = ["gram", "node", "n"]
    dealt = rows.repartition("gram").sortWithinPartitions("gram", "n", "node")
    return dealt.mapInArrow(split, "gram long, node long, n int")


def may_link(a: str, b: str, a_map: str, b_map: str):
    """Exact tests before sets are compared: lengths, and parity maps."""
    differ = F.aggregate(F.zip_with(a_map, b_map, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    lengths = F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT
    # |A sym. diff. B| <= (|A| + |B|) (1 - t) / (1 + t) for linked sets.
    return lengths & (differ * (100 + PERCENT) <= (F.col(a) + F.col(b)) * (100 - PERCENT))


def sharpened(pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """The pairs whose whole parity maps still allow a link; ``fine`` has ``node``, ``n``, ``fine``."""

    @F.arrow_udf("boolean")
    def allowed(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for x, y, total in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            size = min(len(x), len(y))
            differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
            out.append(differ * (100 + PERCENT) <= total * (100 - PERCENT))
        return pa.array(out, pa.bool_())

    both = pairs.join(fine.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("fine").alias("a_fine")), "a")
    both = both.join(fine.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("fine").alias("b_fine")), "b")
    return both.filter(allowed("a_fine", "b_fine", F.col("a_n") + F.col("b_n"))).select("a", "b")


class Tree:
    """A prefix tree of ordered sets; a node holds a run of n-grams, its sets' ends, and length bounds."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        self.sets, self.lengths = sets, [len(s) for s in sets]
        self.root = self._node(order, 0)

    def _node(self, own: list[int], depth: int):
        """Sets of ``own`` (in order) agree up to ``depth``."""
        a, b = self.sets[own[0]], self.sets[own[-1]]
        most = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:most] != b[depth:most])
        end = depth + int(differ[0]) if len(differ) else most
        lengths = [self.lengths[i] for i in own]
        done = [i for i in own if self.lengths[i] == end]
        rest = [i for i in own if self.lengths[i] > end]
        children, begin = [], 0
        while begin < len(rest):
            stop, first = begin + 1, self.sets[rest[begin]][end]
            while stop < len(rest) and self.sets[rest[stop]][end] == first:
                stop += 1
            children.append(self._node(rest[begin:stop], end))
            begin = stop
        return (a[depth:end], end, min(lengths), max(lengths), done, children)

    def links(self, probe: np.ndarray) -> list[int]:
        """The sets linked with ``probe``."""
        out, todo = [], [(self.root, 0)]
        while todo:
            (run, end, shortest, longest, done, children), overlap = todo.pop()
            if len(run):
                at = np.searchsorted(probe, run)
                overlap += int((probe[np.minimum(at, len(probe) - 1)] == run).sum())
            passed = int(np.searchsorted(probe, run[-1], "right")) if len(run) else 0
            out += [i for i in done if linked(overlap, len(probe), end)]
            # What remains on either side bounds what the branch can still add.
            reach = overlap + min(len(probe) - passed, longest - end)
            if (100 + PERCENT) * reach >= PERCENT * (len(probe) + max(shortest, end)):
                todo += [(c, overlap) for c in children]
        return out


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) that link. Sets meet in blocks of one ``b`` and some ``a``."""
    many = pairs.groupBy("b").agg(F.count("*").alias("members"))
    blocks = pairs.join(many, "b").withColumn(
        "block", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / TREE_SETS).cast("long"))
    ).select("a", "b", "block")
    members = blocks.join(sets.withColumnRenamed("node", "a"), "a").select("b", "block", "a", "own")
    probes = blocks.select("b", "block").distinct().join(sets.withColumnRenamed("node", "b"), "b")
    rows = members.unionByName(probes.select("b", "block", F.lit(None).cast("long").alias("a"), "own"))
    dealt = rows.repartition("b", "block").sortWithinPartitions("b", "block", F.asc_nulls_first("a"))

    def join(batches):
        key, probe, names, sets = None, None, [], []

        def found():
            hits = Tree(sets).links(probe) if sets and probe is not None and len(probe) else []
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in hits], pa.int64()), pa.array([key[0]] * len(hits), pa.int64())], names=["a", "b"])

        for batch in batches:
            for b, block, a, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (b, block) != key:
                    if key is not None:
                        yield found()
                    key, probe, names, sets = (b, block), None, [], []
                value = np.frombuffer(own, "<u8")
                if a is None:
                    probe = value
                else:
                    names.append(a)
                    sets.append(value)
        if key is not None:
            yield found()

    return dealt.mapInArrow(join, "a long, b long")


def ordered_sets(texts: DataFrame, wanted: DataFrame, common) -> DataFrame:
    """The ordered sets of the wanted classes (``node`` and its row), one row each: ``node``, ``own`` as bytes."""

    def found(batches):
        for batch in portions(batches):
            sets = [ordered(s, common.value).astype("<u8").tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "own"])

    once = texts.join(wanted, ROW).dropDuplicates(["node"])
    return once.select("node", "text").mapInArrow(found, "node long, own binary")


def star_pairs(groups: DataFrame) -> DataFrame:
    """Each class of an n-gram with the group's smallest set, its hub.

    ``groups`` has ``gram``, ``node``, ``label``, ``n``, ``map``.
    """
    rank = F.struct("n", "node")
    hubs = groups.groupBy("gram").agg(F.min_by(F.struct("node", "label", "n", "map"), rank).alias("hub"))
    both = groups.join(hubs, "gram").filter("label <> hub.label")
    both = both.select("node", "n", "map", F.col("hub.node").alias("b"), F.col("hub.n").alias("b_n"), F.col("hub.map").alias("b_map"))
    return both.filter(may_link("n", "b_n", "map", "b_map")).select(F.col("node").alias("a"), "b").distinct()


def near(p, q, label, n, maps) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows' pairs those in different components that lengths and parity maps allow to link."""
    ok = (label[p] != label[q]) & (np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * PERCENT)
    p, q = p[ok], q[ok]
    differ = np.bitwise_count(maps[p] ^ maps[q]).sum(1).astype(np.int64)
    ok = differ * (100 + PERCENT) <= (n[p].astype(np.int64) + n[q]) * (100 - PERCENT)
    return p[ok], q[ok]


def grouped_rows(batches, keys: int):
    """Sorted rows as columns that hold whole groups, equal in the first ``keys`` columns; the last column is the map."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns - 1)]
        new.append(batch.column(batch.num_columns - 1).flatten().to_numpy().view(np.uint64).reshape(-1, MAP_WORDS))
        if held is not None:
            new = [np.concatenate(c) for c in zip(held, new, strict=True)]
        last = np.ones(len(new[0]), bool)
        for c in new[:keys]:
            last &= c == c[-1]
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # the last group may go on
        held = [c[cut:] for c in new]
        if cut:
            yield [c[:cut] for c in new]
    if held is not None:
        yield held


class WideMaps:
    """Whole parity maps of some rows, by size, and folded to half of it: sizes of sets that may link are that near."""

    def __init__(self, fine: np.ndarray):
        self.words = np.array([len(f) // 8 for f in fine], np.int64)
        self.place = np.zeros(len(fine), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for size in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == size)
            self.place[at] = np.arange(len(at))
            self.of[size] = np.frombuffer(b"".join(fine[at]), np.uint64).reshape(-1, size)

    def differ(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The number of bits in which the maps of each pair differ."""
        out = np.zeros(len(p), np.int64)
        a, b = np.minimum(self.words[p], self.words[q]), np.maximum(self.words[p], self.words[q])
        large = np.where(self.words[p] == b, p, q)
        small = np.where(large == p, q, p)
        for x, y in {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)}:
            at = np.flatnonzero((a == x) & (b == y))
            step = max(1, (1 << 20) // y)
            for begin in range(0, len(at), step):
                own = at[begin : begin + step]
                one = self.of[y][self.place[large[own]]]
                one = np.bitwise_xor.reduce(one.reshape(len(own), -1, x), axis=1)
                out[own] = np.bitwise_count(one ^ self.of[x][self.place[small[own]]]).sum(1)
        return out


def firsts(columns: list[np.ndarray]) -> np.ndarray:
    """Where the groups of sorted rows begin, and where the last one ends."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def small_pairs(groups: DataFrame) -> DataFrame:
    """All pairs in groups of up to ``SMALL`` classes that share enough n-grams, lie in different components and may link.

    Every such n-gram that two classes share is in one of these groups, or a larger group has
    settled them already, so the count of their meetings is whole.
    """

    def found(batches):
        for gram, node, label, n, maps in grouped_rows(batches, 1):
            first = firsts([gram])
            size = np.diff(first)
            rest = np.repeat(size, size) - (np.arange(len(gram)) - np.repeat(first[:-1], size))
            for step in range(1, SMALL):  # the partners at each distance, for all groups at once
                at = np.flatnonzero(rest > step)
                if not len(at):
                    break
                p, q = near(at, at + step, label, n, maps)
                need = least_shared(np.minimum(n[p], n[q]).astype(np.int64))
                p, q = node[p], node[q]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q)), pa.array(need)], names=["a", "b", "need"])

    sorted_ = groups.select("gram", "node", "label", "n", "map").repartition("gram").sortWithinPartitions("gram")
    met = sorted_.mapInArrow(found, "a long, b long, need long").groupBy("a", "b", "need").agg(F.count("*").alias("met"))
    return met.filter("met >= need").select("a", "b")


def hot_pairs(groups: DataFrame, sizes: DataFrame, round_no: int) -> DataFrame:
    """Pairs (``a``, ``b``) of larger groups that lie in different components and may link, a bounded number a class;
    and rows (``gram``, ``left``) of the groups that hold more than were given out.

    A group is cut into blocks of ``BLOCK`` classes by hash, and each pair of its blocks is a
    task's unit, so no group is ever in one place. A unit of few pairs gives all of them. Any other gives a
    random pair of each of its components: what links joins components, and next round
    its members need no comparison any more.
    """
    blocks = sizes.select("gram", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    dealt = groups.join(blocks, "gram").withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "fine", "map")
    whole = round_no >= HOT_ROUNDS

    def some_of_each(a, b, a_label, b_label):
        """For each component its pairs of the smallest numbers, made from the pair and the round."""
        low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
        chance = _mixed(_mixed(low * _FACTOR + np.uint64(round_no)) ^ high)
        label = np.concatenate((a_label, b_label))
        order = np.lexsort((np.tile(chance, 2), label))
        first = firsts([label[order]])
        rank = np.arange(len(order)) - np.repeat(first[:-1], np.diff(first))
        return np.unique(order[rank < PICKS] % max(1, len(a)))

    def unit(own, i, j, node, label, n, fine, maps):
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out, total, wide = [], 0, WideMaps(fine)
        for at in range(0, len(left), 256):
            p, q = (x.ravel() for x in np.meshgrid(left[at : at + 256], right, indexing="ij"))
            p, q = near(p[p < q], q[p < q], label, n, maps) if i == j else near(p, q, label, n, maps)
            ok = wide.differ(p, q) * (100 + PERCENT) <= (n[p].astype(np.int64) + n[q]) * (100 - PERCENT)
            p, q = p[ok], q[ok]
            total += len(p)
            out.append((p, q))
            if not whole and sum(len(x) for x, _ in out) > ENOUGH * len(own):
                p, q = (np.concatenate(c) for c in zip(*out, strict=True))
                at = some_of_each(node[p], node[q], label[p], label[q])
                out = [(p[at], q[at])]
        p, q = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (left[:0], left[:0])
        if not whole and len(p) < total:
            at = some_of_each(node[p], node[q], label[p], label[q])
            p, q = p[at], q[at]
        return node[p], node[q], total - len(p)

    def found(batches):
        for gram, i, j, own, node, label, n, fine, maps in grouped_rows(batches, 3):
            first = firsts([gram, i, j])
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                p, q, left = unit(own[a:b], i[a], j[a], node[a:b], label[a:b], n[a:b], fine[a:b], maps[a:b])
                numbers = [np.maximum(p, q), np.minimum(p, q), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)]
                if left:
                    numbers = [np.append(c, x) for c, x in zip(numbers, (-1, -1, gram[a], left), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in numbers], names=["a", "b", "gram", "left"])

    sorted_ = dealt.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return sorted_.mapInArrow(found, "a long, b long, gram long, left long").distinct()


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (``node``, ``label`` and more) with labels joined by the links between classes."""
    of = nodes.select("node", "label")
    pairs = links.join(of.select(F.col("node").alias("a"), F.col("label").alias("a_label")), "a")
    pairs = pairs.join(of.select(F.col("node").alias("b"), F.col("label").alias("b_label")), "b")
    found = components(pairs.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    found = found.select(F.col("node").alias("label"), F.col("label").alias("least"))
    out = nodes.join(found, "label", "left")
    return out.withColumn("label", F.coalesce("least", "label")).drop("least").select(*nodes.columns)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``doc``, ``t1``, ``t2``, ``n`` and ``component``; no id is ``HIGHEST``."""
    spark = docs.sparkSession
    X.slim_batches(spark)
    texts = _texts(docs, id_col, text_col)
    survey = written(surveyed(texts), "ngram-survey")
    common = spark.sparkContext.broadcast(common_ngrams(survey))  # at most MOST_COMMON numbers
    per_doc = survey.filter("doc IS NOT NULL")
    classes = per_doc.filter("n > 0").groupBy("n", "h", "h2").agg(F.min(F.struct(*ROW)).alias("first"))
    # Numbers are given once and then read: another run of the same plan could give others.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    named = written(per_doc.join(classes, ["n", "h", "h2"], "left").select(*ROW, "n", "node", "first", "map", "fine"), "ngram-named")
    heads = named.filter(F.struct(*ROW) == F.col("first")).dropDuplicates(["node"])
    nodes = heads.select("node", *ROW, F.col("node").alias("label"), F.col("n").cast("int").alias("n"), "map")
    first = prefixes(texts, common).join(nodes.select("node", *ROW), ROW)
    rows = first.select(F.explode("first").alias("gram"), "node", "n")
    shared = written(shared_ngrams(rows), "ngram-shared")
    released(spark)
    nodes = written(nodes.join(shared.select("node").distinct(), "node", "left_semi"), "ngram-nodes")
    fine = heads.select("node", "n", "fine")

    def unsettled(rows):
        held = rows.select("gram", "node").join(nodes.drop(*ROW), "node")
        spread = held.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
        return held, spread.filter("low <> high").select("gram", "size")

    def joined(pairs):
        """``nodes`` with the components that the links among some pairs join."""
        pairs = written(sharpened(pairs, fine), "ngram-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = written(ordered_sets(texts, nodes.select("node", *ROW).join(wanted, "node"), common), "ngram-sets")
        released(spark)
        links = written(compared(pairs, sets), "ngram-links")
        released(spark)
        return written(labelled(nodes, links), "ngram-nodes")

    held, open_ = unsettled(shared)
    nodes = joined(written(star_pairs(held.join(open_, "gram", "left_semi")), "ngram-candidates"))
    # Every group's size counts once, before groups settle, so that one is either small or hot to its end.
    sizes = written(shared.groupBy("gram").agg(F.count("*").alias("size")).filter(F.col("size") > SMALL), "ngram-hot")
    hot = written(shared.join(sizes, "gram", "left_semi"), "ngram-hot-rows")
    for round_no in range(HOT_ROUNDS + 1):
        held, open_ = unsettled(hot)
        held = held.join(open_, "gram", "left_semi").join(fine.select("node", "fine"), "node")
        found = written(hot_pairs(held, open_, round_no), "ngram-candidates")
        pairs = found.filter("a >= 0").select("a", "b").distinct()
        if not pairs.isEmpty():
            nodes = joined(pairs)
        more = found.filter("a < 0").select("gram").distinct()
        if more.isEmpty():
            break
        hot = hot.join(more, "gram", "left_semi")
    held, open_ = unsettled(shared.join(sizes, "gram", "left_anti"))
    nodes = joined(written(small_pairs(held.join(open_, "gram", "left_semi")), "ngram-candidates"))
    # A class's row has its smallest id; a component's id is the smallest of its classes'.
    least = nodes.groupBy("label").agg(F.min("doc").alias("component"))
    found = nodes.select("node", "label").join(least, "label").select("node", "component")
    out = named.join(found, "node", "left")
    return out.select(*ROW, "n", F.coalesce("component", "first.doc", "doc").alias("component"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``."""
    return _grouped(docs, id_col, text_col).select(
        F.when(F.col("doc") != HIGHEST, F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("component") != HIGHEST, F.col("component")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is their group's smallest; rows without words, or an id, all stay."""
    names = [X.free_name(docs.columns, f"_{c}") for c in ROW]
    stays = _grouped(docs, id_col, text_col).filter((F.col("doc") == F.col("component")) & (F.col("doc") != HIGHEST))
    stays = stays.select(*[F.col(c).alias(name) for c, name in zip(ROW, names, strict=True)]).distinct()
    same = [value == F.col(name) for value, name in zip(_row(id_col, text_col), names, strict=True)]
    return docs.join(stays, same, "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
