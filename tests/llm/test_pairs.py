"""N-gram join, suffix dedup and line dedup against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import line_dedup, ngram_join, suffix_dedup
from leafmill.llm.components import components

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(rnd, n=60):
    """Clusters whose members drift, so that some link only through others; and rows of their own."""
    rows = []
    for c in range(4):
        words = [f"c{c}w{rnd.randrange(300)}" for _ in range(rnd.choice([8, 60, 120]))]
        for _ in range(n // 4):
            words = list(words)
            if rnd.random() < 0.7:
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(9999)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(55))
    rows += [(1000 + i, f"{' '.join(f'u{i}_{j}' for j in range(i % 30))} {passage}") for i in range(60)]
    return rows


AWKWARD = [(5, None), (6, ""), (7, " \t"), (8, "One"), (9, "one"), (9, "one"), (10, "one two"), (11, "É x"), (12, "é x"), (13, "a\x1cb c\u00a0d"), (14, "x " * 3000)]


def brute_groups(rows):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("seed,block,common", [(1, 1024, 32), (2, 8, 4)])
def test_ngram_join(docs, monkeypatch, seed, block, common):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "TREE_SETS", block)
    rows = near_copies(random.Random(seed)) + [(5000 + d, t) for d, t in AWKWARD]
    got = ngram_join.grouped(docs(rows)).collect()
    want = brute_groups(rows)
    assert Counter((r.doc_id, (r.n_shingles, r.component_id)) for r in got) == Counter((d, want[d]) for d, _ in rows)


def test_ngram_join_of_nulls_and_nothing(docs):
    got = {r.doc_id: r.component_id for r in ngram_join.grouped(docs([(None, "a b"), (4, "a b"), (3, None)])).collect()}
    assert got == {None: 4, 4: 4, 3: 3}
    assert ngram_join.grouped(docs([])).count() == 0
    kept = ngram_join.one_of_each(docs([(1, "q r s"), (2, "Q r  s"), (3, ""), (None, "z")]).withColumn("n", F.lit(1)))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]


def test_ngram_join_of_ids_with_several_texts(docs):
    """Rows of one id, or of none, are told apart by their texts."""
    rnd = random.Random(11)
    text = lambda tag: [f"{tag}{rnd.randrange(10**6)}" for _ in range(60)]
    rows, want = [], []
    for c in range(6):
        first, other = text(f"a{c}_"), text(f"b{c}_")
        copy, also = [*first[:-1], "end"], [*other[:-1], "end"]
        own = 100 * c
        for i, words, component in ((own + 9, first, own + 3), (own + 9, other, own + 9), (own + 3, copy, own + 3), (own + 11, also, own + 9)):
            rows.append((i, " ".join(words)))
            want.append((i, 56, component))
        lone = text(f"n{c}_")
        for i, words, component in ((None, lone, own + 50), (None, text(f"m{c}_"), None), (own + 50, [*lone[:-1], "end"], own + 50)):
            rows.append((i, " ".join(words)))
            want.append((i, 56, component))
    rows += rows[:7]
    want += want[:7]
    got = ngram_join.grouped(docs(rows)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(docs(rows)).collect())
    assert kept == Counter(r for r, w in zip(rows, want, strict=True) if r[0] is None or r[0] == w[2])


def test_tree_finds_the_same_as_all_pairs():
    rnd = random.Random(4)
    base = sorted(rnd.sample(range(10_000), 40))
    sets = []
    for _ in range(200):
        own = set(base)
        for _ in range(rnd.randrange(12)):
            own.discard(rnd.choice(base))
            own.add(rnd.randrange(10_000))
        sets.append(np.array(sorted(own), np.uint64))
    tree = ngram_join.Tree(sets)
    for probe in sets[:40]:
        want = [i for i, s in enumerate(sets) if ngram_join.linked(len(np.intersect1d(s, probe)), len(s), len(probe))]
        assert sorted(tree.links(probe)) == want


def test_shingle_sizes_follow_the_rule():
    texts = [t for _, t in AWKWARD] + ["a b c d e f a b c d e", "\x0b\x0ca\rb\x1fc  D"]
    assert [len(s) for s in ngram_join.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_portions_change_nothing(monkeypatch):
    monkeypatch.setattr(ngram_join, "PORTION", 40)
    texts = pa.array([t for _, t in AWKWARD] * 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["doc", "text"])
    parts = list(ngram_join.portions([batch, batch.slice(4, 9)]))
    got = [len(s) for p in parts for s in ngram_join.shingle_sets(p.column(1))]
    whole = [len(shingles(t)) for t in texts.to_pylist()]
    assert len(parts) > 5 and got == whole + whole[4:13]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (101, 50), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 100: 50, 101: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_bytes(rows):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        spans = len([m for m in re.finditer(b"\x01+", gone.tobytes())])
        out[d] = (len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("at_once", [1 << 21, 150])
def test_suffix_dedup(spark, docs, monkeypatch, at_once):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(2, 7)))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join([word() for _ in range(rnd.randrange(60))] + [passage] * rnd.randrange(3) + [word() for _ in range(9)])) for i in range(20)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (60, "z" * 99), (61, "z" * 100), (62, "z" * 101), (63, "z" * 260), (64, None), (65, ""), (None, rows[4][1]), (50, rows[3][1])]
    given = docs(rows).repartition(3).withColumn("kept", F.lit(0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = suffix_dedup.deduplicated(given).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    want = brute_bytes(rows)
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == Counter((d, want[d]) for d, _ in rows)
    assert suffix_dedup.deduplicated(docs([])).count() == 0


def brute_lines(rows):
    held = {}
    for n, (d, t) in enumerate(rows):
        for key in {lower(x.strip(BLANKS)) for x in (t or "").split("\n")}:
            if len(key) >= 20:
                held.setdefault(key, []).append((d is not None, d or 0, n))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        surplus = lambda x: len(held.get(x, [])) >= 3 and max(held[x])[:2] > (d is not None, d or 0)  # noqa: E731, B023
        kept = [x for x in lines if not surplus(lower(x.strip(BLANKS)))]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_line_dedup(docs):
    rnd = random.Random(6)
    pool = [f"Line number {i} of the common pool" for i in range(12)] + ["short", "", "  LINE number 3 of the common pool\t", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "é" * 20, "x" * 19]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(8)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, pool[0] + "\n" + pool[1]), rows[2], (70, "\n\n"), (71, pool[0] + "\r\n" + pool[0])]
    given = docs(rows).withColumn("n_lines", F.lit("old")).withColumn("doc", F.lit(1))
    got = line_dedup.deduplicated(given)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.deduplicated(docs([])).count() == 0


def test_line_dedup_of_many_rows_without_ids(docs):
    """Rows without an id, or all of one id, do not share one list; repeated rows do."""
    rnd = random.Random(7)
    pool = [f"Line number {i} of the large common pool" for i in range(3000)]
    for own in (None, 7):
        rows = [(own, "\n".join([f"a line that only row {i} has, once", *rnd.sample(pool, 20)])) for i in range(5000)]
        rows += [rows[0]] * 50 + [(8, pool[0] + "\n" + pool[1])]
        got = line_dedup.deduplicated(docs(rows).repartition(4)).collect()
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == brute_lines(rows)


def test_a_batch_is_judged_by_the_runs_before_it(spark, docs):
    """Hits and new keys by batch, larger ids first, whatever the spread of ids."""
    rows = [(i * i * i, f"the line that everybody holds\nthe line of ids {i // 4} and such") for i in range(24)]
    keys = line_dedup.line_keys(docs(rows), "doc_id", "text", 20).withColumn("batch", line_dedup.batch_of(docs(rows), "doc_id", 3))
    sizes = {r.batch: (r.low, r.high, r.n) for r in keys.groupBy("batch").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.countDistinct("doc").alias("n")).collect()}
    assert sorted(sizes) == [0, 1, 2] and sizes[0][0] > sizes[1][1] and sizes[1][0] > sizes[2][1]
    assert all(7 <= n <= 9 for _, _, n in sizes.values())
    runs = line_dedup.Runs(spark)
    for batch in range(3):
        runs.add(keys.filter(F.col("batch") == batch))
    common = runs.repeated(24).collect()
    assert [(r.n, r["last"], sorted((f.batch, f.seen) for f in r.found)) for r in common] == [(24, 23**3, [(0, False), (1, True), (2, True)])]


def test_runs_are_compacted_by_level(spark, docs):
    runs = line_dedup.Runs(spark, fanout=2)
    for batch in range(5):
        rows = docs([(batch, f"a line that all batches hold\nthe line of batch {batch} alone")])
        runs.add(line_dedup.line_keys(rows, "doc_id", "text", 20))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [(r.n, r["last"]) for r in runs.repeated(2).collect()] == [(5, 4)]


def test_suffix_dedup_tells_rows_without_ids_apart(spark, docs):
    """Texts without an id (or of one id) whose 32-bit hashes agree keep their own runs."""
    many = spark.range(300_000).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 2 + F.col("id").cast("int") % 5).alias("text"))
    twins = many.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").collect()
    assert twins
    for own in (None, 7):
        rows = [(own, t) for r in twins for t in r.t]
        got = Counter((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.deduplicated(docs(rows)).collect())
        # A digest repeated k times repeats each of its windows from the second period on.
        want = Counter((len(t), max(0, len(t) - 64) if len(t) >= 164 else 0, int(len(t) >= 164)) for _, t in rows)
        assert got == want
