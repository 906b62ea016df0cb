"""Hard negatives against brute force over all rows."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, each=50):
    usable = []
    for own, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        usable.append((own, [int(np.floor(256 * float(np.float32(x)))) for x in vector], label))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (a, q, label) in enumerate(usable):
        if a is None or a % each:
            continue
        scored = [(sum(x * y for x, y in zip(q, r, strict=True)), i, k == label) for m, (i, r, k) in enumerate(usable) if m != n and len(r) == len(q)]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=key)[:5]:
            window = sorted((s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=key)[:3]
            out += [(a, pid, k, nid, p, s) for k, (s, nid, _) in enumerate(window, 1)]
    return Counter(out)


def made(count, dim, seed, labels=4, spread=0.5):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, dim))
    label = rnd.integers(0, labels, count)
    vectors = (centres[label] * spread + rnd.normal(size=(count, dim)) * 0.4 + 0.2).astype(np.float32)
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, label, strict=True))]


def got(spark, rows, each=50):
    return Counter(map(tuple, hn.mined(spark.createDataFrame(rows, KIND), F.col("vec_id") % each == 0).collect()))


@pytest.mark.parametrize("dim", [3, 16])
def test_against_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 32)
    monkeypatch.setattr(hn, "GROUP", 3)
    monkeypatch.setattr(hn, "BUCKET", 4)
    monkeypatch.setattr(hn, "UNIT", 2)
    rows = made(900, dim, 1)
    want = brute(rows, 20)
    assert got(spark, rows, 20) == want and sum(want.values()) > 100


def test_ties_repeats_nulls_and_lengths(spark, monkeypatch):
    """Equal vectors, repeated rows, null ids, labels, vectors and components, other lengths, and a hot vector."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    rnd = random.Random(5)
    rows = made(200, 4, 2)
    rows += [(300 + i, [0.5, 0.25, 0.0, 1.0], i % 3) for i in range(100)]  # one vector, a third of all rows
    rows += rows[:30] + [(None, v, k) for _, v, k in rows[30:60]]
    rows += [(1000, None, 1), (1050, [0.1, None, 0.2, 0.3], 1), (1100, [0.1, float("nan"), 0.0, 0.1], 2), (1150, [float("inf")] * 4, 2), (1200, [0.5] * 4, None)]
    rows += [(50 * i, [rnd.random() for _ in range(2)], i % 2) for i in range(30, 50)] + [(5000, [], 1)]
    want = brute([r for r in rows if r[1] != []], 50)
    assert got(spark, rows) == want and sum(want.values()) > 50


def test_nothing(spark):
    assert not got(spark, []) and not got(spark, [(None, None, None), (0, [1.0], 1)])
    extra = spark.createDataFrame(made(60, 3, 4), KIND).withColumn("score", F.lit(1)).withColumn("block", F.lit("x"))
    assert Counter(map(tuple, hn.mined(extra, F.col("vec_id") % 5 == 0).collect())) == brute(made(60, 3, 4), 5)


def test_curve_steps_to_a_neighbour():
    """Successive places of the curve are neighbouring cells, and every cell has its own."""
    for dim, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)))
        keys = hn.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_are_reached():
    rnd = np.random.default_rng(6)
    vectors, rows = rnd.integers(-99, 99, (7, 5)), rnd.integers(-99, 99, (40, 5))
    least, most = hn.bounds(vectors, rows.min(0)[None], rows.max(0)[None])
    scores = vectors @ rows.T
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    least, most = hn.bounds(vectors, rows, rows)  # blocks of one row
    assert (np.rint(least) == scores).all() and (np.rint(most) == scores).all()


def test_only_chosen_blocks_are_read(spark, monkeypatch):
    """Directions in few dimensions: bounds rule out most blocks, and the result stays whole."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist(), k) for i, v, k in made(2400, 3, 7, labels=2, spread=0.3)]
    zones, asked = [], []
    reads, searched = hn.reads, hn.searched
    bits = F.aggregate(F.sequence(F.lit(1), F.length("mask")), F.lit(0).cast("long"), lambda s, i: s + F.bit_count(F.conv(F.hex(F.substring(F.col("mask"), i, F.lit(1))), 16, 10).cast("long")))
    monkeypatch.setattr(hn, "reads", lambda p, z, same: zones.append(z.count()) or reads(p, z, same))
    monkeypatch.setattr(hn, "searched", lambda p, pairs, s, same: asked.append(pairs.agg(F.sum(bits)).first()[0]) or searched(p, pairs, s, same))
    assert got(spark, rows, 50) == brute(rows, 50)
    blocks, anchors = zones[0], 48
    assert blocks >= 150
    # Of each label half of all blocks: without bounds either search would read all of them.
    assert asked[0] < 0.25 * blocks * anchors / 2 and asked[1] < 0.8 * blocks * anchors / 2
