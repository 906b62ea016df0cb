"""Importance resampling against a plain count of features."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import importance


def words(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def buckets(text, longest):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest):
    own = [buckets(t, longest) for _, t in rows]
    s, t = Counter(b for o in own for b in o), Counter(b for x in target for b in buckets(x, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for (i, text), o in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in o) // len(o) if o else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(o), weight, score, None, len(words(text))])
    able = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    for rank, o in enumerate(able[: len(able) * 10 // 100], 1):
        o[4] = rank
    return Counter(tuple(o[:5]) for o in out)


def corpus(seed, count):
    rnd = random.Random(seed)
    known = ["the", "The", "cat", "naïve", "日本語", "x1", "a", "ab", "abc", "é", "zebra's", "Zoo", "123", "foo_bar"]
    rows = []
    for i in range(count):
        own = [rnd.choice(known) if rnd.random() < 0.8 else f"w{rnd.randrange(500)}" for _ in range(rnd.choice([0, 1, 19, 20, 21, 60, 400]))]
        rows.append((i, "".join(w + rnd.choice([" ", ", ", "\n", "--", "\x00", " \x7f"]) for w in own)))
    return rows


@pytest.mark.parametrize(("longest", "portion", "most"), [(1, 2 << 20, 1 << 17), (2, 500, 20), (3, 2 << 20, 0)])
def test_against_plain_counts(spark, docs, monkeypatch, longest, portion, most):
    monkeypatch.setattr(importance, "PORTION", portion)
    monkeypatch.setattr(importance, "MOST_WORDS", most)
    rows = corpus(1, 300) + [(None, t) for _, t in corpus(2, 40)] + corpus(1, 20) + [(400, None), (401, ""), (402, "...")]
    target = [t for _, t in corpus(3, 10)] + [None, ""]
    given = docs(rows).withColumn("weight", F.lit("x")).withColumn("doc", F.lit(1))
    got = importance.resampled(given, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, target, longest)


def test_nothing(docs):
    none = docs([])
    assert importance.resampled(none, none).count() == 0
    rows = [(i, "a b c d e " * 5) for i in range(30)]
    assert Counter(map(tuple, importance.resampled(docs(rows), none).collect())) == brute(rows, [], 1)


def test_ranks_of_hot_ties_are_spread(spark, monkeypatch):
    """One score for all rows: ranges split it, ranks are whole."""
    monkeypatch.setattr(importance, "RANGE_ROWS", 100)
    rows = spark.range(5000).select(F.lit(1).alias("score"), F.col("id").alias("row"))
    got = importance.ranked(rows, [F.desc("score"), F.col("row")], "ranks").collect()
    assert all(r["rank"] == r["row"] + 1 for r in got) and len(got) == 5000


def test_crcs_are_composed():
    rnd = random.Random(4)
    left, right = [[rnd.randbytes(rnd.choice([0, 1, 7, 300, 70_000])) for _ in range(60)] for _ in range(2)]
    crc = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint64)
    got = importance.joined(crc(left), crc(right), np.array([len(r) for r in right]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right, strict=True)]


def test_dictionary_only_saves_work():
    text = b" the cat  the  catalogue cat the "
    plain = importance.Dictionary([]).payloads(text)
    for known in ([b"the"], [b"cat", b"catalogue", b"at"], [b"the", b"cat", b"catalogue"]):
        for a, b in zip(importance.Dictionary(known).payloads(text), plain, strict=True):
            assert a.tolist() == b.tolist()
