"""Fingerprints, neighbours and likenesses recomputed in plain Python."""

import random
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import fingerprint

BLANKS = " \t\n\x0b\x0c\r"
ALONE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
ENDS = regex.compile(r"[aeiouAEIOU0-9\p{M}\p{P}\p{S}]")


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def hash_text(text):
    return signed(xxhash.xxh64(text.encode(), seed=42).intdigest())


def hash_numbers(numbers):
    """Spark's hash of several columns: each one's hash is the next one's seed."""
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64((n % (1 << 64)).to_bytes(8, "little"), seed=seed).intdigest()
    return signed(seed)


def hash_texts(texts):
    seed = 42
    for t in texts:
        seed = xxhash.xxh64(t.encode(), seed=seed).intdigest()
    return signed(seed)


def pieces(text):
    for word in regex.split(f"[{BLANKS}]+", text):
        if len(word) <= fingerprint.PIECE:
            yield from [word] if word else []
            continue
        held = ""
        for c in word:
            if ALONE.match(c):
                yield from [held] if held else []
                yield c
                held = ""
                continue
            held += c
            if ENDS.match(c) or len(held) == fingerprint.PIECE:
                yield held
                held = ""
        yield from [held] if held else []


def anchors(text, sketch):
    words = list(pieces(text))
    h = [hash_text(w) for w in words]
    k, n = fingerprint.KMER, fingerprint.KMER - fingerprint.INNER + 1
    inner = [hash_numbers(h[i : i + 2]) for i in range(len(h) - 1)]
    found = []
    for i in range(len(h) - k + 1):
        here = inner[i : i + n]
        if min(here) in (here[0], here[-1]):
            found.append((hash_numbers(h[i : i + k]) & 0x7FFFFFFF, i + 1))
    if not found and words:
        found = [(hash_texts(words) & 0x7FFFFFFF, 1)]
    first = {}
    for value, place in sorted(found):
        first.setdefault(value, place)
    return sorted(first.items())[:sketch]


def likeness(a, b, sketch):
    a, b = dict(a), dict(b)
    both = sorted({*a, *b})[:sketch]
    if not both:
        return 1.0
    shift = sorted(a[x] - b[x] for x in both if x in a and x in b)
    return sum(abs(s - shift[len(shift) // 2]) <= fingerprint.SLACK for s in shift) / len(both)


def made(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["w%d" % rnd.randrange(300), "日本語" * 9, "x" * 40, "aGVsbG8gd29ybGQhISE/", "q" + "Zz9" * 8, "ภาษาไทยไม่มีช่องว่าง"]) if i % 7 == 0 else "w%d" % rnd.randrange(300) for i in range(n))


@pytest.mark.parametrize("sketch", [fingerprint.SKETCH, None])
def test_whole_result_equals_plain_python(docs, sketch):
    rnd = random.Random(4)
    rows = [(i * 3, made(i, rnd.randrange(0, 500))) for i in range(30)]
    rows += [(1000 + i, rows[i][1].replace("w7", "v7", 3)) for i in range(5)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b c d e"), (10**17, made(99, 50)), (-5, made(98, 300))]
    got = {r.doc_id: r for r in fingerprint.compared(docs(rows), sketch=sketch, range_rows=7).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        mine, other, after = (anchors(x, sketch) for x in (t, edited, following))
        assert got[i].edited == edited
        assert [(x >> 32, x & 0xFFFFFFFF) for x in got[i].fp] == mine
        assert [(x >> 32, x & 0xFFFFFFFF) for x in got[i].edited_fp] == other
        assert got[i].near_edited == pytest.approx(likeness(mine, other, sketch))
        assert got[i].near_next == pytest.approx(likeness(mine, after, sketch))


def test_an_insertion_leaves_unspaced_texts_alike(docs):
    rnd = random.Random(5)
    chinese = "".join(chr(0x4E00 + rnd.randrange(2000)) for _ in range(3000))
    encoded = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    rows = [(1, chinese), (2, "新" + chinese), (3, encoded), (4, "B" + encoded)]
    fps = {r.doc_id: r.fp for r in fingerprint.with_fingerprint(docs(rows), "text", "fp").collect()}
    pairs = docs([(0, "")]).select(*[F.array(*[F.lit(x) for x in fps[i]]).alias(f"f{i}") for i in fps])
    got = fingerprint.with_likeness(fingerprint.with_likeness(pairs, "f1", "f2", "a"), "f3", "f4", "b").first()
    assert got.a > 0.9 and got.b > 0.9


def test_the_sketch_is_near_the_exact_likeness(docs):
    rows = [(i, made(i % 20, 400).replace("w1", "u1", i)) for i in range(60)]
    least, exact = ({r.doc_id: (r.near_edited, r.near_next) for r in fingerprint.compared(docs(rows), sketch=s).collect()} for s in (fingerprint.SKETCH, None))
    off = [abs(a - b) for i in exact for a, b in zip(least[i], exact[i], strict=True)]
    assert sum(off) / len(off) < 0.06 and max(off) < 0.3


@pytest.mark.parametrize("how", ["outlier", "clusters", "one id", "no id"])
def test_ranges_stay_small_whatever_the_ids(docs, how):
    ids = {"outlier": [*range(999), 1 << 62], "clusters": [c << 40 | i for c in range(4) for i in range(250)], "one id": [7] * 700 + [*range(300)], "no id": [None] * 1000}[how]
    given = docs([(i, f"text {n}") for n, i in enumerate(ids)])
    ranged = fingerprint.with_range(given, 50).collect()
    assert max(Counter(r._range for r in ranged).values()) <= 120
    order = sorted(ranged, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r._hash))
    assert [r._range for r in order] == sorted(r._range for r in order)
    got = fingerprint.compared(given, range_rows=50).collect()
    order.reverse()
    want = Counter()
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        half = len(a.text) // 2
        want[(a.doc_id, a.text[: len(a.text) - half] + b.text[:half])] += 1
    assert Counter((r.doc_id, r.edited) for r in got) == want
