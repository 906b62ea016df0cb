"""Exact dedup, mixing, URL filter and fingerprints against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, fingerprint, mixing, url_filter

AWKWARD = [
    (1, "a b  c"), (2, "a b c"), (3, None), (4, ""), (5, " \t\n"), (6, " "), (7, "x" * 9000 + " é"), (8, "x" * 9000 + "\n\né"),
    (9, "A b c"), (2, "a b c"), (None, "a b c"), (10, "日本語。" * 700), (11, "日本語。" * 700), (None, None),
]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    how = {"chunk_hash": lambda c: (F.length(c) % 3).cast("long")} if weak else {}
    got = exact_dedup.classify(docs(AWKWARD), **how).collect()
    groups = defaultdict(list)
    for i, t in AWKWARD:
        groups[normal(t)].append(i)
    want = Counter()
    for i, t in AWKWARD:
        keep = min((x for x in groups[normal(t)] if x is not None), default=None)
        want[(i, keep, len(groups[normal(t)]), i == keep, hashlib.sha256(normal(t).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_distinct_documents_keeps_one_row_and_all_columns(docs):
    given = docs(AWKWARD).withColumn("kept", F.lit("mine"))
    got = exact_dedup.distinct_documents(given)
    assert got.columns == given.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 7, 9, 10]
    assert exact_dedup.distinct_documents(docs([])).count() == 0


def test_chunks_join_to_the_text(docs):
    rows = [(i, normal(t)) for i, t in AWKWARD]
    joined = docs(rows).select("text", F.array_join(exact_dedup.chunks(F.col("text"), 8, 32), "").alias("again"))
    assert all(r.text == r.again for r in joined.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutation_is_one(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x"))
    assert sorted(r.x for r in rows.collect()) == list(range(n))


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(docs):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 40, 300, 900])), "en", rnd.choice(["a"] * 9 + ["b", "c", "é", None])) for i in range(300)]
    rows += [(900, None, None, "a"), (901, "one two", None, "lone"), rows[5], rows[5], (None, "x y z", None, "a")]
    got = mixing.taken_words(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, source = targets(sizes), {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * mixing.BLOCK_WORDS
    again = mixing.taken_words(docs(rows)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.taken_words(docs([])).count() == 0


def test_small_sources_meet_their_targets(docs):
    sizes = {"big": 40_000, "one": 1, "ten": 10, "twenty": 20, "just": 64, "more": 65, "some": 130, "empty": 0}
    rows = [(i, "w " * n, "en", s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.doc_id: r for r in mixing.taken_words(docs(rows)).collect()}
    want = targets(sizes)
    mixed = Counter()
    for r in mixing.mixed_documents(docs(rows)).collect():
        mixed[r.source] += len(r.text.split())
    for i, (s, n) in enumerate(sizes.items()):
        assert got[i].taken == mixed[s]
        assert abs(got[i].taken - want[s]) <= 0.01 * want[s]
        assert s == "big" or want[s] == got[i].taken == 3 * n


def test_mixed_documents_take_what_the_plan_says(docs):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(150 + i)), "en", "a" if i % 4 else None) for i in range(24)] + [(50, None, None, "a")]
    plan = {r.doc_id: r.taken for r in mixing.taken_words(docs(rows), block=16).collect()}
    words = Counter()
    for r in mixing.mixed_documents(docs(rows), block=16).collect():
        assert set(r.text.split()) <= set(rows[r.doc_id][1].split()) and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({d: n for d, n in plan.items() if n})


def test_shard_counts_meet_every_quota(docs, spark):
    rows = [(i, "w " * 500, "en", "abc"[i % 3]) for i in range(60)]
    sizes = docs(rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.planned(sizes).cache()
    slots = mixing.drawn_slots(plan, shard_slots=32)
    assert slots.select("shard", "place").distinct().count() == slots.count()
    counts = mixing.shard_counts(slots).groupBy("source_no").agg(F.sum("slots").alias("n"))
    assert {r.source_no: r.n for r in counts.collect()} == {r.source_no: r.quota for r in plan.collect()}


def test_the_draw_decides_the_mix(docs):
    """Taken words, first shards and blocks recomputed in plain Python from the slots; every slot is filled once."""
    rnd = random.Random(11)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rnd.choice([0, 5, 70, 200]))), "en", rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(80)]
    given = docs(rows).withColumn("pass", F.lit("old")).withColumn("start", F.lit(1))
    sizes = given.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.planned(sizes, block=16).cache()
    slots = mixing.drawn_slots(plan, shard_slots=32).collect()
    names = {r.source_no: r.source for r in plan.collect()}
    counts = {(r.shard, r.source_no): r.slots for r in mixing.drawn_counts(plan, shard_slots=32).collect()}
    assert Counter((r.shard, r.source_no) for r in slots) == counts
    assert len({r.shard for r in slots}) > 3 and len({n for (s, k), n in counts.items() if k == 0}) > 2
    for shard in {r.shard for r in slots}:
        places = sorted(r.place for r in slots if r.shard == shard)
        assert places == list(range(len(places))) and len(places) <= 32
    assert len({(r.source_no, r["index"], r["pass"]) for r in slots}) == len(slots)
    words = {k: [(d, w) for d, t, _, s in rows if s == name for w in (t or "").split()] for k, name in names.items()}
    taken, first, blocks = Counter(), {}, {}
    for r in slots:
        part = words[r.source_no][16 * r["index"] : 16 * r["index"] + 16]
        blocks[r.shard, r.place] = (names[r.source_no], " ".join(w for _, w in part))
        for d, _ in part:
            taken[d] += 1
            first[d] = min(first.get(d, r.shard), r.shard)
    got = mixing.taken_words(given, block=16, shard_slots=32).collect()
    assert {r.doc_id: (r.taken, r.first_shard) for r in got} == {d: (taken[d], first.get(d)) for d, *_ in rows}
    shards = mixing.mixed_shards(given, block=16, shard_slots=32).collect()
    assert {(r.shard, r.place): (r.source, r.text) for r in shards} == blocks and len(shards) == len(slots)
    mixed = mixing.mixed_documents(given, block=16, shard_slots=32)
    assert mixed.columns == given.columns and sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())


def test_rows_of_one_id_are_mixed_alike_on_a_rerun(docs):
    rows = [(own, " ".join(f"w{own}_{i}_{j}" for j in range(40 + i % 3)), "en", "ab"[i % 5 == 0]) for i in range(300) for own in (7, None)]
    one, two = (Counter(map(tuple, mixing.mixed_documents(docs(rows).repartition(n), block=16).collect())) for n in (2, 7))
    assert one == two and sum(len(t[1].split()) for t in one.elements())


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://a.b.ORG/x", "http://example.org/es/", "http://example.org/es", "http://x.example.org/en/17?q",
    "http://notexample.org/es/1", "https://q.com/fr/1#x", "https://q.com/de/1", "https://q.com?fr/", "a://b://org/", "http://org:80/", "http://spam-farm.net/", "http://org/\n/x",
    "http://example.org/EN/1", "http://Éxample.org/es/", "http://spam-farm.org/",
]


def test_url_filter(spark):
    sites = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    rows = [(i % 7 or None, u) for i, u in enumerate(URLS * 2)]
    given = spark.createDataFrame(rows, "page_id long, url string").withColumn("u", F.lit(1)).withColumn("host", F.lit("old"))
    rules = [url_filter.site_rule(v, s) for v, s in sites] + [url_filter.word_rule("block", "spam-farm")]
    got = url_filter.judged(given, rules)
    assert set(got.columns) == {"page_id", "url", "u", "host", "path", "rule", "verdict"}
    want = Counter()
    for page, url in rows:
        rest = (url or "").partition("://")[2]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = []
        for verdict, site in sites:
            name, slash, start = site.partition("/")
            if (host == name or host.endswith("." + name)) and ("/" + start == "/" or path.startswith("/" + start)):
                fits.append((len(site), site, verdict))
        rule, verdict = max(fits)[1:] if fits else (None, "block" if "spam-farm" in host.split(".") else "allow")
        want[(page, host, path, rule, verdict)] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    assert url_filter.judged(given.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.rule_table(spark, [url_filter.Rule("x", "block", ".*", (), 1)])


def test_urls_of_very_many_segments(spark):
    """Token rows are slim: the work follows a URL's length, not its square."""
    long = "https://a.example.org/es/" + "/".join(f"s{i}" for i in range(50_000))
    given = spark.createDataFrame([(1, long), (2, long + "?q"), (3, long.replace("/es/", "/fr/")), (4, None)], "page_id long, url string")
    rules = [url_filter.site_rule("block", "example.org/es/"), url_filter.site_rule("allow", "org/"), url_filter.word_rule("block", "s7")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(given, rules).select("page_id", "rule", "verdict").collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("example.org/es/", "block"), 3: ("org/", "allow"), 4: (None, "allow")}


def test_fingerprints(docs):
    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randrange(500)}" for _ in range(400))
    rows = [(5, text), (9, text), (3, None), (4, ""), (8, "é" * 11), (7, "one two three"), (2, text.replace("w77 ", "zz ")), (None, "last"), (9, text), (1, "日本" * 9000)]
    got = fingerprint.compared(docs(rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    edited = Counter()
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited[(i, len(t), t[: len(t) - half] + following[:half])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited) for r in got) == edited
    by = {r.doc_id: r for r in got}
    assert by[5].fp == by[9].fp and by[3].fp == by[4].fp == [] and len(by[7].fp) == 1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert by[4].near_next == 1.0 and by[5].near_next == 0.0
    assert fingerprint.compared(docs([])).count() == 0
    alone = fingerprint.compared(docs([(1, "a b c d e f")])).first()
    assert alone.edited == "a b c a b c"


def test_anchors_are_closed_syncmers_and_ignore_what_is_around(docs):
    rnd = random.Random(2)
    core = " ".join(f"c{rnd.randrange(900)}" for _ in range(60))
    got = fingerprint.with_fingerprint(docs([(1, core), (2, "left part here " + core + " right")]), "text", "fp").orderBy("doc_id").collect()
    inside, around = ({(x >> 32, x & 0xFFFFFFFF) for x in r.fp} for r in got)
    assert {(h, p + 3) for h, p in inside} <= around
    assert 10 < len(inside) < 50


def test_every_text_with_words_has_an_anchor(docs):
    """Texts of five or six words may have no syncmer at all."""
    rows = [(100 * n + i, " ".join(f"v{n}_{i}_{j}" for j in range(n))) for n in range(1, 9) for i in range(24)]
    got = fingerprint.compared(docs(rows)).collect()
    assert len(got) == len(rows) and all(r.fp for r in got)
    assert len({tuple(r.fp) for r in got}) == len(rows)
    assert all(r.near_next == 0.0 for r in got)


def test_a_mixed_document_is_split_into_words_once(docs):
    """Not once for each of its spans: the time of a document grew with the square of its length."""
    given = docs([(i, "some word " * 400, "en", f"s{i % 2}") for i in range(2)])
    for made in (mixing.mixed_documents(given), mixing.mixed_shards(given)):
        shown = made._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all(" in shown and "slice(regexp_extract_all(" not in shown
