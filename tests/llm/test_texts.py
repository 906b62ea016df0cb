"""WARC, language ID, BPE and the pipeline: round trips, held-out accuracy, brute force."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import bpe, language, mixing, queries, warc
from leafmill.session import scratch
from tests.llm.test_pairs import brute_groups

PAGES = [
    (1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "http://d/", ""), (None, "http://e/", "x"),
    (6, "http://f/", "x"), (7, "http://g/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\x1f\x08" * 50), (8, "http://h/", "y" * 300_000), (8, "http://h/", "y" * 300_000),
]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("keeper", F.lit("mine"))


@pytest.mark.parametrize("range_bytes", [64, 1000, 32 << 20])
def test_warc_round_trip(pages, range_bytes):
    files = warc.write_archives(pages)
    got = warc.read_archives(files.select("file", "length"), range_bytes).collect()
    keeper = {}
    for i, _, h in PAGES:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        first = i is None or i == keeper[h or ""]
        if i is None:
            first = False
        want[(f"{warc.NAME}{'' if i is None else i}", "response" if first else "revisit", None if first else f"{warc.NAME}{keeper[h or '']}", len(raw), warc.payload_digest(raw))] += 1
    assert Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == want
    bodies = {r.record_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert bodies[f"{warc.NAME}8"] == b"y" * 300_000
    urls = {r.record_id: r.target_uri for r in got}
    assert urls[f"{warc.NAME}2"] == "http://b/%0D%0AX: y" and urls[f"{warc.NAME}3"] is None


@pytest.mark.parametrize("range_bytes", [5000, 32 << 20])
def test_warc_headers_have_no_longest(spark, range_bytes):
    rnd = random.Random(9)
    urls = ["http://a/" + "x" * (2 << 20), "http://b/" + "\t" * 400_000, "http://c/" + rnd.randbytes(1 << 20).hex(), "http://d/"]
    rows = [(i, u, f"body {i}") for i, u in enumerate(urls)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    got = warc.read_archives(files.select("file", "length"), range_bytes).collect()
    assert {r.record_id: r.target_uri for r in got} == {f"{warc.NAME}{i}": u.replace("\t", "%09") for i, u in enumerate(urls)}
    assert len(got) == len(rows)


def test_small_payloads_are_never_revisits(pages):
    files = warc.write_archives(pages, least=9)
    got = warc.read_archives(files.select("file", "length")).collect()
    assert Counter(r.record_type for r in got if r.payload_bytes < 9) == Counter(response=4)


def test_warc_of_nothing(pages):
    files = warc.write_archives(pages.limit(0))
    assert files.count() == 0 and warc.read_archives(files.select("file", "length")).count() == 0


def test_archive_inside_an_archive(spark, tmp_path):
    """Members stored in a payload look like members; the record around them rules them out."""
    rnd = random.Random(1)
    inner = b"".join(gzip.compress(warc.record(100 + i, "http://in/", rnd.randbytes(3000), None, False)) for i in range(30))
    outer = [gzip.compress(warc.record(1, "http://out/", inner, None, False), 0), gzip.compress(warc.record(2, "http://out/", b"plain", None, False))]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(outer))
    got = warc.read_archives(warc.listed(spark, str(tmp_path)), 8192).collect()
    assert sorted(r.record_id for r in got) == [f"{warc.NAME}1", f"{warc.NAME}2"]


def test_cut_archive_inside_an_archive(spark, tmp_path):
    """A find inside a record whose header decodes, but whose body is cut off, is no member and no error."""
    inner = gzip.compress(warc.record(100, "http://in/", random.Random(1).randbytes(60_000), None, False))[:-2000]
    outer = [gzip.compress(warc.record(i, "http://out/", random.Random(i).randbytes(9000) + inner, None, False), 0) for i in (1, 2)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(outer))
    got = warc.read_archives(warc.listed(spark, str(tmp_path)), 4096).collect()
    assert sorted(r.record_id for r in got) == [f"{warc.NAME}1", f"{warc.NAME}2"]


def test_ranges_are_spread_over_tasks(spark, pages, monkeypatch):
    """As many reading tasks as ranges, though the ranges are slim rows."""
    files = warc.write_archives(pages.coalesce(1))
    size = sum(r.length for r in files.collect())
    seen = []
    real = warc.written
    monkeypatch.setattr(warc, "written", lambda df, label: seen.append(df.rdd.getNumPartitions()) or real(df, label))
    warc.read_archives(files.select("file", "length"), 200)
    assert seen == [sum(-(-r.length // 200) for r in files.collect())] and seen[0] >= size // 200 > 4


def test_cut_archive_is_an_error(spark, tmp_path):
    whole = gzip.compress(warc.record(1, "http://out/", random.Random(2).randbytes(200_000), None, False))
    (tmp_path / "x.warc.gz").write_bytes(whole[:-5000])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(warc.listed(spark, str(tmp_path))).count()


def test_bpe_is_the_rank_files_own(spark, docs):
    import tiktoken

    path, pattern = queries.ranks()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(7)
    pools = ["abcdefgh ", "aA's'll ", " \t\n\r\x0b 　", "0123456789,. ", "éñüß", "日本語한국", "🙂👍🏽‍", "<|endoftext|>"]
    texts = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(120))) for _ in range(300)]
    texts += [None, "", "<|endoftext|>", "a" * 5000, " " * 3000, "x", "x"]
    got = bpe.digests(docs(list(enumerate(texts))).withColumn("n_tokens", F.lit("old")), path, pattern).collect()
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digests(docs([]), path, pattern).count() == 0


def test_bpe_offsets_and_split_characters(docs):
    path, pattern = queries.ranks()
    text = "Häuser 👍🏽 und 漢字"
    coded = docs([(1, text), (2, None)]).select("doc_id", bpe.encoded(F.col("text"), path, pattern).alias("e"))
    coded = coded.select("doc_id", "e.ids", "e.offsets").withColumn("cut", F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))))
    back = coded.withColumns({"text": bpe.decoded_text(F.col("ids"), path, pattern), "less": bpe.decoded_text(F.col("cut"), path, pattern)})
    one, none = back.orderBy("doc_id").collect()
    assert one.text == text and len(one.ids) == len(one.offsets) and one.offsets == sorted(one.offsets) and one.offsets[0] == 0
    assert text.startswith(one.less.rstrip("�"))
    assert none.ids == [] and none.text == ""


def test_language(spark, docs):
    given = queries.table(spark, "/root/testdata/sf0.01", "documents").withColumn("held_out", language.held_out())
    model = language.fit(given.filter(~F.col("held_out")))
    found = language.identified(given.withColumn("score", F.lit("old")), model)
    held = found.filter("held_out").select("lang", "lang_pred", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert sum(r.rejected for r in held) < 0.005 * len(held)
    odd = [(1, None), (2, ""), (3, "123 %%% ..."), (4, "中文" * 40), (5, "中文" * 40), (6, "é")]
    got = {r.doc_id: r for r in language.identified(docs(odd), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected for i in (1, 2, 3, 4))
    assert got[4][-3:] == got[5][-3:] and all(0 <= r.score <= 1 for r in got.values())
    assert got[6].lang_pred != "und"
    assert language.identified(docs([]), model).count() == 0


def test_language_rejects_varied_foreign_texts_of_all_lengths(spark, docs):
    rnd = random.Random(8)
    letters = {"cyrillic": map(chr, range(0x430, 0x450)), "greek": map(chr, range(0x3B1, 0x3CA)), "han": map(chr, range(0x4E00, 0x5E00)), "random": "abcdefghijklmnopqrstuvwxyz"}
    rows = []
    for name, own in letters.items():
        own = list(own)
        for length in (200, 600, 2000, 6000, 20_000):
            for _ in range(4):
                words = ["".join(rnd.choices(own, k=rnd.randrange(2, 10))) for _ in range(length // 3)]
                rows.append((len(rows), " ".join(words)[:length], name))
    given = queries.table(spark, "/root/testdata/sf0.01", "documents").withColumn("held_out", language.held_out())
    model = language.fit(given.filter(~F.col("held_out")))
    assert all(r.rejected for r in language.identified(docs(rows), model).collect())
    clean = given.filter("held_out AND lang IS NOT NULL").select("doc_id", "text").collect()
    cut = [(r.doc_id, r.text[:n]) for r in clean for n in (200, 600, 2000, 6000, 20_000) if len(r.text) >= n]
    kept = [not r.rejected for r in language.identified(docs(cut), model).collect()]
    assert len(kept) > 300 and sum(kept) >= 0.995 * len(kept)


@pytest.mark.parametrize("id_of", [lambda i: None, lambda i: 7, lambda i: i])
def test_language_learns_from_rows_without_own_ids(docs, id_of):
    """50 English rows and 3,000 German ones, of null ids, of one id and of ids of their own."""
    english = [(id_of(i), f"the quick brown fox number {i} jumps over the lazy dog and the {i * 7} cats", "en") for i in range(50)]
    german = [(id_of(i), f"der schnelle braune Fuchs Nummer {i} springt über den faulen Hund und {i * 7} Katzen", "de") for i in range(100, 3100)]
    rows = docs(english + german + [(id_of(9), "the same row many times over, and over again", "en")] * 3000)
    model = language.fit(rows)
    assert set(model.languages) == {"de", "en"}
    asked = docs([(1, "the lazy dog and the fox"), (2, "der faule Hund und der Fuchs"), (3, None)])
    got = {r.doc_id: r.lang_pred for r in language.identified(asked, model).collect()}
    assert got == {1: "en", 2: "de", 3: "und"}


def test_language_with_nothing_to_learn(docs):
    assert language.fit(docs([])) is None
    assert language.fit(docs([(1, "words", None), (2, None, "en"), (3, "12", "en")])) is None
    got = language.identified(docs([(1, "words")]), None).first()
    assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)


def test_held_out_ids(docs):
    import zlib

    ids = [*range(50), None, -3]
    got = {r.doc_id: r.h for r in docs([(i, "") for i in ids]).select("doc_id", language.held_out().alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    given = queries.table(spark, sf, "documents")
    docs = given
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, f"test-{name}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == given.columns
    rows = given.collect()
    assert len(kept["language_id"]) >= 0.99 * len(rows)
    texts = Counter(" ".join(r.text.split()) for r in kept["language_id"])
    assert len(kept["exact_dedup"]) == len(texts)

    groups = brute_groups([(r.doc_id, r.text) for r in kept["exact_dedup"]])
    assert {r.doc_id for r in kept["ngram_join"]} == {g for _, g in groups.values()}
    size = sum(len(r.text.split()) for r in kept["ngram_join"])
    assert abs(sum(len(r.text.split()) for r in kept["mixing"]) - size) < 20 * 2 * mixing.BLOCK_WORDS
    mixed = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept["mixing"])
    assert Counter((r.doc_id, r.decoded_sha256) for r in kept["byte_bpe"]) == mixed
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == docs.columns and Counter(r.ids_sha256 for r in whole.collect()) == Counter(r.ids_sha256 for r in kept["byte_bpe"])


def test_pipeline_of_nothing_and_of_nulls(spark, docs):
    for rows in ([], [(1, None), (2, "")]):
        given = docs(rows)
        for _, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, "")
        assert given.count() == 0


def test_pieces_are_encoded_once_a_worker(monkeypatch):
    """Digests cut a text first; a piece met before costs a look-up, and a worker keeps short pieces only."""
    path, pattern = queries.ranks()
    cut, whole, known = bpe._pieces(path, pattern)
    asked = []

    class Counting:
        def encode_batch(self, pieces, **how):
            asked.extend(pieces)
            return whole.encode_batch(pieces, **how)

    monkeypatch.setattr(bpe, "_pieces", lambda *_: (cut, Counting(), known))
    known.clear()
    run = ["one two two", "two one " + "x" * 99, "", "It'ſ K'S \r\n  　 end 1٠"]
    want = [e.ids for e in bpe.tokenizer(path, pattern)[0].encode_batch(run, add_special_tokens=False)]
    assert list(bpe.ids_of(run, path, pattern)) == want == list(bpe.ids_of(run, path, pattern))
    assert asked.count(" two") == 1 and asked.count(" " + "x" * 99) == 2
    assert max(map(len, known)) <= bpe.SHORT_PIECE
