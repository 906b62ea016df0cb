"""Queries of the corpus operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    bpe, exact_dedup, fingerprint, hard_negatives, importance, language, line_dedup, mixing, ngram_join, secret_scan, suffix_dedup, url_filter, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query(
    "op7_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM n JOIN g USING (t)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(table(spark, sf_dir, "documents"))


SITES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BLOCKED_WORDS = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x"]


@query(
    "op3_url_filter",
    r"""
    WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, h, start)),
    m AS (SELECT page_id, max_by(h || start, length(h || start)) AS rule, max_by(verdict, length(h || start)) AS verdict
        FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND (start = '/' OR starts_with(path, start)) GROUP BY page_id)
    SELECT p.page_id, host, path, rule, coalesce(verdict,
        CASE WHEN regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|casino-win|free-bets|adult-x)(\.|$)') THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN m USING (page_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.site_rule(v, s) for v, s in SITES] + [url_filter.word_rule("block", w) for w in BLOCKED_WORDS]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, rules).drop("url")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.fit(docs.filter(~F.col("held_out")))
    found = language.identified(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def ranks() -> tuple[str, str]:
    """The rank file and the splitting pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *ranks())


@query(
    "op4_line_dedup",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
    k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last > doc_id) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR last = doc_id), '')) AS kept_sha256
    FROM k LEFT JOIN g USING (key) GROUP BY doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op1_warc",
    r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    g AS (SELECT t, max(page_id) AS keeper FROM p GROUP BY t),
    d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS hex, keeper FROM p JOIN g USING (t)),
    b AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        (((strpos('0123456789abcdef', substr(hex, CAST((5 * i) // 4 + 1 AS BIGINT), 1)) - 1) * 16
          + strpos('0123456789abcdef', substr(hex, CAST((5 * i) // 4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31 AS BIGINT), 1)),
        'string_agg', '') AS payload_digest FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM b
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(archives.select("file", "length"))
    number = f"^{warc.NAME}([0-9-]+)$"
    return records.select(
        F.regexp_extract("record_id", number, 1).try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.regexp_extract("refers_to", number, 1).try_cast("long").alias("refers_to"),
    )


@query(
    "op8_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
    w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS part
        FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS p FROM d)),
    again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY part ORDER BY doc_id, p) > 1),
    marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM again),
    numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
    spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, span),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
    cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
        string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_fingerprint")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compared(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.shown("fp").alias("fingerprint"), fingerprint.shown("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query(
    "op2_ngram_join",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM w),
    g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN links ON a = doc_id)
    SELECT doc_id, len(grams) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1) USING (doc_id)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(table(spark, sf_dir, "documents"))


@query(
    "op11_hard_negatives",
    """
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same,
        CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.r <> b.r),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
        n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    QUALIFY rank <= 3
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("vec_id") % 7 == 0
    label = F.when(own, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0)


def _secret_rules() -> str:
    """The rules as rows: order, kind, expression whose group 1 is the tail, least length of the tail."""
    rows = []
    for n, rule in enumerate(secret_scan.RULES):
        head = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", rule.head.replace(r"\x20", " ")) if rule.any_case else rule.head
        tail, least = ("[0-9a-f]+", 16) if rule.kind == "hex" else (rule.tail, rule.least)
        pattern = f"{head.replace('(', '(?:')}({tail})".replace("'", "''")
        rows.append(f"({n}, '{rule.kind}', '{pattern}', {least})")
    return ", ".join(rows)


@query(
    "op12_secret_scan",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    rules(n, kind, p, least) AS (VALUES {_secret_rules()}),
    m AS (SELECT r, n, kind, least, regexp_extract_all(t, p) AS whole, regexp_extract_all(t, p, 1) AS tails, string_split_regex(t, p) AS gaps
        FROM d, rules WHERE regexp_matches(t, p)),
    u AS (SELECT r, n, kind, least, unnest(whole) AS w, unnest(tails) AS tail, unnest(gaps[1:len(whole)]) AS gap, unnest(range(len(whole))) AS i FROM m),
    s AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY r, n ORDER BY i) AS stop FROM u),
    f AS (SELECT r, n, kind, CAST(stop - length(w) AS BIGINT) AS start, concat(kind, ':', CAST(stop - length(w) AS BIGINT), ':', CAST(stop AS BIGINT)) AS span
        FROM s WHERE length(tail) >= least)
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        sha256(coalesce(string_agg(span, ',' ORDER BY start, n) FILTER (n < 3), '')) AS base_sha256,
        coalesce(string_agg(span, ',' ORDER BY start, n), '') AS spans
    FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


@query(
    "op13_importance",
    r"""
    WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
    dw AS (SELECT r, unnest(w) AS word FROM d),
    words AS (SELECT DISTINCT word, hex(word) AS h FROM (SELECT word FROM dw UNION ALL SELECT word FROM b)),
    k AS (SELECT word, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i:
        (strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS BIGINT), 1)) - 1)),
        lambda c, x: xor(c >> 8, tab[xor(c % 256, x) + 1]))) % 10000 AS bucket FROM words, tab),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
    z AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM b) AS tt),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (tt + 10000)))) AS gain
        FROM s FULL JOIN t USING (bucket), z),
    x AS (SELECT r, floor(sum(gain) / count(*)) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY r),
    h AS (SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS sha
        FROM d LEFT JOIN x USING (r)),
    v AS (SELECT *, list_reduce(list_transform(range(8), lambda i: strpos('0123456789abcdef', substr(sha, CAST(i + 1 AS BIGINT), 1)) - 1), lambda a, c: a * 16 + c) AS u FROM h),
    q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM v),
    o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM q WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM o) THEN rank END AS rank FROM q LEFT JOIN o USING (r)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
