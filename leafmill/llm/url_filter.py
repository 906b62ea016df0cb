"""URL filtering by pattern rules behind an index of literal tokens, in DataFrame operations only.

A rule is a regular expression over ``host + path`` with the literal tokens that any URL
it matches must hold. The index files each rule under the rarest of its tokens, counted
over the distinct URLs themselves. A URL's own tokens fetch its candidate rules, and only
those run their expression. The highest rank wins; a URL without a rule gets the default.

Tokens are the labels of the host and the segments of the path; a site rule's tokens are
its host's labels and those segments of its path that it fixes whole.

Work is done once per distinct URL and comes back by an equi-join on the URL, so a URL
that a third of all rows repeat is judged once; adaptive execution splits the way back.
Tokens travel with a SHA-256 of their URL. Only the candidates found by the index, one
row per URL and rule, meet the URL's text again, so a URL of very many segments costs
no more than its length.

Defined results: a null URL, or one without ``://``, has empty host and path, matches no
rule with tokens and gets the default; repeated rows each get their verdict; extra
columns stay, and columns named like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import texts as X


@dataclass(frozen=True)
class Rule:
    """``tokens`` must all occur in any URL that ``pattern`` finds; ``name`` null hides the rule's name."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def site_rule(verdict: str, site: str) -> Rule:
    """``host/path``: that host and its subdomains, paths that start so; longer ones rank higher."""
    host, slash, rest = site.partition("/")
    path = slash + rest
    fixed = [s for s in path.split("/")[:-1] if s]
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path) if path != '/' else '(?:/|\\z)'}"
    return Rule(site, verdict, pattern, (*host.split("."), *fixed), 1_000 + len(site))


def word_rule(verdict: str, word: str) -> Rule:
    """A host label that is ``word``, wherever it stands; ranks below every site rule."""
    return Rule(None, verdict, rf"^(?:[^/]*\.)?{re.escape(word)}(?:\.|/|\z)", (word,), len(word))


def host_of(url: Column) -> Column:
    # Up to the first slash, question or number sign after the first "://".
    return X.ascii_lower(F.regexp_extract(X.whole(url), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(X.whole(url), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(F.split(host, r"\."), F.split(path, "/")), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a literal token to be filed under")
    rows = [(n, r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for n, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "rule_no int, name string, verdict string, pattern string, tokens array<string>, rank int"
    )


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under its rarest token; ``tokens`` has a ``token`` per distinct URL that holds it."""
    wanted = rules.select("rule_no", F.explode("tokens").alias("token"))
    counts = tokens.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("least"))
    )
    return rules.join(rarest, "rule_no").select(F.col("least.token").alias("token"), "rank", "name", "verdict", "pattern")


def judged(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``."""
    spark = pages.sparkSession
    url = F.col(url_col)
    urls = pages.select(url.alias("u")).filter("u is not null").distinct()
    urls = urls.select("u", F.unhex(F.sha2("u", 256)).alias("key"), host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    tokens = urls.select("key", F.explode(tokens_of(F.col("h"), F.col("p"))).alias("token"))
    index = indexed(rule_table(spark, rules), tokens)
    # A rule lies under one token and a URL's tokens are distinct, so no candidate comes twice.
    candidates = tokens.join(index, "token").drop("token")
    hits = candidates.join(urls.select("key", "u", F.concat("h", "p").alias("subject")), "key").filter(F.expr("subject rlike pattern"))
    u, best = X.free_name(pages.columns, "_u"), X.free_name(pages.columns, "_best")
    found = hits.groupBy(F.col("u").alias(u)).agg(F.max(F.struct("rank", "name", "verdict")).alias(best))
    out = pages.drop("host", "path", "rule", "verdict").join(found, F.col(url_col) == F.col(u), "left")
    return out.withColumns(
        {
            "host": host_of(url),
            "path": path_of(url),
            "rule": F.col(f"{best}.name"),
            "verdict": F.coalesce(f"{best}.verdict", F.lit(default)),
        }
    ).drop(u, best)
