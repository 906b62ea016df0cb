"""Secret scans against plain expressions, place by place."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import queries, secret_scan
from leafmill.llm.secret_scan import RULES, Rule, Scanner

PARTS = [
    "password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "=", "abcdef0123456789", "AKIA", "ABCDEFGH12",
    "ghp_", "x" * 20, "é", "\n", "eyJabc", ".", "zz-_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "0123", "AIza", "ſecret",
    "toKen", "/+", ",", "𝒳", "\x00", "Key",
]


def brute(text):
    """Matches of any length, leftmost, by Python's expressions; those too short fail afterwards."""
    out = []
    for n, rule in enumerate(RULES):
        head = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", rule.head.replace(r"\x20", " ")) if rule.any_case else rule.head
        tail, least = ("[0-9a-f]+", 16) if rule.kind == "hex" else (rule.tail, rule.least)
        found = re.finditer(f"(?:{head})(?P<tail>{tail})", text or "")
        out += [(m.start(), n, rule.kind, m.end()) for m in found if len(m["tail"]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def texts(count=3000):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(count)]
    return made + [None, "", "token=token=abcdefghijklmnop", "token=secret: abcdefghijklmnop", "AKIA" * 9, "a" * 15, "a" * 16, "é" + "0" * 70_000]


@pytest.mark.parametrize("few", [24, 0, 10**9])
def test_spans_are_those_of_the_expressions(monkeypatch, few):
    monkeypatch.setattr(secret_scan, "FEW", few)
    given = texts()
    got = Scanner(RULES).scanned(pa.array(given, pa.string()))
    assert [[(k, a, b) for a, k, b in g] for g in got] == [brute(t) for t in given]
    assert sum(map(len, got)) > 2000


def test_one_long_text_is_many_lanes(monkeypatch):
    """Lanes end where every state is the same, so results do not depend on their number."""
    whole = "\n".join(t or "" for t in texts())
    want = [(a, k, b) for k, a, b in brute(whole)]
    for lanes in (1, 50, 100_000):
        monkeypatch.setattr(secret_scan, "LANES", lanes)
        assert Scanner(RULES).scanned(pa.array([whole]))[0] == want


def test_automaton_is_minimal():
    """No two states of the combined automaton agree in label and, for all texts, in what follows."""
    back = Scanner(RULES).back
    table = back.table.reshape(-1, 256)
    part = np.unique(np.array(back.labels), return_inverse=True)[1]
    for _ in range(len(table)):
        part = np.unique(np.column_stack((part, part[table])), axis=0, return_inverse=True)[1].ravel()
    assert len(np.unique(part)) == len(table) < 1000


def test_rules_of_ones_own(docs):
    rules = [Rule("pair", "k", "v{2,3}"), Rule("not", "", "[^a-z\n ]+", 2), Rule("either", "", "ab|abc|b")]
    got = secret_scan.scanned(docs([(1, "kvkvvkvvvv ab abcb"), (2, "é12\nX")]), rules).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in got] == [
        [("pair", 2, 5), ("pair", 5, 9), ("either", 11, 13), ("either", 14, 17), ("either", 17, 18)], [("not", 0, 3)],
    ]
    with pytest.raises(ValueError, match="empty"):
        Scanner([Rule("none", "", "a*")])
    with pytest.raises(ValueError, match="cannot hold"):
        Scanner([Rule("word", "", r"\bx")])


def test_rows_nulls_and_extra_columns(docs):
    rows = [(1, "token = 'abcdefghijkl' ñ deadbeefdeadbeef"), (1, "token = 'abcdefghijkl' ñ deadbeefdeadbeef"), (None, None), (3, ""), (4, "plain")]
    given = docs(rows).withColumn("spans", F.lit("mine")).withColumn("kind", F.lit(1))
    got = secret_scan.redacted(given)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "kind", "spans", "redacted"]
    found = {r.doc_id: (len(r.spans), r.redacted) for r in got.collect()}
    assert found == {1: (2, "*" * 21 + "' ñ " + "*" * 16), None: (0, ""), 3: (0, ""), 4: (0, "plain")}
    assert secret_scan.digests(docs([])).count() == 0
    assert queries.QUERIES["op12_secret_scan"] and got.count() == 5
