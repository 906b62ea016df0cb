"""Secret scans by one combined automaton of all rules.

The rules' expressions become one deterministic automaton: a Thompson automaton of every
rule read backwards, subset construction over classes of bytes, and minimisation by
partition refinement. A state's label says which rules it accepts. One backward pass over
the bytes, through one transition array, so marks every place at which a match of any rule
begins; the few marked places are then extended forwards by the rule's own automaton.

The pass runs over all texts of a batch at once, a byte of each lane a step. A lane ends
with a text or with a byte after which every state is the same (for these rules a line
feed or a comma, found from the transition array), so long texts are many lanes too.

A rule is a ``head`` and a ``tail``. Its matches are leftmost, longest and do not overlap;
then those fail whose tail (what follows the longest head) has fewer than ``least`` bytes,
and a failing match still takes up its bytes. Matches of different rules may overlap.

Defined results: a null or empty text has no span. Places are code points, the end is
exclusive; spans are ordered by start, then by rule. Equal texts get equal results; ids are
not looked at. Extra columns stay, ``spans`` (and ``redacted``) are replaced. A rule that
matches the empty text is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import texts as X

#: Bytes of text scanned at once, lanes wanted for them, and lanes below which each is finished by itself.
PORTION, LANES, FEW = 4 << 20, 4096, 24
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_parser = re._parser


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    tail: str
    least: int = 0
    any_case: bool = False  # of the head's letters


#: Kinds asked for, in order. A run of 16 or more is what is left of runs of any length by their length.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 14),
    Rule("hex", r"", r"[0-9a-f]{16,}"),
]
#: Kinds that this method adds.
ADDED = [
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*", r"PRIVATE KEY-----"),
]
RULES = BASE + ADDED


class Nondeterministic:
    """A Thompson automaton; bytes of an edge are a set of 256 bits."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.edges: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.edges.append([])
        return len(self.free) - 1

    def add(self, pattern: str, begin: int, any_case: bool = False) -> int:
        """Adds the expression's paths from ``begin``; returns their end."""
        return self._items(_parser.parse(pattern.encode()), begin, any_case)

    def _items(self, items, at: int, any_case: bool) -> int:
        for op, value in items:
            at = self._item(str(op), value, at, any_case)
        return at

    def _item(self, op: str, value, at: int, any_case: bool) -> int:
        if op in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            end = self.state()
            self.edges[at].append((self._bytes(op, value, any_case), end))
            return end
        if op == "SUBPATTERN":
            return self._items(value[-1], at, any_case)
        if op == "BRANCH":
            end = self.state()
            for items in value[1]:
                self.free[self._items(items, at, any_case)].append(end)
            return end
        if op == "MAX_REPEAT":
            low, high, items = value
            for _ in range(low):
                at = self._items(items, at, any_case)
            if high == _parser.MAXREPEAT:
                loop = self.state()
                self.free[at].append(loop)
                self.free[self._items(items, loop, any_case)].append(loop)
                return loop
            ends = [at]
            for _ in range(high - low):
                at = self._items(items, at, any_case)
                ends.append(at)
            end = self.state()
            for e in ends:
                self.free[e].append(end)
            return end
        raise ValueError(f"a rule cannot hold {op}")

    def _bytes(self, op: str, value, any_case: bool) -> int:
        if op == "LITERAL":
            found = {value}
        elif op == "NOT_LITERAL":
            found = set(range(256)) - {value}
        elif op == "ANY":
            found = set(range(256)) - {10}
        else:
            found, negated = set(), False
            for kind, part in value:
                if str(kind) == "NEGATE":
                    negated = True
                elif str(kind) == "LITERAL":
                    found.add(part)
                elif str(kind) == "RANGE":
                    found |= set(range(part[0], part[1] + 1))
                else:
                    raise ValueError(f"a rule cannot hold {kind}")
            found = set(range(256)) - found if negated else found
        if any_case:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return sum(1 << b for b in found)

    def reached(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def backwards(self) -> Nondeterministic:
        out = Nondeterministic()
        for _ in self.free:
            out.state()
        for s, ends in enumerate(self.free):
            for e in ends:
                out.free[e].append(s)
        for s, steps in enumerate(self.edges):
            for mask, e in steps:
                out.edges[e].append((mask, s))
        return out


@dataclass
class Automaton:
    """``table[state << 8 | byte]`` is the next state; states from ``marked`` on have a label."""

    table: np.ndarray
    labels: list[int]
    first: int
    marked: int


def determined(nfa: Nondeterministic, begin: list[int], accepted: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction and minimisation; ``anywhere``: a match may begin at every byte."""
    masks = sorted({m for steps in nfa.edges for m, _ in steps})
    kinds: dict[tuple, list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(m >> b & 1 for m in masks), []).append(b)
    groups = list(kinds.values())
    start = nfa.reached(begin)
    known, todo, rows = {start: 0}, [start], []
    while len(rows) < len(todo):
        own, row = todo[len(rows)], []
        for group in groups:
            to = {e for s in own for m, e in nfa.edges[s] if m >> group[0] & 1}
            new = nfa.reached(to | start if anywhere else to)
            if new not in known:
                known[new] = len(known)
                todo.append(new)
            row.append(known[new])
        rows.append(row)
    steps = np.array(rows)
    label = np.array([sum({1 << accepted[s] for s in own if s in accepted}) for own in todo])
    # Partition refinement: states stay together while their labels and all their steps agree.
    part = np.unique(label, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack((part, part[steps])), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    count = part.max() + 1
    sample = np.zeros(count, np.int64)
    sample[part] = np.arange(len(part))
    order = np.argsort(label[sample] != 0, kind="stable")  # unlabelled ones first
    place = np.argsort(order)
    table = np.zeros((count, 256), np.int32)
    for column, group in enumerate(groups):
        table[:, group] = place[part[steps[sample[order], column]]][:, None]
    labels = label[sample[order]].tolist()
    return Automaton(table.ravel(), labels, int(place[part[0]]), sum(x == 0 for x in labels))


class Scanner:
    """The combined automaton of some rules, and each rule's own for the way forwards."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.forward = rules, []
        nfa, ends, begins = Nondeterministic(), [], {}
        for n, rule in enumerate(rules):
            begin = nfa.state()
            end = nfa.add(rule.tail, nfa.add(rule.head, begin, rule.any_case))
            if end in nfa.reached([begin]):
                raise ValueError(f"{rule.kind} matches the empty text")
            ends.append(end)
            begins[begin] = n
            self.forward.append((self._own(rule.head, "", rule.any_case), self._own(rule.head, rule.tail, rule.any_case)))
        self.back = determined(nfa.backwards(), ends, begins, True)
        table = self.back.table.reshape(-1, 256)
        self.resets = (table == table[:1]).all(0)
        # States come from the table already shifted, so that a step is one lookup.
        self.shifted = (self.back.table << 8).astype(np.int32)

    @staticmethod
    def _own(head: str, tail: str, any_case: bool):
        nfa = Nondeterministic()
        begin = nfa.state()
        end = nfa.add(tail, nfa.add(head, begin, any_case))
        made = determined(nfa, [begin], {end: 0}, False)
        # A state from which nothing is accepted ends the way; it only leads to itself.
        table = made.table.reshape(-1, 256)
        dead = [s for s in range(len(table)) if not made.labels[s] and (table[s] == s).all()]
        return made.table.tolist(), made.first, made.marked, dead[0] if dead else -1

    @staticmethod
    def _longest(own, raw: bytes, at: int) -> int:
        """The end of the longest match that begins there; -1 without one."""
        table, state, marked, dead = own
        end = at if state >= marked else -1
        for place in range(at, len(raw)):
            state = table[state << 8 | raw[place]]
            if state == dead:
                break
            if state >= marked:
                end = place + 1
        return end

    def begins(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The backward pass over texts that end at ``ends``: marked places, ascending, and their states."""
        cuts = np.union1d(ends, np.flatnonzero(self.resets[raw]) + 1)
        step = max(256, len(raw) // LANES)
        at = np.searchsorted(cuts, np.arange(step, len(raw), step))
        stops = np.union1d(ends, cuts[at[at < len(cuts)]])
        stops = stops[stops > 0]
        size = np.diff(stops, prepend=0)
        order = np.argsort(-size, kind="stable")
        place, left = stops[order] - 1, size[order]
        state = np.full(len(place), self.back.first << 8, np.int32)
        marked, table = self.back.marked << 8, self.shifted
        found: list[tuple[np.ndarray, np.ndarray]] = []
        active, gone = len(place), 0
        while active > FEW:
            state = table[state[:active] | raw[place[:active]]]
            hit = np.flatnonzero(state >= marked)
            if len(hit):
                found.append((place[hit], state[hit] >> 8))
            place = place[:active] - 1
            gone += 1
            active = int(np.searchsorted(-left, -gone))
        single = table.tolist() if active else []
        for lane in range(active):
            stop = int(place[lane]) + 1
            s, own = int(state[lane]), []
            part = raw[stop - int(left[lane] - gone) : stop].tobytes()
            for back, b in enumerate(reversed(part), 1):
                s = single[s | b]
                if s >= marked:
                    own.append((stop - back, s >> 8))
            if own:
                found.append(tuple(np.array(c) for c in zip(*own, strict=True)))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, state = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
        order = np.argsort(place)
        return place[order], state[order]

    def spans(self, raw: bytes, places: np.ndarray, states: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) of one text, by start and rule, from its marked places."""
        labels, out = np.array(self.back.labels)[states], []
        for n, rule in enumerate(self.rules):
            own = places[labels >> n & 1 == 1]
            at = 0
            while at < len(own):
                start = int(own[at])
                end = self._longest(self.forward[n][1], raw, start)
                if end - self._longest(self.forward[n][0], raw, start) >= rule.least:
                    out.append((start, n, end))
                at = int(np.searchsorted(own, end))
        return sorted(out)

    def scanned(self, texts: pa.Array) -> list[list[tuple[int, str, int]]]:
        """Spans of each text in code points: (start, kind, end)."""
        values = texts.cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        raw = np.frombuffer(b"".join(values.drop_null().to_pylist()), np.uint8)
        places, states = self.begins(raw, ends)
        out: list[list[tuple[int, str, int]]] = [[] for _ in range(len(texts))]
        whose = np.searchsorted(ends, places, "right")
        for n in np.unique(whose).tolist():
            own = whose == n
            begin = int(ends[n - 1]) if n else 0
            text = raw[begin : ends[n]]
            found = self.spans(text.tobytes(), places[own] - begin, states[own])
            if found and text.max() > 127:
                point = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                found = [(int(point[a]), k, int(point[b])) for a, k, b in found]
            out[n] = [(a, self.rules[k].kind, b) for a, k, b in found]
        return out


def scanned(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``spans``: kind, start and end of each secret."""
    scanner = Scanner(RULES if rules is None else rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PORTION
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(texts)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for own in scanner.scanned(texts[a:b]):
                rows.append([{"kind": k, "start": s, "end": e} for s, k, e in own])
        return pa.array(rows, kind)

    kept = [c for c in docs.columns if c != "spans"]
    return docs.select(*kept, found(F.col(text_col)).alias("spans"))


def redacted(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``spans`` and ``redacted``, the text with a ``*`` for each code point of a secret."""
    found = scanned(docs, rules, text_col)
    text = X.whole(F.col(text_col))
    # Spans may overlap: each takes what the ones before it have left.
    folded = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto")),
        lambda s, x: F.struct(
            F.concat(
                s["out"], F.substring(text, (s["upto"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - s["upto"]).cast("int")),
                F.repeat(F.lit("*"), F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"])).cast("int")),
            ).alias("out"),
            F.greatest(s["upto"], x["end"]).alias("upto"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, (s["upto"] + 1).cast("int"), F.char_length(text))),
    )
    return found.withColumn("redacted", folded)


def _of(kinds: list[str]) -> Column:
    return F.filter("spans", lambda x: x["kind"].isin(kinds))


def shown(own: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(own, lambda x: F.format_string("%s:%d:%d", x["kind"], x["start"], x["end"])), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the numbers of base spans, a digest of them, and all spans."""
    found = scanned(docs.select(id_col, text_col), text_col=text_col)
    base = [r.kind for r in BASE]
    return found.select(
        id_col, *[F.size(_of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(shown(_of(base)).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
    )
