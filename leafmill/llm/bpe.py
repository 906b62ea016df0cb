"""Byte-level BPE by a public rank file: encoding with offsets, and decoding, over Arrow batches.

The rank file gives byte strings in order of merging. For the tokenizers library every
byte becomes a printable character, a rank's bytes a string of those, and every way to
cut a ranked string into two ranked strings a merge of its rank. Text is split by the
public pattern first; a piece that is itself ranked is one token, as in the rank file's
own library. Special tokens do not exist here: their spelling is ordinary text.

Decoding looks every id up in the reversed byte table and joins the bytes. A character
that lies across two tokens becomes whole again once both are there; bytes that never
form one (an id list cut inside a character) read as U+FFFD in ``decoded_text``.

Tasks encode a batch in runs of some 200,000 characters, so memory follows one run and
not the batch; a longer single text is a run of its own. Digests cut the text by the pattern
first and encode each piece that a worker has not met yet.

Defined results: a null or empty text has no tokens and decodes to nothing; the order of
rows, repeated rows and extra columns are as they were.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import texts as X

#: Characters of a run; pieces whose ids a worker keeps, and the length up to which it keeps them.
RUN_CHARACTERS, KNOWN_PIECES, SHORT_PIECE = 200_000, 200_000, 40


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it prints, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(prints) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """The tokenizer and the byte strings by id; made once per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    shown = {b: "".join(chars[x] for x in b) for b in ranks}
    merges = []
    for whole in sorted(ranks, key=ranks.get):
        cuts = [(whole[:i], whole[i:]) for i in range(1, len(whole)) if whole[:i] in ranks and whole[i:] in ranks]
        merges += [(shown[a], shown[b]) for a, b in sorted(cuts, key=lambda c: (ranks[c[0]], ranks[c[1]]))]
    made = Tokenizer(models.BPE(vocab={shown[b]: n for b, n in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    table = [b""] * (max(ranks.values()) + 1)
    for b, n in ranks.items():
        table[n] = b
    return made, table


def runs(texts: list[str]) -> Iterator[list[str]]:
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > RUN_CHARACTERS:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


@functools.lru_cache(maxsize=2)
def _pieces(path: str, pattern: str):
    """What cuts a text into pieces, a tokenizer of single pieces, and the ids of pieces met; made once per Python worker."""
    import copy

    import regex
    from tokenizers import pre_tokenizers

    whole = copy.deepcopy(tokenizer(path, pattern)[0])
    whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    found = regex.compile(pattern)
    if found.groups:
        raise ValueError("a pattern with groups does not give whole pieces")
    return found.findall, whole, {}


def ids_of(texts: list[str], path: str, pattern: str) -> Iterator[list[int]]:
    """The ids of each text. Texts share most of their pieces, so a worker encodes a piece once and keeps
    its ids, those of short pieces up to ``KNOWN_PIECES``; the other pieces are encoded with every run."""
    cut, whole, known = _pieces(path, pattern)
    if len(known) > KNOWN_PIECES:
        known.clear()
    pieces = [cut(t) for t in texts]
    new = list({p for own in pieces for p in own if p not in known})
    known.update(zip(new, (e.ids for e in whole.encode_batch(new, add_special_tokens=False)), strict=True))
    for own in pieces:
        yield list(itertools.chain.from_iterable(map(known.__getitem__, own)))
    for p in new:
        if len(p) > SHORT_PIECE:
            del known[p]


ENCODED = pa.struct([("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32()))])


def encoded(text: Column, path: str, pattern: str) -> Column:
    """A struct of ``ids`` and ``offsets``, the character at which each token starts."""

    @F.arrow_udf("struct<ids array<int>, offsets array<int>>")
    def encode(column: pa.Array) -> pa.Array:
        made, _ = tokenizer(path, pattern)
        rows = []
        for run in runs([t or "" for t in column.to_pylist()]):
            for e in made.encode_batch(run, add_special_tokens=False):
                rows.append({"ids": e.ids, "offsets": [a for a, _ in e.offsets]})
        return pa.array(rows, ENCODED)

    return encode(text)


def decoded_bytes(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that a list of ids stands for; null stays null."""

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        _, table = tokenizer(path, pattern)
        return pa.array([None if r is None else b"".join(map(table.__getitem__, r)) for r in column.to_pylist()], pa.binary())

    return decode(ids)


def decoded_text(ids: Column, path: str, pattern: str) -> Column:
    """As ``decoded_bytes``, as text; bytes that form no character read as U+FFFD."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        _, table = tokenizer(path, pattern)
        return pa.array(
            [None if r is None else b"".join(map(table.__getitem__, r)).decode("utf-8", "replace") for r in column.to_pylist()],
            pa.string(),
        )

    return decode(ids)


def encoded_rows(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: bool = False
) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` of little-endian 32-bit ids and ``decoded_sha256``; with ``ids`` the ids too.

    Ids and bytes are hashed run by run inside the task, so without ``ids`` they are never
    held for a whole batch.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kind = pa.struct(fields + [("ids", pa.list_(pa.int32()))] * ids)

    @F.arrow_udf("struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ">")
    def digest(column: pa.Array) -> pa.Array:
        _, table = tokenizer(path, pattern)
        parts = []
        for run in runs([t or "" for t in column.to_pylist()]):
            rows = []
            for found in ids_of(run, path, pattern):
                own = np.array(found, "<u4")
                row = {
                    "n_tokens": len(own),
                    "ids_sha256": hashlib.sha256(own.tobytes()).hexdigest(),
                    "decoded_sha256": hashlib.sha256(b"".join(map(table.__getitem__, found))).hexdigest(),
                }
                rows.append(row | {"ids": own.view(np.int32)} if ids else row)
            parts.append(pa.array(rows, kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    own = X.free_name(docs.columns, "_coded")
    added = [f.name for f in kind]
    kept = [c for c in docs.columns if c not in added]
    coded = docs.select(*kept, digest(F.col(text_col)).alias(own))
    return coded.select(*kept, *[F.col(f"{own}.{n}").alias(n) for n in added])


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and the digests of its encoding and decoding."""
    return encoded_rows(docs.select(id_col, text_col), path, pattern, text_col).drop(text_col)
