"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (one to four bytes of its lower-cased words,
blanks and punctuation folded to one space), weighted by log frequency times inverse
document frequency and scaled to length one. Each language has a few centroids, found
by spherical k-means over its training texts; a text belongs to the language of the
centroid with the largest cosine, which is its score. A text farther from every centroid
than its language allows is rejected. The cosine of any text grows with the places its
n-grams fill, so a language has a limit for each band (doubling) of filled places, a share
of the cosine that nearly all of its training texts, whole and cut short, reach there from
centroids of which they were no part. A band of too few texts takes the limit of the next
lower band, below the lowest one in proportion to the places; a language of too few texts
the lowest limits of the others, and without any nothing is rejected for its distance.

Training takes a bounded sample: ``PER_LANGUAGE`` different rows of each language in
expectation, picked by a hash of id and text, so null or repeated ids change nothing. Sampling, counting and clustering run in tasks; the driver
receives per language a few vectors of ``DIMENSIONS`` numbers.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is
rejected; with no training row every text is. Equal texts get equal results. Extra
columns stay, and columns named like a result are replaced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import texts as X

#: Bounds of the fit: training texts per language, centroids per language, vector length.
PER_LANGUAGE, CENTROIDS, DIMENSIONS = 600, 4, 8192
#: A text is rejected below this share of the cosine that 99 of 100 training texts of its band reach;
#: training texts are also cut to these lengths, and a band needs so many of them.
LENIENCY, CUTS, EVIDENCE = 0.7, (20, 50, 120, 300, 800, 2000, None), 12
BANDS = DIMENSIONS.bit_length()
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    _c = chr(_b).lower()
    if _b >= 128 or _c.isalpha():
        _FOLD[_b] = ord(_c) if _b < 128 else _b


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of one whole text."""
    raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    blank = raw == 32
    raw = raw[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    total = np.zeros(DIMENSIONS)
    gram = np.zeros(len(raw), np.uint32)
    for n in range(1, 5):
        if len(raw) < n:
            break
        gram = (gram[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        place = ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(15)) & np.uint32(DIMENSIONS - 1)
        total += np.bincount(place, minlength=DIMENSIONS)
    return total


@dataclass
class Model:
    """``weights`` are inverse document frequencies; a centroid's row has its language and limits by band."""

    weights: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray

    def vectors(self, counted: np.ndarray) -> np.ndarray:
        out = np.log1p(counted) * self.weights
        return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-12)


def _means(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starting rows; the same rows give the same centres."""
    picked = [0]
    near = vectors @ vectors[0]
    while len(picked) < min(k, len(vectors)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[picked[-1]])
    centres = vectors[picked]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(1)
        sums = np.stack([vectors[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def bands(counted: np.ndarray) -> np.ndarray:
    """The doubling in which the number of filled places lies."""
    return np.log2(np.maximum(1, np.count_nonzero(counted, axis=-1))).astype(np.int64)


def _limits(texts: list[str], vectors: np.ndarray, model: Model) -> list[float]:
    """Per band what share of the low cosine of its texts they must reach; NaN where too few tell."""
    out = np.full(BANDS, np.nan)
    if len(texts) < 2 * EVIDENCE:
        return out.tolist()
    halves = [_means(vectors[1 - i :: 2], CENTROIDS) for i in range(2)]
    band, near = [], []
    for cut in CUTS:
        # One length at a time, so that as many vectors are held as for the whole texts.
        at = [i for i, t in enumerate(texts) if cut is None or len(t) > cut]
        for i in range(2):
            own = [texts[j][:cut] for j in at if j % 2 == i]
            if own:
                counted = np.stack([counts(t) for t in own])
                band.append(bands(counted))
                near.append((model.vectors(counted) @ halves[i].T).max(1))
    band, near = np.concatenate(band), np.concatenate(near)
    known = [b for b in range(BANDS) if (band == b).sum() >= EVIDENCE]
    for b in known:
        out[b] = LENIENCY * np.quantile(near[band == b], 0.01)
    for b in range(known[0] if known else 0):
        out[b] = out[known[0]] / 2 ** (known[0] - b)
    for b in range(known[0] if known else BANDS, BANDS):
        out[b] = out[b - 1] if np.isnan(out[b]) else out[b]
    return out.tolist()


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """Learns from ``rows``; rows without a language or a letter are left out. None: nothing to learn."""
    X.slim_batches(rows.sparkSession)
    usable = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    usable = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    # One number per language, as the model itself has some per language; texts stay where they are.
    # Different rows are counted, as copies are taken once: rows without an id, or of one id, differ by their text.
    known = F.approx_count_distinct(F.xxhash64(F.col("id").cast("string"), "text"), 0.02)
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(known.alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, PER_LANGUAGE / n))])
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(chance < share[F.col("lang")]).dropDuplicates(["lang", "id", "text"])
    sample = sample.repartition("lang", F.pmod(F.xxhash64("id", "text"), F.lit(8)))

    def frequencies(batches):
        total, n = np.zeros(DIMENSIONS), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += counts(text) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "seen": [total.tolist()]})

    found = sample.mapInArrow(frequencies, "n long, seen array<double>").collect()  # one row per task
    if not found:
        return None
    n, seen = sum(r.n for r in found), np.sum([r.seen for r in found], axis=0)
    weights = np.log((1 + n) / (1 + seen)) + 0.05

    def centres(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"])
        model = Model(weights, np.empty(0), [], np.empty(0))
        vectors = model.vectors(np.stack([counts(t) for t in rows["text"]]))
        means = _means(vectors, CENTROIDS)
        limits = _limits(rows["text"].tolist(), vectors, model)
        return pd.DataFrame({"lang": key[0], "mean": [json.dumps([round(x, 7) for x in m]) for m in means.tolist()], "at": [limits] * len(means)})

    # One group is at most the bounded sample of one language.
    made = sample.groupBy("lang").applyInPandas(centres, "lang string, mean string, at array<double>").collect()
    made = sorted(made, key=lambda r: (r.lang, r.mean))
    limits = np.array([r["at"] for r in made], np.float64)
    lowest = np.where(np.isnan(limits), np.inf, limits).min(0)
    limits = np.where(np.isnan(limits), np.where(np.isinf(lowest), 0.0, lowest), limits)
    return Model(weights, np.array([json.loads(r.mean) for r in made]), [r.lang for r in made], limits)


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected``."""

    @F.arrow_udf("struct<lang_pred string, score double, rejected boolean>")
    def predict(column: pa.Array) -> pa.Array:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        texts = column.cast(pa.large_string())
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        rows = []
        for begin in range(0, len(texts), 256):
            own = [t if ok else None for t, ok in zip(texts[begin : begin + 256].to_pylist(), lettered[begin : begin + 256], strict=True)]
            known = [counts(t) for t in own if t is not None] if model else []
            if known:
                # Rounded, as sums of a product depend in their last digits on a row's place in it.
                counted = np.stack(known)
                cosine = (model.vectors(counted) @ model.centroids.T).round(9)
                best = cosine.argmax(1)
                limit = model.limits[best, bands(counted)]
            at = 0
            for t in own:
                if t is None or not model:
                    rows.append({"lang_pred": UNDETERMINED, "score": 0.0, "rejected": True})
                    continue
                score = float(min(1.0, max(0.0, cosine[at, best[at]])))
                rows.append({"lang_pred": model.languages[best[at]], "score": score, "rejected": bool(score < limit[at])})
                at += 1
        return pa.array(rows, kind)

    names = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in names]
    own = "_found"
    while own in kept:
        own += "_"
    out = docs.select(*kept, predict(F.col(text_col)).alias(own))
    return out.select(*kept, *[F.col(f"{own}.{n}").alias(n) for n in names])


def held_out(id_col: str = "doc_id"):
    """Ids kept from training: crc32 of the id as text leaves 2 by 4; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
