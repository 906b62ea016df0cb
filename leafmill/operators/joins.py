"""Joins of many rows with a written table of few, by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A written table of so many rows and bytes at most is sent to every task; rows of a salt beyond that.
SMALL_ROWS, SMALL_BYTES, SALT_ROWS = 200_000, 32 << 20, 2_000_000


def sized_join(big: DataFrame, small: DataFrame, keys: list[str], how: str, spread: str) -> DataFrame:
    """Join ``big`` with ``small``, a written table with slim rows.

    Up to ``SMALL_ROWS`` rows of ``SMALL_BYTES`` together it is broadcast, so ``big`` and its text stay in place.
    Beyond, the key is salted by ``spread``: as many salts as the largest key of ``big``
    asks for, measured on the keys alone.
    """
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in small.columns), F.lit(0))
    rows, size = small.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    if rows <= SMALL_ROWS and (size or 0) <= SMALL_BYTES:
        return big.join(F.broadcast(small), keys, how)
    most = big.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // SALT_ROWS))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
