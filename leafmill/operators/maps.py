"""Extension points: a user's own row map, file map and one-to-many function.

Rows go to the function as plain dicts: integers stay integers and NULL is None.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmill.session import slim_batches

#: Rows given out at a time, however many a function makes of one.
ROWS_AT_ONCE = 1000


def _ddl(df: DataFrame, added: str) -> StructType:
    new = StructType.fromDDL(added)
    replaced = {f.name for f in new}
    return StructType([f for f in df.schema.fields if f.name not in replaced] + list(new))


def _mapped(df: DataFrame, function: Callable[[dict], Iterable[dict]], schema: StructType) -> DataFrame:
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = ({n: r.get(n) for n in kind.names} for row in batch.to_pylist() for r in function(row))
            while rows := list(islice(made, ROWS_AT_ONCE)):
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    slim_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, function: Callable[[dict], dict], added: str) -> DataFrame:
    """Add the columns ``function`` returns for each row (DDL in ``added``)."""
    return _mapped(df, lambda row: [{**row, **function(row)}], _ddl(df, added))


def map_files(df: DataFrame, function: Callable[[dict], dict | None], result: str) -> DataFrame:
    """Replace each row by the record ``function`` returns; None drops the row."""
    return expand_files(df, lambda row: [r] if (r := function(row)) is not None else [], result)


def expand_files(df: DataFrame, function: Callable[[dict], Iterable[dict]], result: str) -> DataFrame:
    """Any number of records per row."""
    return _mapped(df, function, StructType.fromDDL(result))
