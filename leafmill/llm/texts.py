"""Text rules the corpus operators share, as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.session import slim_batches  # noqa: F401

BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"


def whole(text: Column) -> Column:
    """The text itself, empty when null."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; every other letter stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS + "+", " ")


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, lengthened until no column of the input has that name."""
    lower = {t.lower() for t in taken}
    while wish.lower() in lower:
        wish += "_"
    return wish
