"""Python text behaviour as Spark columns.

Everything here stays inside the JVM. The patterns are written once in Python
syntax and turned into Java ones by :func:`java`, so that both sides of the
package (columns and the offset scanner) share one definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: the whitespace set of Python's str.strip and \s. -----------
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# ------------------------------------------------------------------------------

SENTINEL = "\x01"
# Stands for a genuine U+FFFD while undecodable bytes are being dropped.
_KEPT_REPLACEMENT = "\ufdd0\ufdd1\ufdd0"


def java(pattern: str, flags: str = "") -> str:
    """A Python pattern as a Java one.

    ``(?d)`` keeps ``.``, ``^`` and ``$`` from stopping at anything but ``\\n``;
    ``(?U)`` widens ``\\s`` to Unicode and the four separators Java leaves out
    are added; ``\\Z`` becomes ``\\z`` (Java's ``\\Z`` skips a last newline).
    """
    body = pattern.replace(r"\s", r"[\s\x1c-\x1f]").replace(r"\Z", r"\z")
    return f"(?dU{flags}){body}"


def strip(c: Column) -> Column:
    """Python ``str.strip()``: linear, and for every kind of whitespace."""
    return F.btrim(c, F.lit(PY_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value inside a lambda so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def universal_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def decode_text(binary: Column) -> Column:
    """UTF-8 text, undecodable bytes dropped, newlines normalised."""
    raw = binary.cast("string")
    mark, kept = F.lit("\ufffd"), F.lit(_KEPT_REPLACEMENT)
    repaired = F.replace(
        F.replace(F.make_valid_utf8(F.replace(raw, mark, kept)), mark, F.lit("")), kept, mark
    )
    return universal_newlines(F.when(F.is_valid_utf8(raw), raw).otherwise(repaired))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last ``/``; empty when there is none."""
    return F.regexp_extract(path, r"(?s)\A(.*)/", 1)


def extension(path: Column) -> Column:
    """Last dot suffix of the base name, dot included; ``.bashrc`` has none."""
    return F.regexp_extract(basename(path), r"(?s)[^.].*?(\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    """Base name without its extension."""
    name = basename(path)
    return name.substr(F.lit(1), F.length(name) - F.length(extension(path)))


def ends_with_any(c: Column, suffixes: list[str]) -> Column:
    test = F.lit(False)
    for suffix in suffixes:
        test = test | c.endswith(suffix)
    return test


def contains_any(c: Column, needles: list[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | c.contains(needle)
    return test


def iso_time(ts: Column) -> Column:
    """ISO-8601 text; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def matches(c: Column, pattern: str, group: int, flags: str = "") -> Column:
    """All matches of one group, like ``re.findall`` with one group."""
    return F.regexp_extract_all(c, F.lit(java(pattern, flags)), F.lit(group))


def first_match(c: Column, pattern: str, group: int, flags: str = "") -> Column:
    """First match of one group; empty when there is none."""
    return F.regexp_extract(c, java(pattern, flags), group)


def found(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(java(pattern, flags))


def join_all(parts: Column, separator: str = "") -> Column:
    return F.array_join(parts, separator)


def text(*parts: Column | str) -> Column:
    """Concatenate columns and literal strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def one_row_per(df: DataFrame, keep: list[Column | str], items: Column | str, ordinal: str, value: str) -> DataFrame:
    """One row per list element with its position; empty lists give no row.

    For a plain explode the optimizer adds a filter on the list's size, which
    would parse the document behind the list a second time. It adds none for the
    outer variant, whose only extra rows go away again here.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(ordinal, value))
    return rows.filter(F.col(ordinal).isNotNull())
