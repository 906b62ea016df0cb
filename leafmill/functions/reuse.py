"""Reuse of large column expressions within one JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

Built = TypeVar("Built")


def built_once(function: Callable[..., Built]) -> Callable[..., Built]:
    """Build the columns of a function once per JVM and set of arguments.

    A column made from names is only bound to data when it is used, so it can
    serve any DataFrame. Building a large one takes thousands of calls into the
    JVM, which is most of the planning time of a converter.
    """
    known: dict[tuple, Built] = {}

    @wraps(function)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in known:
            known[key] = function(*args)
        return known[key]

    return get
