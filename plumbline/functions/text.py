"""Text helpers shared by the rules; all are plain column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\u000b"
LINE_BREAK = "\r\n|[\n\r]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to an expression that needs it repeatedly.

    Inside a lambda Spark cannot share a repeated sub-expression by itself.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(tests: Iterable[Column]) -> Column:
    """OR of the given tests; false when there are none."""
    tests = list(tests)
    return reduce(or_, tests) if tests else F.lit(False)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    return any_of(text.contains(part) for part in parts)


def ends_with_any(text: Column, suffixes: Iterable[str]) -> Column:
    return any_of(text.endswith(suffix) for suffix in suffixes)


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    return any_of(text.startswith(prefix) for prefix in prefixes)


def numbered(items: Column, indent: str = "", line_break: str = "\n") -> Column:
    """Array of strings as '1. a', '2. b', ... on separate lines."""
    return F.array_join(
        F.transform(items, lambda item, i: F.concat(F.lit(indent), (i + 1).cast("string"), F.lit(". "), item)),
        line_break,
    )
