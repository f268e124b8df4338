"""Patterns that mean the same in every engine: boundaries and classes are ASCII, case is folded beforehand."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


#: A boundary before a letter or digit, and one after: there a single look-around is enough, and far cheaper.
_STARTS = re.compile(r"^\\b(?=(?:\(\?:)*(?:\\d|[A-Za-z0-9]))")
_ENDS = re.compile(r"(?<=[A-Za-z0-9)])\\b$|(?<=\\d[+])\\b$|(?<=\\d\{\d\})\\b$|(?<=\\d\{\d,\d\})\\b$")


def java(pattern: str) -> str:
    """The pattern for the JVM, where \\b alone would be Unicode-aware."""
    pattern = _ENDS.sub(lambda m: "(?![A-Za-z0-9_])", _STARTS.sub(lambda m: "(?<![A-Za-z0-9_])", pattern))
    return pattern.replace(r"\b", _BOUNDARY)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(java(pattern)), F.lit(False))


def any_of(text: Column, patterns: list[str]) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns))


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(java(pattern))), F.lit(0))


def first(text: Column, pattern: str) -> Column:
    """The first match, null if there is none."""
    got = F.regexp_extract(text, java(pattern), 0)
    return F.when(got != "", got)
