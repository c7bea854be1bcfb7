"""Regular expressions as recipes write them, for Java's engine."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _valid(pattern: str) -> int | None:
    """Groups of the pattern; None if Java can't read it."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        try:
            return re.compile(pattern).groups
        except re.error:
            return None
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    try:
        return spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (Py4JJavaError, IllegalArgumentException):
        return None


def java_pattern(pattern: str, ignore_case: bool = False) -> str | None:
    """The pattern for Spark, or None if it can't be read."""
    java = ("(?iu)" if ignore_case else "") + pattern
    return None if not pattern or _valid(java) is None else java


def groups(pattern: str) -> int:
    return _valid(pattern) or 0


def quoted(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def java_replacement(put: str, known: int = 9) -> str:
    """$1 up to the known groups stay, $& is the match, $$ a dollar; all else is literal."""
    out, at = [], 0
    for m in re.finditer(r"\$(\$|&|[1-9])", put):
        if m[1].isdigit() and int(m[1]) > known:
            continue
        out += [_literal(put[at : m.start()]), r"\$" if m[1] == "$" else "$0" if m[1] == "&" else f"${m[1]}"]
        at = m.end()
    return "".join([*out, _literal(put[at:])])


def _literal(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> re.Pattern | None:
    """As recipes write it; None if it can't be read."""
    try:
        return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern), re.ASCII)
    except re.error:
        return None


def replaced(text: str, pattern: str, put: str) -> str:
    """All matches replaced; a pattern that can't be read changes nothing."""
    found = _compiled(pattern)
    if found is None:
        return text

    def expand(m: re.Match) -> str:
        one = lambda d: "$" if d[1] == "$" else m[0] if d[1] == "&" else m[int(d[1])] or "" if int(d[1]) <= found.groups else d[0]
        return re.sub(r"\$(\$|&|[1-9])", one, put)

    return found.sub(expand, text)


@F.pandas_udf(T.StringType())
def replace_by_column(texts: pd.Series, patterns: pd.Series, puts: pd.Series) -> pd.Series:
    return pd.Series([replaced(t, p, r) for t, p, r in zip(texts, patterns, puts, strict=True)], dtype=object)
