"""Exact ranks without gathering values: a range is cut into bins, only counts come back, and
the bin of the rank is cut again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1_024


def value_at(values: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of that rank (from 0) among values (column x, doubles from low to high)."""
    while low < high:
        width = (high - low) / BINS
        if not width or low + width == low:  # so near that bins can't tell them apart: few values
            near = values.where(F.col("x").between(low, high)).groupBy("x").count().orderBy("x").collect()
            for r in near:
                if rank < r["count"]:
                    return r["x"]
                rank -= r["count"]
        at = F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1))
        bins = values.where(F.col("x").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bin").collect()
        for r in bins:
            if rank < r["n"]:
                low, high = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return low


def median_of(values: DataFrame) -> float | None:
    """The exact median of the column x, nulls aside; between two middle values their mean."""
    x = values.select(F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    r = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not r["n"]:
        return None
    if abs(r["lo"]) == float("inf") or abs(r["hi"]) == float("inf"):
        return x.agg(F.percentile("x", 0.5)).first()[0]  # no width to cut
    a, b = (value_at(x, k, r["lo"], r["hi"]) for k in ((r["n"] - 1) // 2, r["n"] // 2))
    return a if a == b else a + (b - a) * 0.5
