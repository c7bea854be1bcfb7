"""Recipes on streams: steps of class row run unchanged; others run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.recipe import Recipe
from ..plans.table import RID, from_df


def fold_stream(recipe: Recipe, stream: DataFrame, order: str | Column, names: list[str] | None = None) -> DataFrame:
    """The recipe as a streaming projection and filter. Its steps must all be row by row:
    they keep no state, so any source, trigger and watermark will do."""
    if not recipe.streamable():
        raise ValueError("the recipe has steps that need more than a row; use fold_batches")
    return recipe.fold(from_df(stream, order)).to_df(names)


def fold_batches(recipe: Recipe, stream: DataFrame, order: str | Column, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Any recipe, applied to each micro-batch as a table of its own."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(recipe.fold(from_df(batch, order)).to_df(), epoch)

    return stream.writeStream.foreachBatch(each)


def changes_by_window(stream: DataFrame, recipe: Recipe, order: str, time: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Rows and rows kept by a row-by-row recipe, in tumbling windows of event time."""
    if not recipe.streamable():
        raise ValueError("the recipe has steps that need more than a row")
    out = recipe.fold(from_df(stream.withWatermark(time, late), order))
    m = out.find(time)
    return out.df.groupBy(F.window(F.col(m.id), size)).agg(F.count(F.col(RID)).alias("kept"))
