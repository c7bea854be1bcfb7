"""Filling gaps: carry down or up, a constant, mean, median or mode."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.table import RID, ColumnMeta, Table
from .ranks import median_of

#: Rows of a stretch that is filled by one window; what crosses stretches is carried by a
#: small table with one row a stretch.
STRETCH = 65_536


def carry(t: Table, metas: list[ColumnMeta], down: bool) -> Table:
    """Blank cells get the last non-blank cell above (or the next below); blank ones at the
    start (end) become null. Rows are windowed by stretches of the row order, not all in one
    partition: each stretch leaves its last cells, and a window over those few rows carries
    them on to the next ones. Filling up reads the rows backwards: a frame that reaches to the
    end would be gone through anew for each row."""
    if not metas:
        return t
    at = F.floor(F.col(RID) / F.lit(STRETCH))
    along = F.asc if down else F.desc
    inside = Window.partitionBy("__at").orderBy(along(RID)).rowsBetween(Window.unboundedPreceding, 0)
    seen = {m.id: F.when(~t.blank(m), t.col(m)) for m in metas}
    df = t.df.withColumn("__at", at)
    edge = df.groupBy("__at").agg(*[(F.max_by if down else F.min_by)(F.when(~t.blank(m), t.col(m)), F.when(~t.blank(m), F.col(RID))).alias(f"__e_{m.id}") for m in metas])
    frame = Window.orderBy(along("__at")).rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    edge = edge.select("__at", *[F.last(f"__e_{m.id}", ignorenulls=True).over(frame).alias(f"__e_{m.id}") for m in metas])
    out = df.withColumns({f"__s_{m.id}": seen[m.id] for m in metas})
    out = out.withColumns({f"__f_{m.id}": F.last(f"__s_{m.id}", ignorenulls=True).over(inside) for m in metas}).join(edge, "__at", "left")
    out = out.withColumns({m.id: F.coalesce(f"__f_{m.id}", f"__e_{m.id}") for m in metas})
    return t.with_df(out.select(RID, *[m.id for m in t.metas]))


def _number(t: Table, m: ColumnMeta, value: Column) -> Column:
    return value.cast(t.kind(m)) if t.kind(m) != "string" else cells.render(value, "double")


def fill(t: Table, m: ColumnMeta, strategy: str, constant=None) -> Table:
    if strategy in ("down", "up"):
        return carry(t, [m], strategy == "down")
    blank, cell = t.blank(m), t.col(m)
    if strategy == "constant":
        return t.map({m.id: F.when(blank, F.lit(constant).cast(t.kind(m))).otherwise(cell)})
    if strategy in ("mean", "median"):
        n = t.number(m)
        found = t.df.agg(F.avg(n)).first()[0] if strategy == "mean" else median_of(t.df.select(n.alias("x")))
        if found is None:
            return t
        value = cells.half_up(F.lit(float(found)), 6) if strategy == "mean" else F.lit(float(found))
        return t.map({m.id: F.when(blank, _number(t, m, value)).otherwise(cell)})
    if strategy == "mode":
        # of the most frequent values the one that reaches its count first
        by = t.df.where(~blank).groupBy(t.render(m).alias("v")).agg(F.count("*").alias("n"), F.max(RID).alias("last"), F.min_by(cell, F.col(RID)).alias("cell"))
        top = by.agg(F.max_by("cell", F.struct("n", -F.col("last"))).alias("x")).first()["x"]
        return t if top is None else t.map({m.id: F.when(blank, F.lit(top).cast(t.kind(m))).otherwise(cell)})
    raise ValueError(f"unknown strategy {strategy!r}")
