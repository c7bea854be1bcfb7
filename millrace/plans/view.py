"""Views of a table and differences between snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from .table import RID, Table


def sort_cycle(current: str | None) -> str | None:
    """none, asc, desc, none."""
    return {None: "asc", "asc": "desc", "desc": None}[current]


def search(t: Table, text: str) -> Table:
    """Rows with the text in any cell, whatever its case; all rows for an empty text."""
    if not text:
        return t
    hit = F.lit(False)
    for m in t.metas:
        hit = hit | F.contains(F.lower(t.text(m)), F.lower(F.lit(text)))
    return t.filter(hit)


def order_by(t: Table, column: str | None, direction: str | None = "asc") -> list[Column]:
    """Sort keys: numbers for numeric columns, text otherwise, blanks last, then row order."""
    m = t.find(column) if column and direction else None
    if m is None:
        return [F.col(RID)]
    key = t.number(m) if m.logical in (cells.INTEGER, cells.DECIMAL) else t.render(m)
    key = F.when(~t.blank(m), key)
    return [key.desc_nulls_last() if direction == "desc" else key.asc_nulls_last(), F.col(RID)]


def view(t: Table, text: str = "", column: str | None = None, direction: str | None = None) -> DataFrame:
    """The searched and sorted rows, with __rid."""
    found = search(t, text)
    return found.df.orderBy(*order_by(found, column, direction))


def subset(t: Table, rids: DataFrame) -> Table:
    """The rows whose __rid is in a frame of row numbers."""
    return t.with_df(t.df.join(rids.select(RID).distinct(), RID, "left_semi"))


def window(t: Table, n: int, first: int = 0) -> DataFrame:
    """n rows from the first on, in row order: a display's rows."""
    return t.ordered().offset(first).limit(n)


@dataclass(frozen=True)
class Delta:
    rows: int
    added: tuple[str, ...]
    removed: tuple[str, ...]
    changed: int


def _pairs(before: Table, after: Table) -> list[tuple]:
    return [(a, b) for a in before.metas for b in after.metas if before.find(a.name) is a and after.find(b.name) is b and a.name == b.name]


def _joined(before: Table, after: Table) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Rows of both by row number, and for each shared column whether its cell differs."""
    pairs = _pairs(before, after)
    left = before.df.select(RID, *[before.text(a).alias(f"a{i}") for i, (a, _) in enumerate(pairs)])
    right = after.df.select(RID, *[after.text(b).alias(f"b{i}") for i, (_, b) in enumerate(pairs)])
    return left.join(right, RID), [(a.name, F.col(f"a{i}") != F.col(f"b{i}")) for i, (a, _) in enumerate(pairs)]


def step_delta(before: Table, after: Table) -> Delta:
    """Rows more or less, columns added and removed, and, if neither, cells changed."""
    n, m = before.df.count(), after.df.count()
    added = tuple(x for x in after.names if x not in before.names)
    removed = tuple(x for x in before.names if x not in after.names)
    changed = 0
    if n == m and before.names == after.names:
        joined, differs = _joined(before, after)
        changed = int(joined.agg(F.coalesce(F.sum(sum((d.cast("long") for _, d in differs), F.lit(0))), F.lit(0))).first()[0])
    return Delta(m - n, added, removed, changed)


def changed_mask(before: Table, after: Table) -> DataFrame:
    """__rid, column: cells whose text differs, of rows that both have, and every cell of
    added columns."""
    joined, differs = _joined(before, after)
    names = F.array_compact(F.array(*[F.when(d, F.lit(n)) for n, d in differs])) if differs else F.array().cast("array<string>")
    old = joined.select(RID, F.explode(names).alias("column"))
    added = [x for x in after.names if x not in before.names]
    return old.unionByName(after.df.select(RID, F.explode(F.array(*map(F.lit, added))).alias("column"))) if added else old
