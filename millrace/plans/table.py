"""A table: a DataFrame with physical columns, their names and logical types, and row order.

Physical names are c0, c1, … so that names may repeat; names and logical types live in
ColumnMeta. __rid orders the rows (ties never occur) and is the only thing that does.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells

RID = "__rid"


@dataclass(frozen=True)
class ColumnMeta:
    id: str
    name: str
    logical: str = cells.TEXT


@dataclass(frozen=True)
class Table:
    df: DataFrame
    metas: tuple[ColumnMeta, ...]
    made: int = 0  # physical names used so far

    # -- looking up -------------------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return [m.name for m in self.metas]

    def find(self, name: str) -> ColumnMeta | None:
        """The first column of that name."""
        return next((m for m in self.metas if m.name == name), None)

    def pick(self, names: Iterable[str] | None) -> list[ColumnMeta]:
        """All columns of those names, in table order; of all names if none are given."""
        wanted = None if names is None else set(names)
        return [m for m in self.metas if wanted is None or m.name in wanted]

    def kind(self, m: ColumnMeta) -> str:
        return self.df.schema[m.id].dataType.simpleString()

    def col(self, m: ColumnMeta) -> Column:
        return F.col(m.id)

    def text(self, m: ColumnMeta) -> Column:
        """The cell as text, null as the empty text."""
        return cells.text(F.col(m.id), self.kind(m))

    def render(self, m: ColumnMeta) -> Column:
        return cells.render(F.col(m.id), self.kind(m))

    def blank(self, m: ColumnMeta) -> Column:
        return cells.blank(F.col(m.id), self.kind(m))

    def number(self, m: ColumnMeta) -> Column:
        return cells.number(F.col(m.id), self.kind(m))

    # -- changing -----------------------------------------------------------------------------

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)

    def filter(self, condition: Column) -> Table:
        return self.with_df(self.df.where(condition))

    def map(self, changes: dict[str, Column], logical: str | None = None) -> Table:
        """Cells of the columns with those ids replaced, in one projection."""
        if not changes:
            return self
        metas = tuple(replace(m, logical=logical) if logical and m.id in changes else m for m in self.metas)
        return replace(self, df=self.df.withColumns(changes), metas=metas)

    def insert(self, new: list[tuple[str, Column]], after: ColumnMeta | None = None, logical: str = cells.TEXT) -> Table:
        """New columns (name, cells), at the end or after a column."""
        metas = [ColumnMeta(f"c{self.made + i}", name, logical) for i, (name, _) in enumerate(new)]
        at = len(self.metas) if after is None else self.metas.index(after) + 1
        df = self.df.withColumns({m.id: c for m, (_, c) in zip(metas, new, strict=True)}) if new else self.df
        return Table(df, (*self.metas[:at], *metas, *self.metas[at:]), self.made + len(new))

    def with_metas(self, metas: Iterable[ColumnMeta]) -> Table:
        metas = tuple(metas)
        return Table(self.df.select(RID, *[m.id for m in metas]), metas, self.made)

    # -- leaving --------------------------------------------------------------------------------

    def ordered(self) -> DataFrame:
        return self.df.orderBy(RID)

    def to_df(self, names: Iterable[str] | None = None, rid: bool = False) -> DataFrame:
        """Columns under their own names, without order; a repeated name gets a number."""
        seen: dict[str, int] = {}
        out = [F.col(RID).alias(RID)] if rid else []
        for m in self.pick(names):
            n = seen[m.name] = seen.get(m.name, 0) + 1
            out.append(F.col(m.id).alias(m.name if n == 1 else f"{m.name}_{n}"))
        return self.df.select(*out)

    def rows(self) -> list[list]:
        """Header and rows on the driver: for small results."""
        return [self.names, *[list(r)[1:] for r in self.df.select(RID, *[m.id for m in self.metas]).orderBy(RID).collect()]]


def from_df(df: DataFrame, order: str | Column, logical: dict[str, str] | None = None, drop_order: bool = False) -> Table:
    """A table of df's columns, its rows ordered by a unique column or expression."""
    rid = F.col(order) if isinstance(order, str) else order
    names = [c for c in df.columns if not (drop_order and c == order)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    of = {"bigint": cells.INTEGER, "int": cells.INTEGER, "smallint": cells.INTEGER, "double": cells.DECIMAL, "float": cells.DECIMAL, "boolean": cells.BOOLEAN}
    metas = tuple(ColumnMeta(f"c{i}", n, (logical or {}).get(n, of.get(kinds[n], cells.TEXT))) for i, n in enumerate(names))
    return Table(df.select(rid.alias(RID), *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]), metas, len(names))
