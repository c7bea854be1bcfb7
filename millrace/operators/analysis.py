"""Type inference, profiles, quality, facets and suggestions.

Each takes one pass or two over the table: all columns' figures come from one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.recipe import Op
from ..plans.table import RID, ColumnMeta, Table
from .ranks import median_of
from .steps import row_key

BINS = 14


# -- types --------------------------------------------------------------------------------------


def _type_counts(t: Table, m: ColumnMeta) -> dict[str, Column]:
    c = F.nullif(t.render(m), F.lit(""))
    s = cells.strip(c)
    hits = {"n": c.isNotNull(), "int": cells.is_integer(s), "dec": cells.is_decimal(s), "bool": cells.is_boolean(s), "date": cells.is_date(c)}
    return {k: F.count_if(F.coalesce(x, F.lit(False))).alias(f"{m.id}_{k}") for k, x in hits.items()}


def _type_of(n: int, ints: int, decs: int, bools: int, dates: int) -> str:
    # fixed values: the shares of cells that make a type
    if not n:
        return cells.TEXT
    if bools == n:
        return cells.BOOLEAN
    if ints >= 0.95 * n:
        return cells.INTEGER
    if decs >= 0.95 * n:
        return cells.DECIMAL
    return cells.DATE if dates >= 0.9 * n else cells.TEXT


def detect_types(t: Table) -> dict[str, str]:
    """The logical type of each column id, from all cells."""
    if not t.metas:
        return {}
    r = t.df.agg(*[x for m in t.metas for x in _type_counts(t, m).values()]).first()
    return {m.id: _type_of(*[r[f"{m.id}_{k}"] for k in ("n", "int", "dec", "bool", "date")]) for m in t.metas}


def with_types(t: Table) -> Table:
    found = detect_types(t)
    return replace(t, metas=tuple(replace(m, logical=found[m.id]) for m in t.metas))


# -- profiles --------------------------------------------------------------------------------------


def completeness(t: Table) -> dict[str, float]:
    """Share of cells that are not blank; 1 for no cells."""
    r = t.df.agg(*[F.coalesce(F.avg((~t.blank(m)).cast("double")), F.lit(1.0)).alias(m.id) for m in t.metas]).first()
    return {m.name: r[m.id] for m in t.metas}


def profile(t: Table, column: str) -> dict:
    """Counts, and by type: numbers with a histogram, dates, or text lengths."""
    m = t.find(column)
    if m is None:
        raise KeyError(column)
    return profile_frame(t, m).first().asDict()


def profile_frame(t: Table, m: ColumnMeta) -> DataFrame:
    """One row: total, filled, blank, distinct and the figures of the column's type."""
    full, cell = ~t.blank(m), t.render(m)
    base = [F.count("*").alias("total"), F.count_if(full).alias("filled"), F.count_if(~full).alias("blank"), F.count_distinct(F.when(full, cell)).alias("distinct")]
    if m.logical in (cells.INTEGER, cells.DECIMAL):
        n = F.when(full, t.number(m))
        median = median_of(t.df.select(n.alias("x")))
        more = [F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.lit(median).cast("double").alias("median"), F.sum(n).alias("sum"), F.stddev_pop(n).alias("std")]
    elif m.logical == cells.DATE:
        d = F.when(full, F.coalesce(cells.normalize_date(cell), cell))
        more = [F.min(d).alias("min"), F.max(d).alias("max")]
    else:
        size = F.when(full, F.length(cell))
        more = [F.min(size).alias("minLen"), F.max(size).alias("maxLen"), F.avg(size).alias("avgLen")]
    return t.df.agg(*base, *more)


def histogram(t: Table, column: str, bins: int = BINS) -> DataFrame:
    """bin, lo, hi, n: equal widths, the last bin closed; a constant column is in bin 0."""
    m = t.find(column)
    n = F.when(~t.blank(m), t.number(m))
    r = t.df.agg(F.min(n).alias("lo"), F.max(n).alias("hi")).first()
    spark = t.df.sparkSession
    if r["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    lo, width = float(r["lo"]), (float(r["hi"]) - float(r["lo"])) / bins
    at = F.least(F.lit(bins - 1), F.floor((n - lo) / width).cast("int")) if width else F.when(n.isNotNull(), F.lit(0))
    found = t.df.where(n.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def facet(t: Table, column: str, limit: int = 8) -> DataFrame:
    """value, n: the most frequent values; ties by value."""
    m = t.find(column)
    return t.df.where(~t.blank(m)).groupBy(t.render(m).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def dataset_stats(t: Table) -> dict[str, int]:
    r = t.df.agg(F.count("*").alias("n"), *[F.count_if(t.blank(m)).alias(m.id) for m in t.metas]).first()
    return {"rows": r["n"], "cols": len(t.metas), "totalCells": r["n"] * len(t.metas), "emptyCells": sum(r[m.id] for m in t.metas)}


# -- quality --------------------------------------------------------------------------------------------


def stray_space(t: Table, m: ColumnMeta) -> Column:
    """Text with white space at an end or twice in a row."""
    if t.kind(m) != "string":
        return F.lit(False)
    s = cells.SPACE
    return F.coalesce(t.col(m).rlike(rf"^{s}|{s}$|{s}{{2,}}"), F.lit(False))


def case_variants(t: Table, m: ColumnMeta) -> DataFrame:
    """key, forms (value, n), canonical: texts that differ only in case and outer space."""
    cell = t.col(m)
    by = t.df.where(~t.blank(m)).groupBy(F.lower(cells.strip(cell)).alias("key"), cell.alias("value")).agg(F.count("*").alias("n"))
    forms = by.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))).alias("forms")).where(F.size("forms") > 1)
    return forms.select("key", F.transform("forms", lambda x: x["value"]).alias("values"), cells.collapse(F.col("forms")[0]["value"]).alias("canonical"))


def duplicate_rows(t: Table) -> int:
    """Rows after the first with an equal key."""
    r = t.df.groupBy(row_key(t, list(t.metas))).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    return int(r[0])


@dataclass(frozen=True)
class ColumnQuality:
    name: str
    completeness: float
    blanks: int
    stray: int
    variants: int
    looks_like: str | None

    @property
    def issues(self) -> int:
        return sum(map(bool, (self.blanks, self.stray, self.variants, self.looks_like)))


def quality(t: Table) -> dict:
    """Columns' figures, duplicate rows, completeness and the score from 0 to 100."""
    aggregates = [F.count("*").alias("rows")]
    for m in t.metas:
        aggregates += [F.count_if(t.blank(m)).alias(f"{m.id}_blank"), F.count_if(stray_space(t, m)).alias(f"{m.id}_stray"), *_type_counts(t, m).values()]
    r = t.df.agg(*aggregates).first()
    n, columns = r["rows"], []
    for m in t.metas:
        found = _type_of(*[r[f"{m.id}_{k}"] for k in ("n", "int", "dec", "bool", "date")])
        texts = t.kind(m) == "string" and m.logical == cells.TEXT
        variants = case_variants(t, m).count() if texts else 0
        looks = found if t.kind(m) == "string" and texts and found != cells.TEXT else None
        columns.append(ColumnQuality(m.name, 1.0 if not n else 1 - r[f"{m.id}_blank"] / n, r[f"{m.id}_blank"], r[f"{m.id}_stray"], variants, looks))
    dups = duplicate_rows(t) if t.metas else 0
    whole = n * len(t.metas)
    complete = 1.0 if not whole else 1 - sum(c.blanks for c in columns) / whole
    # fixed values: the penalties of the score
    penalty = min(15, 3 * dups) + min(20, 4 * sum(c.issues > 0 for c in columns))
    score = max(0, int(complete * 100 - penalty + 0.5))
    return {"columns": columns, "duplicates": dups, "completeness": complete, "score": score}


# -- suggestions ----------------------------------------------------------------------------------------


def suggestions(t: Table) -> list[Op]:
    """Steps that would clean the table, in a fixed order; their parameters are as of now."""
    blank = [t.blank(m) for m in t.metas]
    empty = F.lit(True)
    for b in blank:
        empty = empty & b
    checks: list[Column] = [F.count("*").alias("rows"), F.count_if(empty).alias("empty")]
    for m, b in zip(t.metas, blank, strict=True):
        c = t.render(m)
        iso = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        checks += [F.count_if(stray_space(t, m)).alias(f"{m.id}_stray"), F.count_if(~b).alias(f"{m.id}_n"), F.count_if(~b & F.coalesce(cells.is_date(c), F.lit(False))).alias(f"{m.id}_date"), F.count_if(~b & ~F.coalesce(iso, F.lit(False))).alias(f"{m.id}_odd")]
    r = t.df.agg(*checks).first()
    if not r["rows"]:
        return []
    out: list[Op] = []
    put = lambda id, type, label, **params: out.append(Op(type, params, label, True, id))
    dirty = [m.name for m in t.metas if r[f"{m.id}_stray"]]
    if dirty:
        put("trim", "trim", f"Trim spaces in {len(dirty)} columns", columns=dirty)
    if r["empty"]:
        put("empty_rows", "removeEmptyRows", f"Remove {r['empty']} empty rows")
    if any(not r[f"{m.id}_n"] for m in t.metas):
        put("empty_cols", "removeEmptyColumns", "Remove empty columns")
    if dups := duplicate_rows(t):
        put("dups", "dedupeRows", f"Remove {dups} duplicate rows")
    for m in t.metas:
        n, dates = r[f"{m.id}_n"], r[f"{m.id}_date"]
        # fixed values: how many cells make a column of dates
        if m.logical != cells.DATE and n >= 3 and dates >= 0.7 * n and r[f"{m.id}_odd"]:
            put(f"date_{m.name}", "standardizeDate", f"Standardise dates in {m.name}", column=m.name)
    for m in t.metas:
        if m.logical == cells.TEXT and t.kind(m) == "string":
            mapping = {v: x["canonical"] for x in case_variants(t, m).toLocalIterator() for v in x["values"] if v != x["canonical"]}
            if mapping:
                put(f"case_{m.name}", "clusterMerge", f"Merge case variants in {m.name}", column=m.name, mapping=mapping)
    return out
