"""The 22 steps of a recipe: Table and parameters to Table.

Steps of class "row" are projections and filters and run unchanged on a stream; "ordered"
steps need the row order; "barrier" steps run a small aggregate before their output's
columns or parameters are known. A step whose parameters make no sense (no such column, a
pattern that can't be read) leaves the table as it is and says so in a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cells, formula
from ..functions.patterns import groups, java_pattern, java_replacement, quoted
from ..plans.table import RID, ColumnMeta, Table
from . import fills, similarity

ROW, ORDERED, BARRIER = "row", "ordered", "barrier"
STEPS: dict[str, tuple[str, Callable[[Table, dict], Table]]] = {}


class StepWarning(UserWarning):
    """A step that can't be applied and was passed over."""


def step(name: str, kind: str = ROW):
    def put(f: Callable[[Table, dict], Table]) -> Callable[[Table, dict], Table]:
        STEPS[name] = (kind, f)
        return f

    return put


def apply(t: Table, name: str, params: dict | None = None) -> Table:
    """The table after one step; an unknown or failing step changes nothing."""
    if name not in STEPS:
        warnings.warn(f"unknown step {name}", StepWarning, stacklevel=2)
        return t
    try:
        return STEPS[name][1](t, params or {})
    except (KeyError, ValueError, TypeError, AnalysisException, IllegalArgumentException) as error:
        warnings.warn(f"{name}: {error}", StepWarning, stacklevel=2)
        return t


def _one(t: Table, params: dict, key: str = "column") -> ColumnMeta:
    found = t.find(params[key])
    if found is None:
        raise KeyError(f"no column {params[key]!r}")
    return found


def _texts(t: Table, names) -> list[ColumnMeta]:
    """The chosen columns whose cells are text."""
    return [m for m in t.pick(names) if t.kind(m) == "string"]


def _cellwise(t: Table, names, change: Callable[[Column], Column], logical: str | None = None) -> Table:
    return t.map({m.id: F.when(t.blank(m), t.col(m)).otherwise(change(t.col(m))) for m in _texts(t, names)}, logical)


@step("trim")
def trim(t: Table, p: dict) -> Table:
    return _cellwise(t, p["columns"], cells.collapse)


@step("changeCase")
def change_case(t: Table, p: dict) -> Table:
    return _cellwise(t, p["columns"], lambda c: cells.change_case(c, p.get("mode", "title")))


@step("replace")
def replace_text(t: Table, p: dict) -> Table:
    find, put, ignore = p.get("find", ""), p.get("replaceWith", ""), bool(p.get("caseInsensitive"))
    if not find:
        return t
    java = java_pattern(find, ignore) if p.get("regex") else None
    if java is not None:
        put = java_replacement(put, groups(java))
        change = lambda c: F.regexp_replace(c, java, put)
    elif ignore:
        change = lambda c: F.regexp_replace(c, "(?iu)" + quoted(find), java_replacement(put, 0))
    else:
        change = lambda c: F.replace(c, F.lit(find), F.lit(put))
    return t.map({m.id: change(t.col(m)) for m in _texts(t, p["columns"])})


@step("extract")
def extract(t: Table, p: dict) -> Table:
    m, java = _one(t, p), java_pattern(p.get("pattern", ""))
    if java is None:
        raise ValueError(f"bad pattern {p.get('pattern')!r}")
    c = t.render(m)
    whole = F.regexp_extract(c, java, 0)
    got = F.coalesce(F.nullif(F.regexp_extract(c, java, 1), F.lit("")), whole) if groups(java) else whole
    return t.insert([(p.get("into") or f"{m.name}_extract", F.when(~t.blank(m) & c.rlike(java), got))])


@step("splitColumn", BARRIER)
def split_column(t: Table, p: dict) -> Table:
    m, at = _one(t, p), p.get("delimiter", "")
    if not at:
        raise ValueError("an empty delimiter")
    parts = F.split(t.text(m), quoted(at), -1)
    most = t.df.agg(F.max(F.size(parts))).first()[0] or 0
    out = t.insert([(f"{m.name}_{i + 1}", F.get(parts, i)) for i in range(most)], after=m)
    return out if p.get("keepOriginal") else out.with_metas(x for x in out.metas if x != m)


@step("mergeColumns")
def merge_columns(t: Table, p: dict) -> Table:
    parts = [F.nullif(t.render(m), F.lit("")) for m in t.pick(p["columns"])]
    sep = p.get("separator", " ")
    return t.insert([(p.get("name") or "merged", F.concat_ws(sep, *parts) if parts else F.lit(""))])


@step("renameColumn")
def rename_column(t: Table, p: dict) -> Table:
    m = _one(t, p)
    return replace(t, metas=tuple(replace(x, name=p["name"]) if x is m else x for x in t.metas))


@step("deleteColumns")
def delete_columns(t: Table, p: dict) -> Table:
    gone = set(p["columns"])
    return t.with_metas(m for m in t.metas if m.name not in gone)


@step("moveColumn")
def move_column(t: Table, p: dict) -> Table:
    m = _one(t, p)
    at, left = t.metas.index(m), [x for x in t.metas if x is not m]
    to = at + int(p["dir"])
    if not 0 <= to < len(t.metas):
        return t
    return t.with_metas([*left[:to], m, *left[to:]])


@step("changeType", BARRIER)
def change_type(t: Table, p: dict) -> Table:
    """A column whose cells all convert gets the Spark type; otherwise cells that don't keep
    their text, and the column stays text with the new tag."""
    m, to = _one(t, p), p["type"]
    if to not in cells.LOGICAL:
        raise ValueError(f"unknown type {to!r}")
    typed, mixed = cells.coerce(t.col(m), t.kind(m), to)
    if to in (cells.TEXT, cells.DATE):
        return t.map({m.id: mixed}, to)
    lost = t.df.where((t.text(m) != "") & typed.isNull()).limit(1).isEmpty()
    return t.map({m.id: typed if lost else mixed}, to)


PREDICATES = ("eq", "neq", "contains", "notContains", "gt", "lt", "gte", "lte", "empty", "notEmpty")


def predicate(t: Table, m: ColumnMeta, op: str, value) -> Column:
    text, low = t.text(m), F.lower(t.text(m))
    value = "" if value is None else str(value)
    if op in ("eq", "neq"):
        return text == F.lit(value) if op == "eq" else text != F.lit(value)
    if op in ("contains", "notContains"):
        hit = F.contains(low, F.lower(F.lit(value)))
        return hit if op == "contains" else ~hit
    if op in ("gt", "lt", "gte", "lte"):
        a, b = t.number(m), cells.number(F.lit(value))
        return F.coalesce({"gt": a > b, "lt": a < b, "gte": a >= b, "lte": a <= b}[op], F.lit(False))
    if op in ("empty", "notEmpty"):
        return t.blank(m) if op == "empty" else ~t.blank(m)
    return F.lit(True)


@step("filterRows")
def filter_rows(t: Table, p: dict) -> Table:
    return t.filter(predicate(t, _one(t, p), p.get("op", ""), p.get("value")))


@step("removeEmptyRows")
def remove_empty_rows(t: Table, p: dict) -> Table:
    keep = F.lit(False)
    for m in t.metas:
        keep = keep | ~t.blank(m)
    return t.filter(keep)


@step("removeEmptyColumns", BARRIER)
def remove_empty_columns(t: Table, p: dict) -> Table:
    if not t.metas:
        return t
    some = t.df.agg(*[F.coalesce(F.bool_or(~t.blank(m)), F.lit(False)).alias(m.id) for m in t.metas]).first()
    return t.with_metas(m for m in t.metas if some[m.id])


@step("fillDown", ORDERED)
def fill_down(t: Table, p: dict) -> Table:
    return fills.carry(t, t.pick(p["columns"]), down=True)


@step("fillMissing", ORDERED)
def fill_missing(t: Table, p: dict) -> Table:
    return fills.fill(t, _one(t, p), p.get("strategy", "down"), p.get("value"))


def row_key(t: Table, metas: list[ColumnMeta]) -> Column:
    """Cells as text, null as empty; 1 and '1' are the same."""
    return F.struct(*[t.text(m).alias(f"k{i}") for i, m in enumerate(metas)]) if metas else F.lit("")


@step("dedupeRows", ORDERED)
def dedupe_rows(t: Table, p: dict) -> Table:
    """The first row of each key: partial minimums of row numbers are merged by hash, so a key
    with a third of all rows is one small row of each task, and the rows that have a minimum
    stay. Rows are never sorted or gathered by key."""
    metas = t.pick(p.get("columns") or None)
    first = t.df.groupBy(row_key(t, metas).alias("__key")).agg(F.min(RID).alias("__first")).select("__first")
    return t.with_df(t.df.join(first, F.col(RID) == F.col("__first"), "left_semi"))


#: Mappings up to this many entries are an expression; larger ones are joined.
MAP_ENTRIES = 200


@step("clusterMerge")
def cluster_merge(t: Table, p: dict) -> Table:
    m, mapping = _one(t, p), {str(k): str(v) for k, v in p["mapping"].items()}
    if not mapping:
        return t
    text, kept = t.render(m), F.when(t.blank(m), F.lit(None).cast("string")).otherwise(t.render(m))
    if len(mapping) <= MAP_ENTRIES:
        found = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), kept)
        return t.map({m.id: F.coalesce(found, text)})
    spark = t.df.sparkSession
    pairs = spark.createDataFrame(list(mapping.items()), "__from string, __to string")  # Spark broadcasts it if it is small enough
    joined = t.df.withColumn("__cell", kept).join(pairs, F.col("__cell") == F.col("__from"), "left")
    return t.with_df(joined.withColumn(m.id, F.coalesce("__to", text)).drop("__cell", "__from", "__to"))


@step("standardizeDate")
def standardize_date(t: Table, p: dict) -> Table:
    m = _one(t, p)
    c = t.render(m)
    return t.map({m.id: F.coalesce(cells.normalize_date(c), c)}, cells.DATE)


@step("parseField")
def parse_field(t: Table, p: dict) -> Table:
    m, kind = _one(t, p), p.get("kind")
    c = t.render(m)
    got = cells.phone(c, str(p.get("country") or "1")) if kind == "phone" else cells.name_part(c, p.get("part", "first")) if kind == "name" else c
    return t.insert([(p["into"], got)]) if p.get("into") else t.map({m.id: got})


@step("numberFormat", BARRIER)
def number_format(t: Table, p: dict) -> Table:
    m, places = _one(t, p), int(p.get("decimals", 2))
    n = cells.half_away(t.number(m), places)
    if t.kind(m) != "string" or t.df.where(n.isNull() & t.col(m).isNotNull()).limit(1).isEmpty():
        return t.map({m.id: n}, cells.DECIMAL)
    return t.map({m.id: F.coalesce(cells.render(n, "double"), t.col(m))}, cells.DECIMAL)


@step("expression")
def expression(t: Table, p: dict) -> Table:
    def column(name: str) -> formula.Typed | None:
        found = t.pick([name])  # of a repeated name a formula sees the last
        return formula.typed(t.col(found[-1]), t.kind(found[-1])) if found else None

    target = t.find(p.get("target", "")) if p.get("mode") == "replace" else None
    value = formula.typed(t.col(target), t.kind(target)) if target else None
    got = formula.compile_formula(p["expr"], column, value)
    if target:
        return t.map({target.id: got.col}, cells.TEXT if got.type in ("text", "null") else None)
    return t.insert([(p.get("name") or "expr", got.col)])


@step("fuzzyDedupe", ORDERED)
def fuzzy_dedupe(t: Table, p: dict) -> Table:
    return similarity.fuzzy_dedupe(t, p.get("columns") or None, float(p.get("threshold", 0.9)), p.get("survivorship", "first"))
