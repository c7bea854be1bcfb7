"""One query for each operator over the whole tables, with the SQL that checks it.

The tables are clean, so three projections make dirt from keys (the same text runs in Spark
and in DuckDB). Row order is the table's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells
from .operators import analysis, similarity
from .operators.steps import apply
from .plans.recipe import Recipe
from .plans.scratch import scratch_path
from .plans.table import RID, Table, from_df
from .plans.view import changed_mask, order_by, search, sort_cycle, step_delta, subset, window
from .sources import files
from .sources.sample import sample_table

DIRTY = {
    "dirty_customer": """
SELECT c_custkey AS id,
 CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' WHEN c_custkey % 7 = 1 THEN replace(c_name, '#', '  # ') WHEN c_custkey % 7 = 2 THEN upper(c_name) ELSE c_name END AS name,
 CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '' WHEN c_custkey % 11 = 2 THEN '   ' WHEN c_custkey % 11 < 5 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 5 THEN c_mktsegment || ' ' ELSE c_mktsegment END AS segment,
 CASE c_custkey % 6 WHEN 0 THEN '(415) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 1 THEN '+44 20 7946 ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 2 THEN '0049 30 ' || lpad(CAST(c_custkey % 100000 AS STRING), 6, '0') WHEN 3 THEN '1-212-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 4 THEN 'n/a' ELSE '' END AS phone,
 CASE WHEN c_custkey % 5 = 0 THEN '1,' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') WHEN c_custkey % 5 = 1 THEN CAST(c_custkey AS STRING) || 'kg' WHEN c_custkey % 5 = 2 THEN 'none' WHEN c_custkey % 5 = 3 THEN '' ELSE CAST(c_custkey AS STRING) || '.25' END AS amount,
 CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'n' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END AS flag,
 CASE c_custkey % 3 WHEN 0 THEN 'Lovelace, Ada' WHEN 1 THEN 'Grace  Brewster Hopper' ELSE 'Cher' END AS person,
 CAST(NULL AS STRING) AS empty_col FROM customer""",
    "dirty_orders": """
SELECT o_orderkey AS id, o_custkey AS custkey,
 CASE o_orderkey % 6 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING),2,'0') || '-' || lpad(CAST(day(o_orderdate) AS STRING),2,'0')
  WHEN 1 THEN CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
  WHEN 2 THEN CAST(day(o_orderdate) AS STRING) || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3) || ' ' || CAST(year(o_orderdate) AS STRING)
  WHEN 3 THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3) || ' ' || CAST(day(o_orderdate) AS STRING) || ', ' || CAST(year(o_orderdate) AS STRING)
  WHEN 4 THEN '99/99/2024' ELSE '' END AS order_date FROM orders""",
    "dirty_events": """
SELECT event_id AS id, user_id,
 CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN ' ' ELSE event_type END AS event_type,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events""",
}
KEYS = {"nation": "n_nationkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def source(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> Table:
    """A table, or a dirty projection of one, with its key as row order."""
    base = {"dirty_customer": "customer", "dirty_orders": "orders", "dirty_events": "events"}.get(name, name)
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    if name in DIRTY:
        df, key = spark.sql(DIRTY[name].replace(f"FROM {base}", "FROM {base}"), base=df), "id"
    elif name == "lineitem":
        key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    else:
        key = KEYS[name]
    return from_df(df if columns is None else df.select(*columns), key)


def dirty(sql: str) -> str:
    """SQL whose dirty tables are spelled out."""
    used = ", ".join(f"{n} AS ({DIRTY[n]})" for n in DIRTY if n in sql and f"{n} AS (" not in sql)
    if not used:
        return sql
    body = sql.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{used}, {body[len(head) :]}"
    return f"WITH {used}\n{body}"


def query(oracle: str | None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = dirty(oracle)
        return f

    return put


def steps(name: str, table: str, columns: list[str], ops: list[tuple[str, dict]], oracle: str | None, out: list[str] | None = None) -> None:
    """A query that applies steps to columns of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = source(spark, sf_dir, table, columns)
        for op, params in ops:
            t = apply(t, op, params)
        return t.to_df(out)

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = dirty(oracle)


# -- text steps ------------------------------------------------------------------------------------

_BLANK = "trim({0}) = '' OR {0} IS NULL"
_COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_][^\s]*|[^A-Za-z0-9_]'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9_]') THEN upper(t[1:1]) || lower(t[2:]) ELSE t END), '')"


def _unless_blank(c: str, put: str) -> str:
    return f"CASE WHEN {_BLANK.format(c)} THEN {c} ELSE {put.format(c)} END AS {c}"


steps("trim_collapse", "dirty_customer", ["id", "name", "segment", "person"], [("trim", {"columns": ["name", "segment", "person"]})], f"SELECT id, {_unless_blank('name', _COLLAPSE)}, {_unless_blank('segment', _COLLAPSE)}, {_unless_blank('person', _COLLAPSE)} FROM dirty_customer")
for _mode, _put in (("upper", "upper({0})"), ("lower", "lower({0})"), ("title", _TITLE)):
    steps(f"case_{_mode}", "dirty_customer", ["id", "name", "segment"], [("changeCase", {"columns": ["name", "segment"], "mode": _mode})], f"SELECT id, {_unless_blank('name', _put)}, {_unless_blank('segment', _put)} FROM dirty_customer")
steps("replace_literal", "dirty_customer", ["id", "name", "phone"], [("replace", {"columns": ["name", "phone"], "find": "#", "replaceWith": "$1"}), ("replace", {"columns": ["phone"], "find": "555", "replaceWith": ""})], "SELECT id, replace(name, '#', '$1') AS name, replace(replace(phone, '#', '$1'), '555', '') AS phone FROM dirty_customer")
steps("replace_regex", "dirty_customer", ["id", "phone", "amount"], [("replace", {"columns": ["phone", "amount"], "find": "([0-9]+)-([0-9]+)", "replaceWith": "$2.$1", "regex": True})], r"SELECT id, regexp_replace(phone, '([0-9]+)-([0-9]+)', '\2.\1', 'g') AS phone, regexp_replace(amount, '([0-9]+)-([0-9]+)', '\2.\1', 'g') AS amount FROM dirty_customer")
steps("replace_ignore_case", "dirty_customer", ["id", "name", "segment"], [("replace", {"columns": ["name", "segment"], "find": "CUST", "replaceWith": "client", "caseInsensitive": True}), ("replace", {"columns": ["segment"], "find": "b(u|o)il", "replaceWith": "<$1>", "regex": True, "caseInsensitive": True})], r"SELECT id, regexp_replace(name, 'cust', 'client', 'gi') AS name, regexp_replace(regexp_replace(segment, 'cust', 'client', 'gi'), 'b(u|o)il', '<\1>', 'gi') AS segment FROM dirty_customer")
steps("replace_bad_regex", "dirty_customer", ["id", "phone"], [("replace", {"columns": ["phone"], "find": "(415", "replaceWith": "[x", "regex": True})], "SELECT id, replace(phone, '(415', '[x') AS phone FROM dirty_customer")
steps("extract_group", "part", ["p_partkey", "p_brand"], [("extract", {"column": "p_brand", "pattern": "#([0-9]+)", "into": "brand_no"})], "SELECT p_partkey, p_brand, regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_no FROM part")
steps("extract_whole", "events", ["event_id", "props"], [("extract", {"column": "props", "pattern": "[0-9]{2,}"})], "SELECT event_id, props, CASE WHEN regexp_matches(props, '[0-9]{2,}') THEN regexp_extract(props, '[0-9]{2,}') END AS props_extract FROM events")
steps("split_fixed", "part", ["p_partkey", "p_name"], [("splitColumn", {"column": "p_name", "delimiter": " "})], "SELECT p_partkey, string_split(p_name, ' ')[1] AS p_name_1, string_split(p_name, ' ')[2] AS p_name_2 FROM part")
steps("split_keep", "dirty_customer", ["id", "phone"], [("splitColumn", {"column": "phone", "delimiter": "-", "keepOriginal": True})], "SELECT id, phone, string_split(phone, '-')[1] AS phone_1, string_split(phone, '-')[2] AS phone_2, string_split(phone, '-')[3] AS phone_3, string_split(phone, '-')[4] AS phone_4 FROM dirty_customer")
steps("merge_columns", "dirty_customer", ["id", "name", "segment", "flag"], [("mergeColumns", {"columns": ["flag", "segment", "name"], "separator": "|", "name": "all_three"})], "SELECT id, name, segment, flag, concat_ws('|', nullif(name, ''), nullif(segment, ''), nullif(flag, '')) AS all_three FROM dirty_customer")
steps("rename_delete_move", "nation", ["n_nationkey", "n_name", "n_regionkey"], [("renameColumn", {"column": "n_name", "name": "country"}), ("deleteColumns", {"columns": ["n_regionkey"]}), ("moveColumn", {"column": "country", "dir": -1})], "SELECT n_name AS country, n_nationkey FROM nation")

# -- types -------------------------------------------------------------------------------------------

_ISO = r"""CASE
 WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN {0}
 WHEN regexp_matches({0}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') AND CAST(string_split({0}, '/')[2] AS INT) <= 12 THEN string_split({0}, '/')[3] || '-' || lpad(string_split({0}, '/')[2], 2, '0') || '-' || lpad(string_split({0}, '/')[1], 2, '0')
 WHEN regexp_matches({0}, '^[0-9]{{1,2}} [A-Za-z]{{3}} [0-9]{{4}}$') THEN string_split({0}, ' ')[3] || '-' || lpad(CAST((position(string_split({0}, ' ')[2] IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(string_split({0}, ' ')[1], 2, '0')
 WHEN regexp_matches({0}, '^[A-Za-z]{{3}} [0-9]{{1,2}}, [0-9]{{4}}$') THEN string_split({0}, ' ')[3] || '-' || lpad(CAST((position(string_split({0}, ' ')[1] IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(rtrim(string_split({0}, ' ')[2], ','), 2, '0')
 END"""
_NUM = r"try_cast(nullif(regexp_extract(replace({0}, ',', ''), '^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE)"
_SHOW = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_DEC = _SHOW.format(_NUM.format("amount"))

steps("cast_integer", "dirty_customer", ["id", "amount"], [("changeType", {"column": "amount", "type": "integer"})], r"SELECT id, coalesce(CAST(try_cast(nullif(regexp_extract(replace(amount, ',', ''), '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS VARCHAR), nullif(amount, '')) AS amount FROM dirty_customer")
steps("cast_decimal", "dirty_customer", ["id", "amount"], [("changeType", {"column": "amount", "type": "decimal"})], f"SELECT id, coalesce({_DEC}, nullif(amount, '')) AS amount FROM dirty_customer")
steps("cast_boolean", "dirty_customer", ["id", "flag"], [("changeType", {"column": "flag", "type": "boolean"})], "SELECT id, CASE WHEN lower(trim(flag)) IN ('true','yes','y','1') THEN 'true' WHEN lower(trim(flag)) IN ('false','no','n','0') THEN 'false' ELSE nullif(flag, '') END AS flag FROM dirty_customer")
steps("cast_date", "dirty_orders", ["id", "order_date"], [("changeType", {"column": "order_date", "type": "date"})], f"SELECT id, coalesce({_ISO.format('order_date')}, nullif(order_date, '')) AS order_date FROM dirty_orders")
steps("cast_text", "dirty_customer", ["id", "name"], [("changeType", {"column": "name", "type": "text"})], "SELECT id, trim(name) AS name FROM dirty_customer")
steps("cast_clean_column", "dirty_customer", ["id", "phone"], [("extract", {"column": "phone", "pattern": "[0-9]{3}$", "into": "tail"}), ("changeType", {"column": "tail", "type": "integer"})], "SELECT id, phone, CASE WHEN regexp_matches(phone, '[0-9]{3}$') THEN CAST(regexp_extract(phone, '[0-9]{3}$') AS BIGINT) END AS tail FROM dirty_customer")
steps("dates_to_iso", "dirty_orders", ["id", "order_date"], [("standardizeDate", {"column": "order_date"})], f"SELECT id, coalesce({_ISO.format('order_date')}, order_date) AS order_date FROM dirty_orders")
steps("number_format", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"], [("numberFormat", {"column": "l_extendedprice", "decimals": 1})], "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 10) / 10 AS l_extendedprice FROM lineitem")
steps("number_format_text", "dirty_customer", ["id", "amount"], [("numberFormat", {"column": "amount", "decimals": 1})], f"SELECT id, coalesce({_SHOW.format('(round(' + _NUM.format('amount') + ' * 10) / 10)')}, amount) AS amount FROM dirty_customer")

_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
steps("phone_normalise", "dirty_customer", ["id", "phone"], [("parseField", {"column": "phone", "kind": "phone", "country": "1", "into": "e164"})], f"""SELECT id, phone, CASE WHEN {_DIGITS} = '' THEN NULL WHEN starts_with(trim(phone), '+') THEN '+' || {_DIGITS} WHEN starts_with({_DIGITS}, '00') THEN '+' || substr({_DIGITS}, 3)
 WHEN length({_DIGITS}) = 10 THEN '+1' || {_DIGITS} WHEN length({_DIGITS}) = 11 AND starts_with({_DIGITS}, '1') THEN '+' || {_DIGITS} ELSE '+1' || regexp_replace({_DIGITS}, '^0', '') END AS e164 FROM dirty_customer""")
steps("name_first", "dirty_customer", ["id", "person"], [("parseField", {"column": "person", "kind": "name", "part": "first"})], "SELECT id, CASE id % 3 WHEN 0 THEN 'Ada' WHEN 1 THEN 'Grace Brewster' ELSE 'Cher' END AS person FROM dirty_customer")
steps("name_last", "dirty_customer", ["id", "person"], [("parseField", {"column": "person", "kind": "name", "part": "last"})], "SELECT id, CASE id % 3 WHEN 0 THEN 'Lovelace' WHEN 1 THEN 'Hopper' ELSE '' END AS person FROM dirty_customer")

# -- rows ---------------------------------------------------------------------------------------------

_LT = _NUM.format("amount")
for _op, _value, _where in (
    ("eq", "BUILDING", "coalesce(segment, '') = 'BUILDING'"),
    ("neq", "BUILDING", "coalesce(segment, '') <> 'BUILDING'"),
    ("contains", "uil", "contains(lower(coalesce(segment, '')), 'uil')"),
    ("notContains", "UIL", "NOT contains(lower(coalesce(segment, '')), 'uil')"),
    ("empty", None, "segment IS NULL OR trim(segment) = ''"),
    ("notEmpty", None, "NOT (segment IS NULL OR trim(segment) = '')"),
    ("unknown", None, "true"),
):
    steps(f"filter_{_op}", "dirty_customer", ["id", "segment"], [("filterRows", {"column": "segment", "op": _op, "value": _value})], f"SELECT id, segment FROM dirty_customer WHERE {_where}")
for _op, _sign in (("gt", ">"), ("lt", "<"), ("gte", ">="), ("lte", "<=")):
    steps(f"filter_{_op}", "dirty_customer", ["id", "amount"], [("filterRows", {"column": "amount", "op": _op, "value": "1,004"})], f"SELECT id, amount FROM dirty_customer WHERE {_LT} {_sign} 1004")
steps("filter_number", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], [("filterRows", {"column": "l_quantity", "op": "gte", "value": "49"})], "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49")
steps("remove_empty_columns", "dirty_customer", ["id", "name", "empty_col", "flag"], [("removeEmptyColumns", {})], "SELECT id, name, flag FROM dirty_customer")


@query("SELECT segment, phone, amount FROM dirty_customer WHERE trim(coalesce(segment, '')) <> '' OR trim(phone) <> '' OR trim(amount) <> ''")
def remove_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_customer")
    return apply(t.with_metas(t.pick(["segment", "phone", "amount"])), "removeEmptyRows").to_df()


_GAP = "nullif(trim(event_type), '')"
steps("fill_down", "dirty_events", ["id", "event_type", "value"], [("fillDown", {"columns": ["event_type", "value"]})], f"SELECT id, last_value({_GAP} IGNORE NULLS) OVER w AS event_type, last_value(value IGNORE NULLS) OVER w AS value FROM dirty_events WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
steps("fill_up", "dirty_events", ["id", "event_type"], [("fillMissing", {"column": "event_type", "strategy": "up"})], f"SELECT id, first_value({_GAP} IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS event_type FROM dirty_events")
steps("fill_constant", "dirty_events", ["id", "event_type"], [("fillMissing", {"column": "event_type", "strategy": "constant", "value": "other"})], f"SELECT id, CASE WHEN {_GAP} IS NULL THEN 'other' ELSE event_type END AS event_type FROM dirty_events")
steps("fill_median", "dirty_events", ["id", "value"], [("fillMissing", {"column": "value", "strategy": "median"})], "SELECT id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty_events)) AS value FROM dirty_events")
steps("fill_mean", "dirty_customer", ["id", "amount"], [("fillMissing", {"column": "amount", "strategy": "mean"})], f"SELECT id, CASE WHEN trim(amount) = '' THEN (SELECT {_SHOW.format('m')} FROM (SELECT floor(avg({_LT}) * 1e6 + 0.5) / 1e6 AS m FROM dirty_customer)) ELSE amount END AS amount FROM dirty_customer")
steps("fill_mode", "dirty_customer", ["id", "segment"], [("fillMissing", {"column": "segment", "strategy": "mode"})], "SELECT id, CASE WHEN segment IS NULL OR trim(segment) = '' THEN (SELECT arg_max(segment, struct_pack(n := n, l := -l)) FROM (SELECT segment, count(*) AS n, max(id) AS l FROM dirty_customer WHERE trim(segment) <> '' GROUP BY segment)) ELSE segment END AS segment FROM dirty_customer")
steps("dedupe_key_first", "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], [("dedupeRows", {"columns": ["o_custkey", "o_orderstatus"]})], "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")


@query("SELECT event_type, user_id FROM (SELECT coalesce(event_type, '') AS k, event_type, user_id, row_number() OVER (PARTITION BY coalesce(event_type, ''), user_id ORDER BY id) AS rn FROM dirty_events) WHERE rn = 1")
def dedupe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_events")
    return apply(t.with_metas(t.pick(["event_type", "user_id"])), "dedupeRows").to_df(["event_type", "user_id"]).select("event_type", "user_id")


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(source(spark, sf_dir, "documents", ["doc_id", "text"]), "dedupeRows", {"columns": ["text"]}).to_df()


_MAP = {"building": "Building", "BUILDING": "Building", "machinery": "Machinery", "MACHINERY ": "Machinery"}
steps("cluster_merge_map", "dirty_customer", ["id", "segment"], [("clusterMerge", {"column": "segment", "mapping": _MAP})], "SELECT id, CASE " + " ".join(f"WHEN segment = '{k}' THEN '{v}'" for k, v in _MAP.items()) + " ELSE segment END AS segment FROM dirty_customer")
_LARGE = {f"Customer#{i:09d}": f"c{i}" for i in range(0, 400, 3)} | {f"x{i}": "y" for i in range(200)}
steps("cluster_merge_table", "dirty_customer", ["id", "name"], [("clusterMerge", {"column": "name", "mapping": _LARGE})], "SELECT id, CASE WHEN regexp_matches(name, '^Customer#[0-9]{9}$') AND CAST(substr(name, 10) AS INT) < 400 AND CAST(substr(name, 10) AS INT) % 3 = 0 THEN 'c' || CAST(CAST(substr(name, 10) AS INT) AS VARCHAR) ELSE name END AS name FROM dirty_customer")

# -- formulas --------------------------------------------------------------------------------------------


def formulas(name: str, table: str, key: str, columns: list[str], exprs: dict[str, tuple[str, str]]) -> None:
    """A query of several formula columns: name to (formula, SQL)."""
    ops = [("expression", {"expr": f, "mode": "new", "name": n}) for n, (f, _) in exprs.items()]
    steps(f"formula_{name}", table, [key, *columns], ops, f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, (_, s) in exprs.items()) + f" FROM {table}", [key, *exprs])


formulas("text", "dirty_customer", "id", ["name", "segment", "person"], {
    "f_upper": ("upper(segment)", "upper(coalesce(segment, ''))"),
    "f_lower": ("lower($segment)", "lower(coalesce(segment, ''))"),
    "f_trim": ("trim([name])", "trim(name)"),
    "f_title": ("title(name)", _TITLE.format("name")),
    "f_len": ("len(segment)", "CAST(length(coalesce(segment, '')) AS DOUBLE)"),
    "f_replace": ("replace(name, '#', '-')", "replace(name, '#', '-')"),
    "f_concat": ("concat(name, '/', segment, 1)", "name || '/' || coalesce(segment, '') || '1'"),
    "f_split": ("split(name, '#')", "string_split(name, '#')[1]"),
    "f_part": ("part(name, '#', 1)", "coalesce(string_split(name, '#')[2], '')"),
    "f_coalesce": ("coalesce(segment, 'none')", "coalesce(nullif(segment, ''), 'none')"),
    "f_regex": ("regexReplace(name, '[0-9]+', '<$&>')", r"regexp_replace(name, '[0-9]+', '<\0>', 'g')"),
    "f_regex_columns": ("regexReplace(name, concat('[', len(name) % 10, '#]+'), concat('<$&', segment, '>'))", r"regexp_replace(name, '[' || CAST(length(name) % 10 AS VARCHAR) || '#]+', '<\0' || coalesce(segment, '') || '>', 'g')"),
})
formulas("substr", "dirty_customer", "id", ["name"], {
    "f_from": ("substr(name, 3)", "substr(name, 4)"),
    "f_some": ("substr(name, 2, 5)", "substr(name, 3, 5)"),
    "f_end": ("substr(name, -4, 2)", "substr(name, greatest(length(name) - 4, 0) + 1, 2)"),
    "f_far": ("substr(name, 0 - 99, 3)", "substr(name, 1, 3)"),
})
formulas("tests", "dirty_customer", "id", ["name", "segment"], {
    "f_contains": ("contains(name, 'CUST')", "contains(name, 'CUST')"),
    "f_starts": ("startsWith(name, 'Cust')", "starts_with(name, 'Cust')"),
    "f_ends": ("endsWith(name, '7')", "suffix(name, '7')"),
    "f_if": ("if(contains(name, '#'), 'yes', 'no')", "CASE WHEN contains(name, '#') THEN 'yes' ELSE 'no' END"),
    "f_if_mixed": ("if(segment == '', 0, segment)", "CASE WHEN coalesce(segment, '') = '' THEN '0' ELSE segment END"),
    "f_and": ("segment && name", "CASE WHEN coalesce(segment, '') <> '' THEN name ELSE segment END"),
    "f_or": ("segment || 'blank'", "CASE WHEN coalesce(segment, '') <> '' THEN segment ELSE 'blank' END"),
    "f_eq": ("segment == 'BUILDING'", "coalesce(segment, '') = 'BUILDING'"),
    "f_ne": ("segment != null", "coalesce(segment, '') <> ''"),
})
formulas("numbers", "dirty_customer", "id", ["amount"], {
    "f_number": ("number(amount)", _LT),
    "f_minus": ("amount - 1", f"coalesce({_LT} - 1, 'nan')"),
    "f_times": ("amount * 2", f"coalesce({_LT} * 2, 'nan')"),
    "f_div": ("amount / 4", f"coalesce({_LT} / 4, 'nan')"),
    "f_mod": ("amount % 7", f"coalesce({_LT} % 7, 'nan')"),
    "f_plus_text": ("amount + 1", "amount || '1'"),
    "f_neg": ("-number(amount)", f"coalesce(-({_LT}), 'nan')"),
    "f_round": ("round(amount / 3, 2)", f"coalesce(floor(({_LT} / 3) * 100 + 0.5) / 100, 'nan')"),
    "f_abs": ("abs(0 - amount)", f"coalesce(abs(0 - {_LT}), 'nan')"),
    "f_lt": ("amount < 500", f"coalesce({_LT} < 500, false)"),
    "f_ge": ("amount >= 500", f"coalesce({_LT} >= 500, false)"),
    "f_prec": ("2 + 3 * 4 - (1 + 1) * 2", "CAST(10 AS DOUBLE)"),
})
formulas("typed", "part", "p_partkey", ["p_name", "p_size", "p_retailprice"], {
    "f_sum": ("p_size + p_retailprice", "p_size + p_retailprice"),
    "f_str": ("str(p_size) + 'cm'", "CAST(p_size AS VARCHAR) || 'cm'"),
    "f_zero": ("p_size / 0", "CAST('inf' AS DOUBLE)"),
    "f_nan": ("(p_size - p_size) / 0", "CAST('nan' AS DOUBLE)"),
    "f_mod_zero": ("p_size % 0", "CAST('nan' AS DOUBLE)"),
    "f_nan_text": ("str(0 / 0) + p_size", "'NaN' || CAST(p_size AS VARCHAR)"),
    "f_nan_true": ("if(0 / 0, 'a', 'b')", "'a'"),
    "f_nan_or": ("number(0 / 0) || p_name", "p_name"),
    "f_missing": ("coalesce(no_such, p_name)", "p_name"),
    "f_gt": ("p_size > 25 && p_retailprice > 1000", "p_size > 25 AND p_retailprice > 1000"),
})
steps("formula_replace", "dirty_customer", ["id", "name"], [("expression", {"expr": "upper(trim(value)) + '!'", "mode": "replace", "target": "name"})], "SELECT id, upper(trim(name)) || '!' AS name FROM dirty_customer")

# -- similarity --------------------------------------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "part", ["p_partkey", "p_name"])
    return similarity.value_counts(t, "p_name")


_PAIRS = "WITH v AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b FROM v a JOIN v b ON a.p_name < b.p_name) "


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct part names, of which there are a few dozen at any size."""
    names = _names(spark, sf_dir)
    return names.select(F.col("value").alias("a")).join(names.select(F.col("value").alias("b")), F.col("a") < F.col("b"))


@query(_PAIRS + "SELECT a, b, CAST(levenshtein(a, b) AS BIGINT) AS distance FROM p")
def lev_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", similarity.levenshtein(F.col("a"), F.col("b")).cast("long").alias("distance"))


@query(_PAIRS + "SELECT a, b, 1.0::DOUBLE - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) AS similarity FROM p")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", similarity.edit_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("WITH v AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b FROM v a JOIN v b ON a.p_name < b.p_name WHERE jaro_winkler_similarity(a.p_name, b.p_name) >= 0.9")
def jw_pairs_090(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _names(spark, sf_dir).select(F.col("first").alias("id"), F.col("value").alias("s"))
    pairs = similarity.similar_pairs(items, 0.9)
    of = lambda k: items.select(F.col("id").alias(k), F.col("s").alias(f"s{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))


_CLUSTER = """
WITH v AS (SELECT segment AS value, count(*) AS n, min(id) AS f FROM dirty_customer WHERE trim(segment) <> '' GROUP BY 1),
k AS (SELECT *, {0} AS k FROM v)
SELECT k AS key, arg_max(value, struct_pack(n := n, f := -f)) AS suggestion, CAST(sum(n) AS BIGINT) AS total FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1"""
_FINGER = r"array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(trim(value)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '))), ' ')"
_GRAMS = "regexp_replace(lower(value), '[^a-z0-9]', '', 'g')"
_NGRAM = f"CASE WHEN length({_GRAMS}) < 2 THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, length({_GRAMS})), lambda i: substr({_GRAMS}, i, 2)))), '') END"


def _clusters(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return similarity.clusters(source(spark, sf_dir, "dirty_customer", ["id", "segment"]), "segment", method).select("key", "suggestion", "total")

    return run


for _method, _key in (("fingerprint", _FINGER), ("ngram", _NGRAM)):
    QUERIES[f"{_method}_clusters"] = _clusters(_method)
    ORACLES[f"{_method}_clusters"] = dirty(_CLUSTER.format(_key))


@query("""
WITH RECURSIVE v AS (SELECT p_name AS value, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY f) AS i FROM v),
g(i, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(f BIGINT, s VARCHAR)[])
  UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(leaders, lambda l: jaro_winkler_similarity(l.s, lower(o.value)) >= 0.85)) > 0 THEN leaders ELSE list_append(leaders, {'f': o.f, 's': lower(o.value)}) END
  FROM g JOIN o ON o.i = g.i + 1),
l AS (SELECT unnest(leaders, recursive := true) FROM (SELECT leaders FROM g ORDER BY i DESC LIMIT 1)),
m AS (SELECT o.value, o.n, o.f, min(l.f) AS leader FROM o JOIN l ON l.f <= o.f AND jaro_winkler_similarity(l.s, lower(o.value)) >= 0.85 GROUP BY ALL)
SELECT 'nn_' || leader AS key, arg_max(value, struct_pack(n := n, f := -f)) AS suggestion, CAST(sum(n) AS BIGINT) AS total, min(f) AS first, list(value ORDER BY n DESC, f) AS values
FROM m GROUP BY leader HAVING count(*) > 1""")
def nearest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.clusters(source(spark, sf_dir, "part", ["p_partkey", "p_name"]), "p_name", "levenshtein", 0.85)


@query("WITH k AS (SELECT lower(p_name) AS k, min(p_partkey) AS f FROM part GROUP BY 1) SELECT p_partkey, f AS leader FROM part JOIN k ON lower(p_name) = k")
def fuzzy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each row's key."""
    t = source(spark, sf_dir, "part", ["p_partkey", "p_name"])
    keyed = t.df.select(F.col(RID).alias("p_partkey"), similarity.fuzzy_key(t, ["p_name"]).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("p_partkey").alias("leader")), "k").select("p_partkey", "leader")


@query(("\nWITH v AS (SELECT segment AS value, count(*) AS n, min(id) AS f FROM dirty_customer WHERE trim(segment) <> '' GROUP BY 1), k AS (SELECT *, lower(trim(value)) AS k, count(*) OVER (PARTITION BY lower(trim(value))) AS c FROM v) SELECT value, first_value(value) OVER (PARTITION BY k ORDER BY n DESC, f) AS suggestion FROM k WHERE c > 1"))
def cluster_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping that accepts all clusters (the segments hold one word each)."""
    found = similarity.clusters(source(spark, sf_dir, "dirty_customer", ["id", "segment"]), "segment")
    return spark.createDataFrame(list(similarity.mapping_of(found).items()), "value string, suggestion string")


def _fuzzy(survivorship: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = source(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
        if survivorship == "mostComplete":  # some rows lack a cell
            t = apply(t, "expression", {"expr": "if(p_partkey % 3 == 0, '', p_brand)", "mode": "replace", "target": "p_brand"})
        return apply(t, "fuzzyDedupe", {"columns": ["p_name"], "threshold": 0.85, "survivorship": survivorship}).to_df()

    return run


#: The greedy rule, row after row, with a bit for each row that is gone (the tables that SQL is held against have up to BITS rows).
BITS = 2_048
_SETTLE = """
WITH RECURSIVE t AS (SELECT p_partkey, p_name, {brand} AS brand, lower(p_name) AS s, CAST({blanks} AS INT) AS blanks, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part),
k AS (SELECT DISTINCT s FROM t),
p AS (SELECT a.s AS a, b.s AS b FROM k a JOIN k b ON substr(a.s, 1, 1) = substr(b.s, 1, 1) AND (a.s = b.s OR jaro_winkler_similarity(a.s, b.s) >= 0.85)),
m AS (SELECT a.i, bitstring_agg(b.i, 0, {last}) AS later, bitstring_agg(CASE WHEN {swap} THEN b.i END, 0, {last}) AS swaps FROM t a JOIN p ON a.s = p.a JOIN t b ON b.s = p.b AND b.i > a.i GROUP BY a.i),
n AS MATERIALIZED (SELECT t.i, coalesce(later, CAST(repeat('0', {bits}) AS BIT)) AS later, coalesce(swaps, CAST(repeat('0', {bits}) AS BIT)) AS swaps FROM t LEFT JOIN m USING (i)),
g(i, gone) AS (
  SELECT CAST(-1 AS BIGINT), CAST(repeat('0', {bits}) AS BIT)
  UNION ALL
  SELECT n.i, CASE WHEN get_bit(gone, CAST(n.i AS INT)) = 1 THEN gone
    WHEN bit_position('1', n.swaps & ~gone) = 0 THEN gone | n.later
    ELSE gone | (n.later & CAST(repeat('1', bit_position('1', n.swaps & ~gone) - 1) || repeat('0', {bits} + 1 - bit_position('1', n.swaps & ~gone)) AS BIT)) | CAST(repeat('0', n.i) || '1' || repeat('0', {last} - n.i) AS BIT) END
  FROM g JOIN n ON n.i = g.i + 1)
SELECT p_partkey, p_name, brand AS p_brand FROM t WHERE get_bit((SELECT gone FROM g ORDER BY i DESC LIMIT 1), CAST(i AS INT)) = 0"""
for _s, _swap in (("first", "false"), ("longest", "length(b.s) > length(a.s)"), ("mostComplete", "b.blanks < a.blanks")):
    _some = _s == "mostComplete"
    QUERIES[f"fuzzy_dedupe_{_s}"] = _fuzzy(_s)
    ORACLES[f"fuzzy_dedupe_{_s}"] = _SETTLE.format(bits=BITS, last=BITS - 1, swap=_swap, brand="CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END" if _some else "p_brand", blanks="CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END" if _some else "0")

# -- analysis ------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('amount','text'), ('empty_col','text'), ('flag','text'), ('id','integer'), ('name','text'), ('person','text'), ('phone','text'), ('segment','text')) AS t(name, type)")
def detect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_customer")
    found = analysis.detect_types(t)
    return spark.createDataFrame([(m.name, found[m.id]) for m in t.metas], "name string, type string")


@query("SELECT count(*) AS total, count(l_quantity) AS filled, CAST(0 AS BIGINT) AS blank, count(DISTINCT l_quantity) AS \"distinct\", min(l_quantity) AS min, max(l_quantity) AS max, sum(l_quantity) / count(*) AS mean, quantile_cont(l_quantity, 0.5) AS median, sum(l_quantity) AS sum FROM lineitem")
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    return analysis.profile_frame(t, t.find("l_quantity")).drop("std")


@query("SELECT round(stddev_pop(l_quantity), 9) AS std FROM lineitem")
def profile_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    return analysis.profile_frame(t, t.find("l_quantity")).select(F.round("std", 9).alias("std"))


@query("SELECT count(*) AS total, count(*) FILTER (trim(segment) <> '') AS filled, count(*) FILTER (segment IS NULL OR trim(segment) = '') AS blank, count(DISTINCT segment) FILTER (trim(segment) <> '') AS \"distinct\", CAST(min(length(segment)) FILTER (trim(segment) <> '') AS INT) AS \"minLen\", CAST(max(length(segment)) FILTER (trim(segment) <> '') AS INT) AS \"maxLen\", avg(length(segment)) FILTER (trim(segment) <> '') AS \"avgLen\" FROM dirty_customer")
def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_customer", ["id", "segment"])
    return analysis.profile_frame(t, t.find("segment"))


@query(f"SELECT count(*) AS total, count(*) FILTER (order_date <> '') AS filled, count(*) FILTER (order_date = '') AS blank, count(DISTINCT order_date) FILTER (order_date <> '') AS \"distinct\", min(coalesce({_ISO.format('order_date')}, nullif(order_date, ''))) AS min, max(coalesce({_ISO.format('order_date')}, nullif(order_date, ''))) AS max FROM dirty_orders")
def profile_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_orders", ["id", "order_date"])
    t = from_df(t.to_df(rid=True), RID, {"order_date": cells.DATE}, drop_order=True)
    return analysis.profile_frame(t, t.find("order_date"))


@query("WITH r AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 14 AS w FROM part) SELECT CAST(b AS INT) AS bin, lo + b * w AS lo, lo + (b + 1) * w AS hi, (SELECT count(*) FROM part WHERE least(13, floor((p_retailprice - lo) / w)) = b) AS n FROM r, range(14) AS x(b)")
def histogram_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(source(spark, sf_dir, "part", ["p_partkey", "p_retailprice"]), "p_retailprice")


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def facet_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.facet(source(spark, sf_dir, "part", ["p_partkey", "p_brand"]), "p_brand")


@query("""
SELECT 'name' AS name, count(*) FILTER (trim(name) = '') AS blanks, count(*) FILTER (name <> trim(name) OR contains(name, '  ')) AS stray FROM dirty_customer UNION ALL
SELECT 'segment', count(*) FILTER (segment IS NULL OR trim(segment) = ''), count(*) FILTER (segment <> trim(segment) OR contains(segment, '  ')) FROM dirty_customer UNION ALL
SELECT 'person', count(*) FILTER (trim(person) = ''), count(*) FILTER (person <> trim(person) OR contains(person, '  ')) FROM dirty_customer""")
def quality_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.quality(source(spark, sf_dir, "dirty_customer", ["id", "name", "segment", "person"]))
    return spark.createDataFrame([(c.name, c.blanks, c.stray) for c in found["columns"] if c.name != "id"], "name string, blanks long, stray long")


#: One row a column of the dirty customers: name, place and cells as text.
_CELLS = ", ".join(f"({i}, '{c}', CAST({c} AS VARCHAR))" for i, c in enumerate(("id", "name", "segment", "phone", "amount", "flag", "person", "empty_col")))
_LONG = f"long AS (SELECT id, u.spot, u.col, u.x FROM dirty_customer, LATERAL (VALUES {_CELLS}) AS u(spot, col, x))"
_FORMS = "forms AS (SELECT spot, col, lower(trim(x)) AS k, x AS value, count(*) AS n FROM long WHERE trim(coalesce(x, '')) <> '' AND col <> 'id' GROUP BY ALL), variants AS (SELECT spot, col, k FROM forms GROUP BY ALL HAVING count(*) > 1)"
_STRAY = "count(*) FILTER (x <> trim(x) OR contains(x, '  '))"


def _dirty_long(sql: str) -> str:
    return f"WITH {_LONG}, {_FORMS}, {sql}"


_IS = {"int": "regexp_matches(x, '^-?[0-9]{1,15}$')", "dec": "regexp_matches(x, '^-?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)(\\.[0-9]+)?$')", "bool": "lower(trim(x)) IN ('true','yes','y','1','false','no','n','0')"}


@query((_dirty_long(f"""c AS (
  SELECT spot, count(*) AS n, count(*) FILTER (trim(coalesce(x, '')) = '') AS blanks, {_STRAY} AS stray, count(x) FILTER (x <> '') AS filled,
    count(*) FILTER ({_IS['int']}) AS ints, count(*) FILTER ({_IS['dec']}) AS decs, count(*) FILTER ({_IS['bool']}) AS bools FROM long GROUP BY spot),
q AS (SELECT c.*, spot > 0 AND filled > 0 AND (bools = filled OR ints >= 0.95 * filled OR decs >= 0.95 * filled) AS looks, spot IN (SELECT spot FROM variants) AS varies FROM c),
d AS (SELECT coalesce(sum(m - 1), 0) AS dups FROM (SELECT count(*) AS m FROM dirty_customer GROUP BY id, name, segment, phone, amount, flag, person)),
e AS (SELECT 1 - sum(blanks) / sum(n) AS complete, count(*) FILTER (blanks > 0 OR (spot > 0 AND stray > 0) OR looks OR varies) AS bad FROM q)
SELECT CAST(greatest(0, floor(complete * 100 - least(15, 3 * dups) - least(20, 4 * bad) + 0.5)) AS INT) AS score, CAST(dups AS BIGINT) AS duplicates, CAST(complete AS DOUBLE) AS completeness FROM d, e""")))
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_customer")
    found = analysis.quality(t)
    return spark.createDataFrame([(found["score"], found["duplicates"], found["completeness"])], "score int, duplicates long, completeness double")


@query("SELECT count(*) AS \"rows\", CAST(3 AS BIGINT) AS cols, count(*) * 3 AS \"totalCells\", count(*) FILTER (segment IS NULL OR trim(segment) = '') + count(*) FILTER (phone = '') AS \"emptyCells\" FROM dirty_customer")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.dataset_stats(source(spark, sf_dir, "dirty_customer", ["id", "segment", "phone"]))
    return spark.createDataFrame([tuple(found.values())], "rows long, cols long, totalCells long, emptyCells long")


@query((_dirty_long(f"""s AS (SELECT spot, col FROM long WHERE spot > 0 GROUP BY ALL HAVING {_STRAY} > 0),
r AS (
  SELECT 0 AS a, 0 AS b, 'trim' AS id, 'trim' AS type, 'Trim spaces in ' || (SELECT count(*) FROM s) || ' columns' AS label
  UNION ALL SELECT 2, 0, 'empty_cols', 'removeEmptyColumns', 'Remove empty columns'
  UNION ALL SELECT DISTINCT 5, spot, 'case_' || col, 'clusterMerge', 'Merge case variants in ' || col FROM variants)
SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS place, id, type, label FROM r""")))
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.suggestions(source(spark, sf_dir, "dirty_customer"))
    return spark.createDataFrame([(i, o.id, o.type, o.label) for i, o in enumerate(found)], "place int, id string, type string, label string")


# -- views and recipes ---------------------------------------------------------------------------------------


@query("SELECT id, name, segment, CAST(row_number() OVER (ORDER BY name DESC, id) AS BIGINT) AS place FROM dirty_customer WHERE contains(lower(CAST(id AS VARCHAR)), 'auto') OR contains(lower(name), 'auto') OR contains(lower(coalesce(segment, '')), 'auto')")
def view_search_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = search(source(spark, sf_dir, "dirty_customer", ["id", "name", "segment"]), "AUTO")
    place = F.row_number().over(Window.orderBy(*order_by(t, "name", "desc"))).cast("long").alias("place")
    return t.df.select(*[F.col(m.id).alias(m.name) for m in t.metas], place)


_TRIMMED = [("trim", {"columns": ["name"]}), ("filterRows", {"column": "name", "op": "notEmpty"})]


@query(f"SELECT CAST(0 AS BIGINT) AS row_delta, count(*) FILTER (name <> {_COLLAPSE.format('name')}) AS changed FROM dirty_customer")
def step_delta_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_customer", ["id", "name"])
    d = step_delta(t, apply(t, *_TRIMMED[0]))
    return spark.createDataFrame([(d.rows, d.changed)], "row_delta long, changed long")


@query(f"SELECT id, 'name' AS \"column\" FROM dirty_customer WHERE name <> {_COLLAPSE.format('name')}")
def changed_mask_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_customer", ["id", "name"])
    return changed_mask(t, apply(t, *_TRIMMED[0])).select(F.col(RID).alias("id"), "column")


RECIPE = (
    Recipe(name="customers")
    .add("trim", columns=["name", "segment", "person"])
    .add("changeCase", columns=["segment"], mode="upper")
    .add("removeEmptyColumns")
    .add("filterRows", column="segment", op="notEmpty")
    .add("parseField", column="phone", kind="phone", country="1")
    .add("parseField", column="person", kind="name", part="last", into="last")
    .add("expression", expr="number(amount) * 2", mode="new", name="double_amount")
    .add("deleteColumns", columns=["amount", "flag", "person"])
    .add("dedupeRows", columns=["name"])
)


_RECIPE_SQL = f"""SELECT id, name, segment, phone, last, double_amount FROM (
 SELECT id, {_COLLAPSE.format('name')} AS name, upper(trim(segment)) AS segment,
  CASE WHEN {_DIGITS} = '' THEN NULL WHEN starts_with(trim(phone), '+') THEN '+' || {_DIGITS} WHEN starts_with({_DIGITS}, '00') THEN '+' || substr({_DIGITS}, 3) WHEN length({_DIGITS}) = 10 THEN '+1' || {_DIGITS} ELSE '+' || {_DIGITS} END AS phone,
  CASE id % 3 WHEN 0 THEN 'Lovelace' WHEN 1 THEN 'Hopper' ELSE '' END AS last, coalesce({_LT} * 2, 'nan') AS double_amount,
  row_number() OVER (PARTITION BY {_COLLAPSE.format('name')} ORDER BY id) AS rn
 FROM dirty_customer WHERE trim(coalesce(segment, '')) <> '') WHERE rn = 1"""


@query(_RECIPE_SQL)
def recipe_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RECIPE.fold(source(spark, sf_dir, "dirty_customer")).to_df()


@query(_RECIPE_SQL)
def recipe_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recipe as read back from its file."""
    path = scratch_path(spark, ".json")
    files.write_bytes(spark, path, RECIPE.to_json().encode())
    return Recipe.from_json(files.read_bytes(spark, path).decode()).fold(source(spark, sf_dir, "dirty_customer")).to_df()


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (trim(coalesce(segment, '')) <> '') AS m FROM dirty_customer)
SELECT CAST(i AS INT) AS step, CASE WHEN i < 4 THEN n ELSE m END AS "rows", CAST([8, 8, 8, 7, 7, 7, 8, 9, 6, 6][i + 1] AS INT) AS cols FROM c, range(10) AS r(i)""")
def recipe_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns after each step (names are unique in each customer, so none is a duplicate)."""
    every = RECIPE.fold_all(source(spark, sf_dir, "dirty_customer"))
    return spark.createDataFrame([(i, t.df.count(), len(t.metas)) for i, t in enumerate(every)], "step int, rows long, cols int")


@query("""SELECT * FROM (VALUES ('add', 'trim,replace,dedupeRows'), ('move', 'replace,trim,dedupeRows'), ('off', 'replace,trim'), ('redo', 'replace,trim'), ('remove', 'trim'), ('undo', 'replace,trim,dedupeRows')) AS t(edit, steps)""")
def recipe_editing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that run after each edit."""
    run = lambda r: ",".join(o.type for o in r.ops if o.enabled)
    added = Recipe().add("trim", columns=["x"]).add("replace", columns=["x"], find="a", replaceWith="b").add("dedupeRows")
    moved = added.move("op_2", -1)
    off = moved.toggle("op_3")
    edits = {"add": added, "move": moved, "off": off, "undo": off.undo(), "redo": off.undo().redo(), "remove": off.remove("op_2")}
    return spark.createDataFrame([(k, run(r)) for k, r in edits.items()], "edit string, steps string")


@query("SELECT * FROM (VALUES ('none', 'asc'), ('asc', 'desc'), ('desc', 'none')) AS t(now, next)")
def view_sort_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x or "none", sort_cycle(x) or "none") for x in (None, "asc", "desc")], "now string, next string")


@query("SELECT id, name FROM dirty_customer WHERE id % 7 = 0")
def view_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_customer", ["id", "name"])
    return subset(t, t.df.where(F.col(RID) % 7 == 0)).to_df()


@query("SELECT id, name FROM dirty_customer ORDER BY id LIMIT 40 OFFSET 20")
def view_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display's rows: the limit is the feature."""
    t = source(spark, sf_dir, "dirty_customer", ["id", "name"])
    return window(t, 40, 20).select(*[F.col(m.id).alias(m.name) for m in t.metas])


@query("SELECT 'name' AS name, avg(CASE WHEN trim(name) = '' THEN 0.0 ELSE 1.0 END) AS share FROM dirty_customer UNION ALL SELECT 'segment', avg(CASE WHEN trim(coalesce(segment, '')) = '' THEN 0.0 ELSE 1.0 END) FROM dirty_customer UNION ALL SELECT 'empty_col', 0.0")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_customer", ["id", "name", "segment", "empty_col"])
    return spark.createDataFrame([x for x in analysis.completeness(t).items() if x[0] != "id"], "name string, share double")


@query("SELECT CAST(sum(m - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS m FROM dirty_events GROUP BY coalesce(event_type, ''), user_id)")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = source(spark, sf_dir, "dirty_events")
    return spark.createDataFrame([(analysis.duplicate_rows(t.with_metas(t.pick(["event_type", "user_id"]))),)], "duplicates long")


# -- sources and sinks ----------------------------------------------------------------------------------------


def _round_trip(ending: str, write: Callable[[Table, str], None]):
    """A table written and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, ending)
        write(source(spark, sf_dir, "dirty_customer", ["id", "name", "segment", "amount"]), path)
        return files.read(spark, path).to_df()

    return run


_SAME = "SELECT CAST(id AS VARCHAR) AS id, name, segment, amount FROM dirty_customer"
_NO_EMPTY = "SELECT CAST(id AS VARCHAR) AS id, name, nullif(segment, '') AS segment, nullif(amount, '') AS amount FROM dirty_customer"
for _end, _write, _sql in (
    (".csv", files.write_csv, _NO_EMPTY),
    (".tsv", files.write_tsv, _NO_EMPTY),
    (".json", files.write_json, _SAME),
    (".xlsx", files.write_xlsx, _SAME),
    (".parquet", files.write_parquet, "SELECT id, name, segment, amount FROM dirty_customer"),
):
    QUERIES[f"round_trip_{_end[1:]}"] = _round_trip(_end, _write)
    ORACLES[f"round_trip_{_end[1:]}"] = dirty(_sql)


@query("SELECT CAST(id AS VARCHAR) AS id, name, nullif(segment, '') AS segment FROM dirty_customer WHERE contains(lower(CAST(id AS VARCHAR)), 'auto') OR contains(lower(name), 'auto') OR contains(lower(coalesce(segment, '')), 'auto')")
def exported_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, ".csv")
    files.write_view(source(spark, sf_dir, "dirty_customer", ["id", "name", "segment"]), path, "AUTO", "name", "desc")
    return files.read(spark, path).to_df()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"key\", n_name || ' – Zürich' AS place, n_name || ' Zürich' AS old FROM nation")
def text_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 with its mark, and Latin-1, found out from the bytes."""
    names = [(r["n_nationkey"], r["n_name"]) for r in source(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).to_df().collect()]  # one row a nation
    paths = [scratch_path(spark, ".csv") for _ in range(2)]
    files.write_bytes(spark, paths[0], ("key,place\n" + "".join(f"{k},{n} – Zürich\n" for k, n in names)).encode("utf-8-sig"))
    files.write_bytes(spark, paths[1], ("key,old\n" + "".join(f"{k},{n} Zürich\n" for k, n in names)).encode("latin-1"))
    a, b = (files.read(spark, p).to_df() for p in paths)
    return a.join(b, "key")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def rows_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table to rows and back."""
    header, *rows = source(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).rows()
    return files.rows_table(spark, header, rows).to_df()


@query("SELECT * FROM (VALUES ('a.csv', 'csv'), ('b.TSV', 'tsv'), ('c.json', 'json'), ('d.xlsx', 'xlsx'), ('e.XLS', 'xlsx'), ('f.parquet', 'parquet'), ('g.txt', 'csv'), ('h', 'csv')) AS t(path, format)")
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ("a.csv", "b.TSV", "c.json", "d.xlsx", "e.XLS", "f.parquet", "g.txt", "h")
    return spark.createDataFrame([(p, files.format_of(p)) for p in paths], "path string, format string")


@query("SELECT * FROM (VALUES ('2021-05-02', 2), ('2021-06-17', 2), ('2021-07-30', 2), ('2021-08-31', 2), ('2021-12-25', 2), ('99/99/2021', 1)) AS t(day, n)")
def sample_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls a day in the built-in sample, its dates brought to one form."""
    t = apply(apply(sample_table(spark), "removeEmptyRows"), "standardizeDate", {"column": "Arrived"})
    return t.to_df(["Arrived"]).groupBy(F.col("Arrived").alias("day")).agg(F.count("*").cast("int").alias("n"))
