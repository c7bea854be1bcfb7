"""Cell rules as Column expressions: white space, blanks, rendering, numbers, dates, phones, names.

A cell is text unless its column is typed. Everything here is built in Spark functions, so a
recipe of such steps is one projection that Catalyst folds and generates code for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the cell rules (it includes NBSP, Unicode spaces and the BOM).
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Tokens read as booleans.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
TEXT, INTEGER, DECIMAL, DATE, BOOLEAN = "text", "integer", "decimal", "date", "boolean"
LOGICAL = (TEXT, INTEGER, DECIMAL, DATE, BOOLEAN)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Ends stripped, each run of white space one space."""
    return F.regexp_replace(F.regexp_replace(c, rf"{SPACE}+", " "), "^ | $", "")


def render(c: Column, spark_type: str) -> Column:
    """A cell as text; whole numbers print without a fraction. Null stays null."""
    if spark_type == "string":
        return c
    if spark_type in ("double", "float"):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(F.isnan(d), "NaN").when(F.abs(d) == float("inf"), F.when(d > 0, "Infinity").otherwise("-Infinity")).when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
    if spark_type.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if spark_type.startswith(("array", "map", "struct")):
        return F.to_json(c)
    return c.cast("string")


def text(c: Column, spark_type: str) -> Column:
    """As render, with null as the empty text."""
    return F.coalesce(render(c, spark_type), F.lit(""))


def blank(c: Column, spark_type: str = "string") -> Column:
    """Null, empty or white space only; a typed cell is blank if null."""
    return F.coalesce(~c.rlike(rf"[^{SPACE[1:]}"), F.lit(True)) if spark_type == "string" else c.isNull()


def number(c: Column, spark_type: str = "string") -> Column:
    """The number that a cell begins with, commas left out; null if none. Booleans are none."""
    if spark_type == "string":
        bare = F.regexp_replace(c, ",", "")
        return F.regexp_extract(bare, rf"^{SPACE}*({NUMBER})", 1).try_cast("double")
    if spark_type in ("boolean", "void", "date") or spark_type.startswith(("timestamp", "array", "map", "struct")):
        return F.lit(None).cast("double")
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def half_up(x: Column, places: int | Column) -> Column:
    """Rounded to so many places, halves towards plus infinity."""
    f = F.pow(F.lit(10.0), places if isinstance(places, Column) else F.lit(float(places)))
    y = x * f
    return F.when(~F.isnan(y) & (F.abs(y) < 2.0**52), F.floor(y + 0.5).cast("double") / f).otherwise(x)


def half_away(x: Column, places: int) -> Column:
    """Rounded to so many places, halves away from zero."""
    f = F.lit(10.0**places)
    return F.when(F.abs(x * f) < 2.0**52, F.round(x * f) / f).otherwise(x)


def title(c: Column) -> Column:
    """Each run that begins with a word character: first upper, rest lower."""
    runs = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_][^\s]*|[^A-Za-z0-9_]"), F.lit(0))
    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))).otherwise(t)), "")


def change_case(c: Column, mode: str) -> Column:
    return F.upper(c) if mode == "upper" else F.lower(c) if mode == "lower" else title(c)


# -- dates ------------------------------------------------------------------------------------

# The accepted forms of a date, in order.
YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$"
YEAR_LAST = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"
DAY_NAME = r"^([0-9]{1,2})[ ]+([A-Za-z]{3,})\.?[ ]+([0-9]{4})$"
NAME_DAY = r"^([A-Za-z]{3,})\.?[ ]+([0-9]{1,2}),?[ ]+([0-9]{4})$"


def _iso(y: Column, m: Column, d: Column) -> Column:
    ok = m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))


def normalize_date(c: Column) -> Column:
    """ISO text of a date in one of four forms, else null. Ambiguous dates are day first;
    a day up to 31 is accepted in any month."""
    t = F.regexp_replace(strip(c), r"[\t ]", " ")
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    month = lambda p, i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(t, p, i), 1, 3))), F.lit(0)).cast("int")
    a, b, y = part(YEAR_LAST, 1), part(YEAR_LAST, 2), part(YEAR_LAST, 3)
    month_first = (b > 12) & (a <= 12)
    return F.coalesce(
        F.when(t.rlike(YEAR_FIRST), _iso(part(YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3))),
        F.when(t.rlike(YEAR_LAST), _iso(y, F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a))),
        F.when(t.rlike(DAY_NAME), _iso(part(DAY_NAME, 3), month(DAY_NAME, 2), part(DAY_NAME, 1))),
        F.when(t.rlike(NAME_DAY), _iso(part(NAME_DAY, 3), month(NAME_DAY, 1), part(NAME_DAY, 2))),
    )


_DAY, _MONTH = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])"
_NAMED = "(?i:" + "|".join(MONTHS) + r")[A-Za-z]*\.?"
IS_DATE = rf"^(?:[0-9]{{4}}[-/.]{_MONTH}[-/.]{_DAY}|(?:{_DAY}[-/.]{_MONTH}|{_MONTH}[-/.]{_DAY})[-/.][0-9]{{4}}|{_DAY} +{_NAMED} +[0-9]{{4}}|{_NAMED} +{_DAY},? +[0-9]{{4}})$"


def is_date(c: Column) -> Column:
    """Whether normalize_date gives a date, by one pattern: for counting over whole tables."""
    return F.regexp_replace(strip(c), r"[\t ]", " ").rlike(IS_DATE)


# -- phones and names ---------------------------------------------------------------------------


def phone(c: Column, country: str = "1") -> Column:
    """International form of a phone number; null without digits."""
    t = strip(c)
    d = F.regexp_replace(t, "[^0-9]", "")
    home = F.when(F.lit(country == "1") & (F.length(d) == 10), F.concat(F.lit("+1"), d)).when(F.lit(country == "1") & (F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d)).otherwise(F.concat(F.lit(f"+{country}"), F.regexp_replace(d, "^0", "")))
    return F.when(d == "", F.lit(None).cast("string")).when(t.startswith("+"), F.concat(F.lit("+"), d)).when(d.startswith("00"), F.concat(F.lit("+"), F.substring(d, F.lit(3), F.length(d)))).otherwise(home)


def name_part(c: Column, part: str = "first") -> Column:
    """First or last name: "Last, First" or words, of which the last is the last name."""
    t = collapse(c)
    pieces = F.transform(F.split(t, ","), lambda p: F.regexp_replace(p, "^ | $", ""))
    words = F.split(t, " ")
    n = F.size(words)
    if part == "last":
        plain = F.when(n > 1, F.element_at(words, -1)).otherwise("")
        return F.when(t.contains(","), F.get(pieces, 0)).when(t.isNotNull(), plain)
    plain = F.when(n > 1, F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), " ")).otherwise(t)
    return F.when(t.contains(","), F.get(pieces, 1)).when(t.isNotNull(), plain)


# -- types ----------------------------------------------------------------------------------------

# What counts as an integer and as a decimal.
IS_INTEGER = r"^-?[0-9]{1,15}$"
IS_DECIMAL = r"^-?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)(\.[0-9]+)?$"


def is_integer(t: Column) -> Column:
    return t.rlike(IS_INTEGER)


def is_decimal(t: Column) -> Column:
    return t.rlike(IS_DECIMAL)


def is_boolean(t: Column) -> Column:
    return F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS)


def coerce(c: Column, spark_type: str, to: str) -> tuple[Column, Column]:
    """A cell in its new type, and the same as text, where a cell that can't be read keeps
    its text."""
    t = F.nullif(render(c, spark_type), F.lit(""))
    bare = F.regexp_replace(t, ",", "")
    if to == INTEGER:
        x = F.regexp_extract(bare, rf"^{SPACE}*([+-]?[0-9]+)", 1).try_cast("long")
        return x, F.coalesce(x.cast("string"), t)
    if to == DECIMAL:
        x = number(t)
        return x, F.coalesce(render(x, "double"), t)
    if to == BOOLEAN:
        low = F.lower(strip(t))
        x = F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
        return x, F.coalesce(x.cast("string"), t)
    if to == DATE:
        x = normalize_date(t)
        return x, F.coalesce(x, t)
    return strip(t), strip(t)
