"""The formula language, compiled to Column expressions with static types.

Lexer and precedence-climbing parser give an AST; the compiler types each node as text,
number, truth or null and renders to text where branches differ, so a formula is part of
the projection that Catalyst sees. What is no number is NaN as soon as arithmetic reads it,
and stays so: NaN is no blank, it is true, prints as NaN, and no comparison with it holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cells
from .patterns import groups, java_pattern, java_replacement, replace_by_column


class FormulaError(ValueError):
    """The formula can't be read, or names an unknown function."""


# -- reading --------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>[0-9.]+)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|\$(?P<dollar>[A-Za-z0-9_]+)|\[(?P<name>[^\]]*)\]|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>==|!=|<=|>=|&&|\|\||[-+*/%<>(),]))""",
    re.DOTALL,
)
# How strongly binary operators bind.
PRECEDENCE = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


@dataclass(frozen=True)
class Node:
    kind: str  # lit, value, col, unary, bin, call
    value: object = None
    parts: tuple[Node, ...] = ()


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise FormulaError(f"unexpected character at {at + len(source[at:]) - len(source[at:].lstrip())}")
        kind = m.lastgroup
        out.append(("name" if kind == "dollar" else kind, m.group(kind)))
        at = m.end()
    return out


def _unescape(raw: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)


def parse(source: str) -> Node:
    tokens = _tokens(source)
    at = 0

    def peek(op: str | None = None) -> bool:
        return at < len(tokens) and (op is None or tokens[at] == ("op", op))

    def take(op: str) -> None:
        nonlocal at
        if not peek(op):
            raise FormulaError(f"expected {op}")
        at += 1

    def primary() -> Node:
        nonlocal at
        if not peek():
            raise FormulaError("unexpected end")
        kind, raw = tokens[at]
        at += 1
        if kind == "number":
            try:
                return Node("lit", float(raw))
            except ValueError:
                raise FormulaError(f"bad number {raw}") from None
        if kind == "text":
            return Node("lit", _unescape(raw))
        if kind == "name":
            return Node("col", raw)
        if kind == "word":
            if raw in ("true", "false", "null"):
                return Node("lit", {"true": True, "false": False, "null": None}[raw])
            if peek("("):
                at += 1
                parts: list[Node] = []
                while not peek(")"):
                    if parts:
                        take(",")
                    parts.append(climb(1))
                take(")")
                return Node("call", raw, tuple(parts))
            return Node("value") if raw == "value" else Node("col", raw)
        if (kind, raw) == ("op", "("):
            inner = climb(1)
            take(")")
            return inner
        raise FormulaError(f"unexpected {raw}")

    def unary() -> Node:
        nonlocal at
        if peek("-") or peek("+"):
            op = tokens[at][1]
            at += 1
            return Node("unary", op, (unary(),))
        return primary()

    def climb(least: int) -> Node:
        nonlocal at
        left = unary()
        while peek() and tokens[at][0] == "op" and PRECEDENCE.get(tokens[at][1], 0) >= least:
            op = tokens[at][1]
            at += 1
            left = Node("bin", op, (left, climb(PRECEDENCE[op] + 1)))
        return left

    tree = climb(1)
    if peek():
        raise FormulaError(f"unexpected {tokens[at][1]}")
    return tree


def check(source: str) -> str | None:
    """What is wrong with the formula as written; None if it can be read."""
    try:
        parse(source)
    except FormulaError as error:
        return str(error)
    return None


# -- compiling --------------------------------------------------------------------------------

TEXT, NUMBER, TRUTH, NULL = "text", "number", "truth", "null"


@dataclass(frozen=True)
class Typed:
    type: str
    col: Column
    literal: object = None

    def s(self) -> Column:
        """As text, null as the empty text."""
        if self.type == NULL:
            return F.lit("")
        return cells.text(self.col, {TEXT: "string", NUMBER: "double", TRUTH: "boolean"}[self.type])

    def n(self) -> Column:
        """As a number; NaN if it is none."""
        if self.type not in (NUMBER, TEXT):
            return F.lit(float("nan"))
        if isinstance(self.literal, float):
            return self.col
        return F.coalesce(self.col if self.type == NUMBER else cells.number(self.col, "string"), F.lit(float("nan")))

    def whole(self) -> Column:
        """As a whole number, cut towards zero; 0 if it is no number."""
        n = self.n()
        return F.when(F.isnan(n), 0).otherwise(F.greatest(F.least(n, F.lit(1e9)), F.lit(-1e9))).cast("int")

    def truthy(self) -> Column:
        if self.type == NULL:
            return F.lit(False)
        if self.type == TRUTH:
            return F.coalesce(self.col, F.lit(False))
        if self.type == TEXT:
            return F.coalesce(self.col != "", F.lit(False))
        return F.coalesce(self.col != 0, F.lit(False))


def _join(parts: list[Typed], build: Callable[[list[Column]], Column]) -> Typed:
    """One type for several branches: theirs if all agree, else text."""
    kinds = {p.type for p in parts} - {NULL}
    if not kinds:
        return Typed(NULL, F.lit(None).cast("string"))
    kind = kinds.pop() if len(kinds) == 1 else TEXT
    spark = {TEXT: "string", NUMBER: "double", TRUTH: "boolean"}
    of = lambda p: F.lit(None).cast(spark[kind]) if p.type == NULL else p.col if p.type == kind else cells.render(p.col, spark[p.type])
    return Typed(kind, build([of(p) for p in parts]))


def typed(c: Column, spark_type: str) -> Typed:
    """A column of a table as a formula sees it."""
    if spark_type in ("bigint", "int", "smallint", "tinyint", "double", "float") or spark_type.startswith("decimal"):
        return Typed(NUMBER, c.cast("double"))
    return Typed(TRUTH, c) if spark_type == "boolean" else Typed(TEXT, cells.render(c, spark_type))


def _split(s: Column, d: Typed) -> Column:
    """Parts at a literal; an empty one cuts nowhere."""
    quoted = F.concat(F.lit("\\Q"), F.replace(d.s(), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(d.s() == "", F.array(s)).otherwise(F.split(s, quoted, -1))


def _substr(a: list[Typed]) -> Column:
    s, i = a[0].s(), a[1].whole()
    start = F.when(i < 0, F.greatest(F.length(s) + i, F.lit(0))).otherwise(i) + 1
    n = F.length(s) if len(a) < 3 else F.greatest(a[2].whole(), F.lit(0))
    return F.substring(s, start, n)


def _regex_replace(a: list[Typed]) -> Column:
    pattern, put = a[1].literal, a[2].literal
    if not isinstance(pattern, str) or not isinstance(put, str):
        return replace_by_column(*[x.s() for x in a])  # patterns that differ from row to row
    java = java_pattern(pattern)
    return a[0].s() if java is None else F.regexp_replace(a[0].s(), java, java_replacement(put, groups(java)))


def _if(a: list[Typed]) -> Typed:
    other = a[2] if len(a) > 2 else Typed(NULL, F.lit(None).cast("string"))
    return _join([a[1], other], lambda c: F.when(a[0].truthy(), c[0]).otherwise(c[1]))


def _coalesce(a: list[Typed]) -> Typed:
    return _join(a, lambda c: F.coalesce(*[F.nullif(x, F.lit("")) if p.type == TEXT else x for x, p in zip(c, a, strict=True)]))


def _round(a: list[Typed]) -> Typed:
    if len(a) < 2:
        return Typed(NUMBER, cells.half_up(a[0].n(), 0))
    return Typed(NUMBER, F.when(F.isnan(a[1].n()), float("nan")).otherwise(cells.half_up(a[0].n(), a[1].whole().cast("double"))))


def _finite(a: list[Typed]) -> Typed:
    n = a[0].n()
    return Typed(NUMBER, F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n))


def _part(a: list[Typed]) -> Column:
    return F.coalesce(F.get(_split(a[0].s(), a[1]), F.when(~F.isnan(a[2].n()), a[2].whole())), F.lit(""))


_t = lambda f: lambda a: Typed(TEXT, f(a))
_b = lambda f: lambda a: Typed(TRUTH, f(a))
#: name: (fewest arguments, most, how it compiles)
FUNCTIONS: dict[str, tuple[int, int, Callable[[list[Typed]], Typed]]] = {
    "upper": (1, 1, _t(lambda a: F.upper(a[0].s()))),
    "lower": (1, 1, _t(lambda a: F.lower(a[0].s()))),
    "trim": (1, 1, _t(lambda a: cells.strip(a[0].s()))),
    "title": (1, 1, _t(lambda a: cells.title(a[0].s()))),
    "len": (1, 1, lambda a: Typed(NUMBER, F.length(a[0].s()).cast("double"))),
    "replace": (3, 3, _t(lambda a: F.when(a[1].s() == "", a[0].s()).otherwise(F.replace(a[0].s(), a[1].s(), a[2].s())))),
    "substr": (2, 3, _t(_substr)),
    "concat": (0, 99, _t(lambda a: F.concat(F.lit(""), *[x.s() for x in a]))),
    "split": (2, 2, _t(lambda a: F.coalesce(F.get(_split(a[0].s(), a[1]), F.lit(0)), F.lit("")))),
    "part": (3, 3, _t(_part)),
    "contains": (2, 2, _b(lambda a: F.contains(a[0].s(), a[1].s()))),
    "startsWith": (2, 2, _b(lambda a: F.startswith(a[0].s(), a[1].s()))),
    "endsWith": (2, 2, _b(lambda a: F.endswith(a[0].s(), a[1].s()))),
    "coalesce": (1, 99, _coalesce),
    "number": (1, 1, _finite),
    "str": (1, 1, _t(lambda a: a[0].s())),
    "round": (1, 2, _round),
    "abs": (1, 1, lambda a: Typed(NUMBER, F.abs(a[0].n()))),
    "if": (2, 3, _if),
    "regexReplace": (3, 3, _t(_regex_replace)),
}


def _divide(a: Column, b: Column) -> Column:
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(F.isnan(a), nan).when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a > 0, inf).when(a < 0, -inf).otherwise(nan)


def compile_node(node: Node, column: Callable[[str], Typed | None], value: Typed) -> Typed:
    if node.kind == "lit":
        v = node.value
        kind = NULL if v is None else TRUTH if isinstance(v, bool) else NUMBER if isinstance(v, float) else TEXT
        return Typed(kind, F.lit(v).cast("string") if v is None else F.lit(v), v)
    if node.kind == "value":
        return value
    if node.kind == "col":
        return column(str(node.value)) or Typed(NULL, F.lit(None).cast("string"))
    a = [compile_node(p, column, value) for p in node.parts]
    if node.kind == "unary":
        return Typed(NUMBER, -a[0].n() if node.value == "-" else a[0].n())
    if node.kind == "call":
        if node.value not in FUNCTIONS:
            raise FormulaError(f"unknown function {node.value}")
        least, most, build = FUNCTIONS[str(node.value)]
        if not least <= len(a) <= most:
            raise FormulaError(f"{node.value} takes {least} to {most} arguments")
        return build(a)
    x, y = a
    op = node.value
    if op == "+":
        return Typed(TEXT, F.concat(x.s(), y.s())) if TEXT in (x.type, y.type) else Typed(NUMBER, x.n() + y.n())
    if op in ("-", "*"):
        return Typed(NUMBER, x.n() - y.n() if op == "-" else x.n() * y.n())
    if op == "/":
        return Typed(NUMBER, _divide(x.n(), y.n()))
    if op == "%":
        return Typed(NUMBER, F.when(y.n() != 0, x.n() % F.nullif(y.n(), F.lit(0.0))).otherwise(float("nan")))
    if op in ("==", "!="):
        return Typed(TRUTH, x.s() == y.s() if op == "==" else x.s() != y.s())
    if op in ("&&", "||"):
        return _join([x, y], lambda c: F.when(x.truthy(), c[1] if op == "&&" else c[0]).otherwise(c[0] if op == "&&" else c[1]))
    less = {"<": x.n() < y.n(), "<=": x.n() <= y.n(), ">": x.n() > y.n(), ">=": x.n() >= y.n()}[str(op)]
    return Typed(TRUTH, ~F.isnan(x.n()) & ~F.isnan(y.n()) & less)


def compile_formula(source: str, column: Callable[[str], Typed | None], value: Typed | None = None) -> Typed:
    """column: a name's column, or None if there is none. value: the cell that is replaced."""
    return compile_node(parse(source), column, value or Typed(NULL, F.lit(None).cast("string")))
