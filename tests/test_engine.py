"""Steps, formulas, analysis, views, recipes and files of the cleaning engine."""

from __future__ import annotations

import json
import math
import random
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import cells, formula
from millrace.operators import analysis, similarity
from millrace.operators.fills import carry
from millrace.operators.steps import STEPS, StepWarning, apply
from millrace.plans.recipe import Recipe
from millrace.plans.table import RID, from_df
from millrace.plans.view import changed_mask, order_by, sort_cycle, step_delta, subset, view, window
from millrace.queries import ORACLES, QUERIES
from millrace.sources import files
from millrace.sources.sample import sample_table
from millrace.streaming.recipes import fold_batches, fold_stream

from . import plain

TABLES = ("nation", "customer", "part", "orders", "lineitem", "events", "documents")


def rows(spark, names, data):
    return files.rows_table(spark, names, data)


def column(t, name):
    at = t.names.index(name)
    return [r[at] for r in t.rows()[1:]]


def one(spark, values, step, params, name="x"):
    return column(apply(rows(spark, ["x"], [[v] for v in values]), step, params), name)


def key(values):
    return sorted(tuple(x.hex() if isinstance(x, float) else str(x) for x in v) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    assert key(df.select(*columns).collect()) == key(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).collect()


def test_all_steps_are_there():
    assert len(STEPS) == 22


def test_text_steps(spark):
    odd = ["  a   b﻿", " ", "", None, "x\ty"]
    assert one(spark, odd, "trim", {"columns": ["x"]}) == [v if plain.blank(v) else plain.collapse(v) for v in odd]
    assert one(spark, ["o'neil mc-donald", "éa ab", "a\tb"], "changeCase", {"columns": ["x"], "mode": "title"}) == ["O'neil Mc-donald", "éA Ab", "A\tB"]
    assert one(spark, ["a.b$c"], "replace", {"columns": ["x"], "find": ".", "replaceWith": "$"}) == ["a$b$c"]
    assert one(spark, ["ABab"], "replace", {"columns": ["x"], "find": "(a)(b)", "replaceWith": "[$2$&$3]", "regex": True, "caseInsensitive": True}) == ["[BAB$3][bab$3]"]
    assert one(spark, ["ab"], "replace", {"columns": ["x"], "find": ""}) == ["ab"]
    assert one(spark, ["a1b", "zz", "", None], "extract", {"column": "x", "pattern": "a(9)?[0-9]", "into": "y"}, "y") == ["a1", None, None, None]
    with pytest.warns(StepWarning):
        assert apply(rows(spark, ["x"], [["a"]]), "extract", {"column": "x", "pattern": "("}).names == ["x"]


def test_columns(spark):
    t = rows(spark, ["A", "B", "A"], [["1-2", "", "z"], ["3", None, None]])
    assert apply(t, "splitColumn", {"column": "A", "delimiter": "-"}).rows() == [["A_1", "A_2", "B", "A"], ["1", "2", "", "z"], ["3", None, None, None]]
    assert apply(t, "mergeColumns", {"columns": ["B", "A"], "separator": "+"}).rows()[1][-1] == "1-2+z"
    assert apply(t, "renameColumn", {"column": "A", "name": "B"}).names == ["B", "B", "A"]
    assert apply(t, "deleteColumns", {"columns": ["A"]}).names == ["B"]
    assert apply(t, "moveColumn", {"column": "B", "dir": 1}).names == ["A", "A", "B"]
    assert apply(t, "moveColumn", {"column": "A", "dir": -1}).names == t.names
    assert apply(t, "removeEmptyColumns").names == ["A", "A"]
    assert t.to_df().columns == ["A", "B", "A_2"]
    with pytest.warns(StepWarning):
        assert apply(t, "moveColumn", {"column": "no", "dir": 1}) is t
    with pytest.warns(StepWarning):
        assert apply(t, "noSuchStep") is t


def test_types(spark):
    cases = {"integer": ["1", "2", "-3"], "decimal": ["1,200.5", "2.25", "3"], "boolean": ["yes", "no", "true"], "date": ["2024-01-02", "2024/2/3"], "text": ["a", "1"]}
    for want, values in cases.items():
        assert rows(spark, ["x"], [[v] for v in values]).metas[0].logical == want
    assert rows(spark, ["x"], [["0"], ["1"]]).metas[0].logical == "boolean"
    assert rows(spark, [""], [[None]]).names == ["Column 1"]
    assert one(spark, ["12abc", "-3.9", "1,200", "x", "", " 7"], "changeType", {"column": "x", "type": "integer"}) == ["12", "-3", "1200", "x", None, "7"]
    assert one(spark, ["1", "2"], "changeType", {"column": "x", "type": "integer"}) == [1, 2]
    assert one(spark, ["1d", "2e3", ".5"], "changeType", {"column": "x", "type": "decimal"}) == [1.0, 2000.0, 0.5]
    assert one(spark, [" Yes ", "0", "maybe"], "changeType", {"column": "x", "type": "boolean"}) == ["true", "false", "maybe"]


def test_dates(spark):
    values = ["15/02/2024", "Mar 3, 2024", "2024/04/11", "11 Apr. 2024", "02/15/2024", "03.04.2024", "31-02-2024", "99/99/2024", "2024-01-02T00:00", None]
    want = ["2024-02-15", "2024-03-03", "2024-04-11", "2024-04-11", "2024-02-15", "2024-04-03", "2024-02-31", "99/99/2024", "2024-01-02T00:00", None]
    assert one(spark, values, "standardizeDate", {"column": "x"}) == want


def test_phones_and_names(spark):
    phones = ["(415) 555-2671", "1-415-555-2671", "+44 20 7946 0958", "0049 30 123", "n/a", None]
    assert one(spark, phones, "parseField", {"column": "x", "kind": "phone"}) == ["+14155552671", "+14155552671", "+442079460958", "+4930123", None, None]
    assert one(spark, ["020 7946"], "parseField", {"column": "x", "kind": "phone", "country": "44"}) == ["+44207946"]
    names = ["Lovelace, Ada", "Grace  B Hopper", "Cher", "", None]
    assert one(spark, names, "parseField", {"column": "x", "kind": "name", "part": "first", "into": "f"}, "f") == ["Ada", "Grace B", "Cher", "", None]
    assert one(spark, names, "parseField", {"column": "x", "kind": "name", "part": "last"}) == ["Lovelace", "Hopper", "", "", None]


def test_filters(spark):
    values = ["10", "9", "1,200", "x", "", None, "Ten"]
    got = lambda op, v=None: one(spark, values, "filterRows", {"column": "x", "op": op, "value": v})
    assert got("gt", "9") == ["10", "1,200"] and got("lte", "9") == ["9"]
    assert got("eq", "") == ["", None] and got("neq", "x") == ["10", "9", "1,200", "", None, "Ten"]
    assert got("contains", "TE") == ["Ten"] and got("notContains", "1") == ["9", "x", "", None, "Ten"]
    assert got("empty") == ["", None] and len(got("notEmpty")) == 5 and len(got("whatever")) == 7


@pytest.mark.parametrize("stretch", [2, 5, 65_536])
def test_carry(spark, monkeypatch, stretch):
    monkeypatch.setattr("millrace.operators.fills.STRETCH", stretch)
    rng = random.Random(stretch)
    values = [rng.choice([None, "", " ", "a", "b", "c"]) for _ in range(60)] + [None] * 12 + ["z", None]
    t = rows(spark, ["x"], [[v] for v in values])
    for down in (True, False):
        assert column(carry(t, list(t.metas), down), "x") == plain.fill(values, "down" if down else "up")


def test_fill_strategies(spark):
    values = ["b", "a", "", "a", None, "b", "c"]
    assert one(spark, values, "fillMissing", {"column": "x", "strategy": "mode"}) == [plain.mode(values) if plain.blank(v) else v for v in values]
    assert one(spark, ["1", "2", "", "10"], "fillMissing", {"column": "x", "strategy": "median"})[2] == "2"
    assert one(spark, ["1", "2", "2", ""], "fillMissing", {"column": "x", "strategy": "mean"})[3] == "1.666667"
    assert one(spark, ["x", ""], "fillMissing", {"column": "x", "strategy": "mean"}) == ["x", ""]
    assert one(spark, ["x", " "], "fillMissing", {"column": "x", "strategy": "constant", "value": "-"}) == ["x", "-"]


def test_dedupe(spark):
    t = rows(spark, ["A", "B"], [["1", "x"], [None, "y"], ["", "y"], ["1", "x"], ["1", "z"]])
    assert apply(t, "dedupeRows").rows()[1:] == [["1", "x"], [None, "y"], ["1", "z"]]
    assert apply(t, "dedupeRows", {"columns": ["A"]}).rows()[1:] == [["1", "x"], [None, "y"]]


def test_number_format(spark):
    assert one(spark, ["1.005", "-2.5", "1,234.567"], "numberFormat", {"column": "x", "decimals": 2}) == [1.0, -2.5, 1234.57]
    assert one(spark, ["2.345", "n/a"], "numberFormat", {"column": "x", "decimals": 1}) == ["2.3", "n/a"]


def calc(spark, expr, **values):
    t = rows(spark, list(values) or ["x"], [list(values.values()) or ["1"]])
    return apply(t, "expression", {"expr": expr, "mode": "new", "name": "y"}).rows()[1][-1]


def test_formulas(spark):
    assert calc(spark, "upper(trim($a))", a="  b ") == "B"
    assert calc(spark, "2 + 3 * 4") == 14 and calc(spark, "(2 + 3) * -4") == -20 and calc(spark, "10 - 4 - 3") == 3
    assert calc(spark, "a + b", a="1", b="2") == "12" and calc(spark, "number(a) + number(b)", a="1", b="2") == 3
    assert calc(spark, "round(1.234 * 2, 1)") == 2.5 and calc(spark, "round(0 - 2.5)") == -2
    assert calc(spark, "coalesce(a, b)", a="", b="z") == "z" and calc(spark, "coalesce(a, b)", a=" ", b="z") == " "
    assert calc(spark, "if(a > 5, 'big', 3)", a="7") == "big" and calc(spark, "if('0', 1)") == 1 and calc(spark, "if('', 1)") is None
    assert calc(spark, "[my col] == 'x' && true", **{"my col": "x"}) is True
    assert calc(spark, "part(a, '.', 1) + split(a, '.')", a="p.q") == "qp" and calc(spark, "part(a, '.', 9)", a="p") == ""
    assert calc(spark, "substr(a, -3, 2)", a="hello") == "ll" and calc(spark, "substr(a, 1)", a="hello") == "ello"
    assert calc(spark, "1 / 0") == float("inf") and math.isnan(calc(spark, "0 / 0")) and math.isnan(calc(spark, "7 % 0")) and math.isnan(calc(spark, "a - 1", a="x")) and calc(spark, "7 % 4") == 3
    assert calc(spark, """'a\\'b' + "\\t\\"" """) == "a'b\t\"" and calc(spark, "nothing == ''") is True
    assert calc(spark, "len('héé') + abs(-2)") == 5
    for bad in ("upper(", "1 +", "a = b", "'open", "1 2", "!a"):
        assert formula.check(bad)
    with pytest.warns(StepWarning):
        assert apply(rows(spark, ["x"], [["1"]]), "expression", {"expr": "nope(1)"}).names == ["x"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" ,.-+eE0123456789ab ", max_size=8)), min_size=1, max_size=12))
def test_cells_against_plain(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", cells.blank(F.col("s")).alias("b"), cells.number(F.col("s")).alias("n"), cells.collapse(F.col("s")).alias("c"))
    for r, v in zip(df.orderBy("i").collect(), values, strict=True):
        assert r["b"] == plain.blank(v) and r["n"] == plain.number(v) and r["c"] == (None if v is None else plain.collapse(v))


def test_similarity(spark):
    f = similarity.jaro_winkler_of
    assert f("martha", "marhta") > 0.94 and f("", "") == 1 and f("a", "") == 0 and f("abc", "xyz") == 0
    df = spark.createDataFrame([("kitten", "sitting")], "a string, b string")
    r = df.select(similarity.levenshtein(F.col("a"), F.col("b")).alias("l"), similarity.edit_similarity(F.col("a"), F.col("b")).alias("e"), similarity.jaro_winkler("a", "b").alias("j")).first()
    assert r["l"] == 3 and abs(r["e"] - 4 / 7) < 1e-12 and abs(r["j"] - f("kitten", "sitting")) < 1e-12
    k = spark.createDataFrame([(" Café, Müller! ",)], "s string").select(similarity.fingerprint(F.col("s")).alias("f"), similarity.ngram_fingerprint(F.col("s")).alias("n"), similarity.ngram_fingerprint(F.lit("a")).alias("short")).first()
    assert k["f"] == "cafe muller" and k["short"] == ""
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(2))
        assert f(a, b) <= similarity.most_similar(len(a), len(b)) + 1e-12


def words(n, seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        w[rng.randrange(8)] = rng.choice("abcdefgh")
        out.append("".join(w))
    return out


@pytest.mark.parametrize("survivorship", ["first", "longest", "mostComplete"])
def test_fuzzy_dedupe(spark, monkeypatch, survivorship):
    monkeypatch.setattr(similarity, "TILE", 7)
    rng = random.Random(4)
    data = [[w + "x" * rng.randrange(2), rng.choice(["", "v"])] for w in words(60)] + [["", "v"], [None, ""]]
    t = rows(spark, ["A", "B"], data)
    keys = ["".join(c for c in (d[0] or "").lower()) for d in data]
    blanks = [sum(plain.blank(c) for c in d) for d in data]
    gone = plain.fuzzy(keys, blanks, lambda a, b: similarity.jaro_winkler_of(a, b) >= 0.88, survivorship)
    got = apply(t, "fuzzyDedupe", {"columns": ["A"], "threshold": 0.88, "survivorship": survivorship})
    assert sorted(r[0] for r in got.df.select(RID).collect()) == [i for i in range(len(data)) if i not in gone] and gone


def test_clusters(spark, monkeypatch):
    t = rows(spark, ["x"], [[v] for v in ["New York"] * 5 + ["york new"] * 2 + ["Paris"]])
    r = similarity.clusters(t, "x").collect()
    assert len(r) == 1 and r[0]["total"] == 7 and r[0]["suggestion"] == "New York"
    assert similarity.mapping_of(similarity.clusters(t, "x")) == {"New York": "New York", "york new": "New York"}
    monkeypatch.setattr(similarity, "TILE", 9)
    values = list(dict.fromkeys(words(50, 9)))
    want: dict = {}
    for v, i in plain.leaders(values, lambda a, b: similarity.jaro_winkler_of(a, b) >= 0.85).items():
        want.setdefault(f"nn_{i}", set()).add(v)
    got = {r["key"]: set(r["values"]) for r in similarity.clusters(rows(spark, ["x"], [[v] for v in values]), "x", "levenshtein", 0.85).collect()}
    assert got == {k: v for k, v in want.items() if len(v) > 1}


def test_profiles(spark):
    t = rows(spark, ["Revenue", "Name"], [["10", "Ada"], ["20", "Bob"], ["30", "Ada"], ["40", ""]])
    p = analysis.profile(t, "Revenue")
    assert (p["min"], p["max"], p["mean"], p["median"], p["sum"]) == (10, 40, 25, 25, 100)
    bins = analysis.histogram(t, "Revenue").collect()
    assert len(bins) == 14 and sum(b["n"] for b in bins) == 4
    p = analysis.profile(t, "Name")
    assert (p["distinct"], p["blank"], p["maxLen"]) == (2, 1, 3)
    flat = analysis.histogram(rows(spark, ["x"], [["5"], ["5"], ["5"]]), "x").orderBy("bin").collect()
    assert flat[0]["n"] == 3 and sum(b["n"] for b in flat) == 3
    assert analysis.completeness(t)["Name"] == 0.75
    assert [tuple(r) for r in analysis.facet(t, "Name").collect()] == [("Ada", 2), ("Bob", 1)]


MESSY = [["Name", "Plan", "Joined"], ["  Ada ", "Pro", "15/02/2024"], ["Bob", "pro", "Mar 3, 2024"], ["Bob", "pro", "Mar 3, 2024"], ["Cy", "PRO", "2024/04/11"], ["", "", ""]]


def test_quality_and_suggestions(spark):
    clean = rows(spark, ["A"], [["x"], ["y"]])
    assert analysis.quality(clean)["score"] == 100
    t = rows(spark, MESSY[0], MESSY[1:])
    q = analysis.quality(t)
    assert q["score"] < 100 and q["duplicates"] == 1
    found = analysis.suggestions(t)
    assert [o.id for o in found] == ["trim", "empty_rows", "dups", "case_Plan"]
    dates = rows(spark, ["Joined"], [["15/02/2024"], ["Mar 3, 2024"], ["x"], ["2024/04/11"]])
    assert [o.id for o in analysis.suggestions(dates)] == ["date_Joined"]
    assert analysis.suggestions(rows(spark, ["A"], [])) == []
    done = Recipe().set_ops(found).fold(t)
    assert done.df.count() < t.df.count() and analysis.quality(done)["score"] > q["score"]


def test_sample_end_to_end(spark):
    t = sample_table(spark)
    assert t.df.count() == 12 and {m.name: m.logical for m in t.metas} == {"Boat": "text", "Arrived": "date", "Skipper": "text", "Berth fee": "decimal", "Radio phone": "text", "Dry dock": "boolean", "Remarks": "text"}
    before = analysis.quality(t)["score"]
    r = Recipe().set_ops(analysis.suggestions(t)).add("standardizeDate", column="Arrived").add("parseField", column="Radio phone", kind="phone").add("fuzzyDedupe", columns=["Boat"], threshold=0.9)
    done = r.fold(t)
    assert done.df.count() == 6 and analysis.quality(done)["score"] > before and "Remarks" not in done.names
    assert "2021-12-25" in column(done, "Arrived") and "+14155550133" in column(done, "Radio phone")


def test_recipes(spark):
    r = Recipe(name="r").add("trim", columns=["x"]).add("filterRows", column="x", op="notEmpty").add("dedupeRows")
    t = rows(spark, ["x"], [[" a"], ["a"], [""]])
    snaps = r.fold_all(t)
    assert [s.df.count() for s in snaps] == [3, 3, 2, 1] and r.fold(t, 2).df.count() == 2
    off = r.toggle("op_2")
    snaps = off.fold_all(t)
    assert off.fold(t).df.count() == 2 and snaps[2] is snaps[1]
    back = Recipe.from_json(off.to_json())
    assert back.ops == off.ops and json.loads(off.to_json())["version"] == 1
    with pytest.raises(ValueError):
        Recipe.from_json("[]")
    assert off.undo().ops == r.ops and off.undo().redo().ops == off.ops and r.undo().undo().undo().undo().ops == ()
    assert [o.id for o in r.move("op_1", 1).ops] == ["op_2", "op_1", "op_3"] and r.move("op_1", -1) is r
    assert r.update("op_2", op="empty").ops[1].params["op"] == "empty" and len(r.remove("op_2").ops) == 2
    assert Recipe().add("nope").add("expression", expr="1 +").problems() and not r.problems()


def test_views_and_deltas(spark):
    t = rows(spark, ["A", "N"], [["b", "10"], ["a", "9"], ["", "100"], ["B", ""]])
    assert [r[RID] for r in view(t, "b").collect()] == [0, 3]
    assert [r[RID] for r in view(t, "", "N", "asc").collect()] == [1, 0, 2, 3]
    assert [r[RID] for r in view(t, "", "A", "desc").collect()] == [0, 1, 3, 2]
    assert sort_cycle(sort_cycle(sort_cycle(None))) is None and len(order_by(t, None)) == 1
    assert subset(t, spark.createDataFrame([(2,), (0,)], f"{RID} long")).rows()[1:] == [["b", "10"], ["", "100"]]
    assert window(t, 2, 1).count() == 2
    after = apply(t, "changeCase", {"columns": ["A"], "mode": "upper"})
    d = step_delta(t, after)
    assert (d.rows, d.added, d.removed, d.changed) == (0, (), (), 2)
    assert step_delta(t, apply(t, "filterRows", {"column": "A", "op": "notEmpty"})).rows == -1
    wider = apply(after, "mergeColumns", {"columns": ["A"], "name": "M"})
    assert step_delta(t, wider).added == ("M",)
    assert {tuple(r) for r in changed_mask(t, wider).collect()} == {(0, "A"), (1, "A"), *((i, "M") for i in range(4))}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('N;"T x"\r\n1;"a;""b"""\r\n ; \r\n2;"line\nbreak"\r\n3\r\n'.encode())
    t = files.read(spark, str(tmp_path / "a.csv"))
    assert t.rows() == [["N", "T x"], ["1", 'a;"b"'], ["2", "line\nbreak"], ["3", None]] and t.metas[0].logical == "integer"
    (tmp_path / "l.csv").write_bytes("n\nM\xfcller\n".encode("latin-1"))
    assert files.read(spark, str(tmp_path / "l.csv")).rows()[1] == ["Müller"]
    (tmp_path / "a.tsv").write_text("A\tB\n1\t2\n")
    assert files.read(spark, str(tmp_path / "a.tsv")).rows()[1] == ["1", "2"]
    (tmp_path / "a.json").write_text('[{"b": 1, "a": "x"}, {"c": {"d": [1]}, "a": null}]')
    j = files.read(spark, str(tmp_path / "a.json"))
    assert j.names == ["b", "a", "c"] and j.rows()[1] == ["1", "x", None] and j.rows()[2][2] == '{"d":[1]}'
    (tmp_path / "o.json").write_text('{"k": "v"}')
    assert files.read(spark, str(tmp_path / "o.json")).rows() == [["k"], ["v"]]
    x = rows(spark, ["N", "T"], [["1", "a & “b” <c>"], [None, " pad "]])
    x = apply(x, "changeType", {"column": "N", "type": "integer"})
    files.write_xlsx(x, str(tmp_path / "a.xlsx"))
    assert files.read(spark, str(tmp_path / "a.xlsx")).rows() == [["N", "T"], ["1", "a & “b” <c>"], [None, " pad "]]
    files.write_csv(t, str(tmp_path / "out"), single=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().startswith(b'N,T x\r\n1,"a;""b"""\r\n')
    assert json.loads("".join(files.json_array(x))) == [{"N": 1, "T": "a & “b” <c>"}, {"N": None, "T": " pad "}]
    files.write_parquet(x, str(tmp_path / "p.parquet"))
    assert sorted(files.read(spark, str(tmp_path / "p.parquet")).rows()[1:], key=str) == sorted(x.rows()[1:], key=str)
    files.write_json(x, str(tmp_path / "jl"))
    files.write_tsv(x, str(tmp_path / "ts"))
    files.write_view(x, str(tmp_path / "v"), "pad")
    again = files.read(spark, str(tmp_path / "jl") + "/" + next((tmp_path / "jl").glob("part-*.json")).name)
    assert again.rows()[0] == ["N", "T"]
    assert files.format_of("a.txt") == "csv" and files.format_of("A.XLS") == "xlsx"


def test_streams(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    r = Recipe().add("changeCase", columns=["event_type"], mode="upper").add("filterRows", column="event_type", op="contains", value="c")
    q = fold_stream(r, source(), "event_id").writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    want = r.fold(from_df(spark.read.parquet(f"{tmp_path}/in"), "event_id")).to_df()
    assert key(spark.table("cleaned").collect()) == key(want.collect())
    got: list[int] = []
    d = Recipe().add("dedupeRows", columns=["event_type"])
    q = fold_batches(d, source(), "event_id", lambda df, epoch: got.append(df.count())).start()
    q.processAllAvailable()
    q.stop()
    assert got and all(0 < n <= 5 for n in got)
    with pytest.raises(ValueError):
        fold_stream(d, source(), "event_id")


def test_without_training_data_operators():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in (root / "millrace").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text())


def test_the_rest_works_alone(tmp_path):
    """With the training-data operators and their pipeline gone, all else is there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) == set(e.queries()) and len(e.queries()) > 90; assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_files_keep_their_order_however_they_are_split(spark, tmp_path):
    data = [[str(i), "x" * (i % 50)] for i in range(4000)]
    t = rows(spark, ["n", "x"], data)
    files.write_csv(t.with_df(t.df.repartition(5)), str(tmp_path / "many.csv"))
    files.write_json(t.with_df(t.df.repartition(5)), str(tmp_path / "many.json"))
    files.write_parquet(t.with_df(t.df.repartition(5)), str(tmp_path / "many.parquet"))
    for size in ("3000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        try:
            for end in ("csv", "json", "parquet"):
                assert column(files.read(spark, str(tmp_path / f"many.{end}")), "n") == [r[0] for r in data], end
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_first_sheet_and_formats(tmp_path):
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="4"/><xf numFmtId="10"/><xf numFmtId="20"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1"><v>9</v></c></row></sheetData></worksheet>')
        cells_ = "".join(f'<c r="{chr(65 + s)}1" s="{s}"><v>{v}</v></c>' for s, v in enumerate(("1.5", "45306", "45306", "1234.5", "0.125", "0.5")))
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row>{cells_}</row></sheetData></worksheet>')
    assert files._xlsx_rows(raw.getvalue()) == [["1.5", "1/15/24", "2024-01-15", "1,234.50", "12.50%", "12:00"]]


def test_is_date_agrees(spark):
    rng = random.Random(3)
    parts = ["2024", "1999", "0", "1", "02", "12", "13", "31", "32", "00", "Feb", "march", "Foo", "jan.", "/", "-", ".", " ", "  ", ", ", "\t"]
    values = {"".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(6000)} | {"2024-02-31", "31/12/2024", "12/31/2024", "5 Feb 2024", "Feb. 5, 2024", " 2024.1.1 "}
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v string")
    odd = df.where(F.coalesce(cells.is_date(F.col("v")), F.lit(False)) != cells.normalize_date(F.col("v")).isNotNull())
    assert odd.collect() == [] and df.where(cells.is_date(F.col("v"))).count() >= 6


def test_medians(spark):
    from millrace.operators.ranks import median_of

    rng = random.Random(4)
    for xs in ([], [1.0], [1.0, 2.0], [5.0] * 9 + [6.0], [rng.gauss(0, 1) for _ in range(999)], [rng.expovariate(1) * 10 ** rng.randrange(-9, 9) for _ in range(1000)], [1.0, 1.0 + 2**-52, 1e300], [float("inf"), 1.0, 2.0]):
        df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
        want = sorted(xs)
        assert median_of(df) == (None if not xs else want[len(xs) // 2] if len(xs) % 2 else want[len(xs) // 2 - 1] + (want[len(xs) // 2] - want[len(xs) // 2 - 1]) * 0.5)


def test_fuzzy_dedupe_of_repeated_keys(spark):
    rng = random.Random(8)
    names = ["martha smith", "marhta smith", "martha smiths", "mary jones", "marie jones", "mary jonesson", "bob", ""]
    data = [[rng.choice(names), rng.choice(["", "x"]), rng.choice(["", "y"])] for _ in range(120)]
    t = rows(spark, ["A", "B", "C"], data)
    keys, blanks = [r[0] for r in data], [sum(plain.blank(c) for c in r) for r in data]
    for survivorship in ("first", "longest", "mostComplete"):
        gone = plain.fuzzy(keys, blanks, lambda a, b: similarity.jaro_winkler_of(a, b) >= 0.88, survivorship)
        got = apply(t, "fuzzyDedupe", {"columns": ["A"], "threshold": 0.88, "survivorship": survivorship})
        assert {r[0] for r in got.df.select(RID).collect()} == set(range(120)) - gone


def test_analysis_errors_change_nothing(spark):
    t = rows(spark, ["x"], [["a"]])
    with pytest.warns(StepWarning):
        assert apply(t, "expression", {"expr": "substr(value, 1, 2", "mode": "new"}) is t
    from millrace.operators import steps

    steps.STEPS["broken"] = ("row", lambda t, p: t.with_df(t.df.select("no_such_column")))
    try:
        with pytest.warns(StepWarning):
            assert apply(t, "broken") is t
    finally:
        del steps.STEPS["broken"]


def test_workbook_is_read_piece_by_piece(spark, tmp_path, monkeypatch):
    import tracemalloc
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    n = 20_000
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>é</t></r><r><t>{i}</t></r></si>" for i in range(n)) + "</sst>")
        body = "".join(f'<row><c r="A{i}" t="s"><v>{i}</v></c><c r="C{i}"><v>{i}</v></c><c r="D{i}" t="inlineStr"><is><t>x</t></is></c></row><row/>' for i in range(n))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>k</t></is></c><c/><c t="inlineStr"><is><t>v</t></is></c></row>{body}</sheetData></worksheet>')
    monkeypatch.setattr(files, "CELLS_HELD", 3_000, raising=False)
    tracemalloc.start()
    try:
        t = files.read(spark, str(tmp_path / "a.xlsx"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4_000_000  # the whole sheet takes some 50 MB
    assert t.names == ["k", "Column 2", "v"]
    assert t.rows()[1:] == [[f"é{i}", None, str(i)] for i in range(n)]
    assert [m.logical for m in t.metas][2] == "integer"


def test_fill_up_reads_each_row_once(spark):
    from millrace.operators import fills

    n = 3 * fills.STRETCH // 2  # over two stretches
    cells_ = [str(i) if i % 50_000 == 40_000 else None for i in range(n)]
    df = spark.range(n).select("id", F.when(F.col("id") % 50_000 == 40_000, F.col("id").cast("string")).alias("x"))
    t = from_df(df, "id")
    t = fills.fill(t, t.find("x"), "up")
    plan = t.df._jdf.queryExecution().toString().lower()
    assert "unboundedfollowing" not in plan.replace(" ", "")  # such a frame is gone through anew for each row
    want, last = [], None
    for c in reversed(cells_):
        last = c or last
        want.append(last)
    assert [r[1] for r in t.rows()[1:]] == want[::-1]
