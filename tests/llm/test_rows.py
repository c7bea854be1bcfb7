"""Rows are told by file and place: results don't depend on how a scan is split, nor on
columns whose names operators use themselves."""

from __future__ import annotations

import random

import pytest
from millrace.llm import common, line_dedup, mixing, near_dedup, simhash, toxicity
from pyspark.sql import functions as F

CLASHING = ("_doc", "_row", "row", "t", "id", "h", "at", "fp_", "rate", "_g0", "_k0", "n_tokens_", "gone", "spans_")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("rows")
    rng = random.Random(1)
    rows = []
    for i in range(600):
        words = [f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(rng.randrange(20, 60))]
        if i % 10 == 3:
            words = rows[-1][1].split("\n")[0].split()[:-1] + ["changed"]
        text = " ".join(words) + ("\nA line that all sites share." if i % 4 == 0 else "")
        rows.append((i, text, f"s{i % 9}"))
    rows += [(700, None, "s1"), (701, "", None), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("kept") for c in CLASHING})
    docs.repartition(3).sortWithinPartitions("doc_id").write.option("parquet.block.size", 4096).parquet(f"{at}/docs")
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    return f"{at}/docs", labels


def split(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")


def test_results_dont_depend_on_splits(spark, tables, monkeypatch):
    path, labels = tables
    found = {}
    # each time a table is written, the scans after it are split in another way
    sizes = ["3000", "128m", "20000"]
    for name, module in (("lines", line_dedup), ("copies", near_dedup), ("mix", mixing)):
        real = module.materialise

        def changing(df, real=real):
            sizes.append(sizes.pop(0))
            split(spark, sizes[0])
            return real(df)

        for changes in (False, True):
            split(spark, "128m")
            monkeypatch.setattr(module, "materialise", changing if changes else real)
            docs = spark.read.parquet(path)
            if name == "lines":
                out = sorted((r["doc_id"] or 0, r["text"] or "", r["_removed"]) for r in line_dedup.remove_boilerplate(docs).collect())
            elif name == "copies":
                out = sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect())
            else:
                rows = common.stable(docs)
                rates = mixing.mix(rows, labels, {0: 0.3, 1: 0.7}).select(F.col("_row").alias("x"), "rate", "n_tokens")
                joined = rows.select("doc_id", F.size(F.split("text", " ")).alias("words"), common.place().alias("y")).join(rates, F.col("x") == F.col("y"))
                out = sorted((r["doc_id"], round(r["rate"], 9)) for r in joined.collect())
                assert joined.where("abs(words - n_tokens) > 9").count() == 0
            found.setdefault(name, []).append(out)
        monkeypatch.setattr(module, "materialise", real)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, (one, other) in found.items():
        assert one == other, name
    assert any(r[2] for r in found["lines"][0]) and len(found["copies"][0]) < 560


def test_clashing_columns_stay(spark, tables):
    path, labels = tables
    docs = spark.read.parquet(path)
    n = docs.count()
    model = toxicity.fit(docs, labels)
    for out in (line_dedup.remove_boilerplate(docs), simhash.near_duplicates(docs, keep=docs.columns), toxicity.score(docs, model), near_dedup.keep_one(docs)):
        kept = [c for c in CLASHING if c in out.columns]
        assert kept == list(CLASHING)
        rows = out.select(*kept).distinct().collect()
        assert [tuple(r) for r in rows] == [("kept",) * len(kept)]
    assert mixing.mix(docs, labels, {1: 1.0}).count() == n


def test_common_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 50)
    left = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(900)], "k long, v long").repartition(4)
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = sorted(map(tuple, common.join_counted(left, right, "k", "n", F.col("v")).select("k", "v", "m").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "v", "m").collect())) and len(got) == 900
