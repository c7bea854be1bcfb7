"""Stages on planted cases."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rate double, _doc string"


def write(spark, at, docs, labels, items):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: f"n{int(rng.paretovariate(0.5)) % 20000}"
    item = " ".join(f"b{i}" for i in range(30))
    licence, rows, labels = "This is the line that all the sites share.", [], []
    for i in range(300):
        ws = [word() for _ in range(rng.randrange(80, 200))]
        if i % 10 == 0:
            for _ in range(6):
                ws[rng.randrange(len(ws))] = rng.choice(["scumbag", "vermin"])
        text = " ".join(ws)
        if i % 10 == 1:
            text += "\n" + licence
        if i % 100 == 2:
            text += "\n" + item
        rows.append((i, text, "en", f"s{i % 13}", len(text), 0.5, "x"))
        labels.append((i, int(i % 5 > 0), int(i % 10 == 0)))
    for k in range(4):
        ws = rows[3][1].split()
        ws[-1 - k] = "changed"
        rows.append((400 + k, " ".join(ws), "en", "s3", 0, 0.5, "x"))
    rows += [(500, None, "en", "s1", None, None, None), (501, "", None, None, 0, None, None), rows[4]]
    write(spark, tmp_path, spark.createDataFrame(rows, DOCS), labels, [(1, item), (2, None)])
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i in range(300) if i % 10 == 0}
    assert len(toxic & set(left["toxicity"])) <= 2 and len(set(range(300)) - toxic - set(left["toxicity"])) <= 2
    assert set(left["line_dedup"]) == set(left["toxicity"])
    assert sum(licence in (t or "") for t in left["line_dedup"].values()) == 1
    assert not {400, 401, 402, 403} & set(left["simhash"]) and 3 in left["simhash"] and not {500, 501} <= set(left["simhash"])
    assert all(i % 100 != 2 for i in left["decontaminate"]) and len(left["decontaminate"]) >= len(left["simhash"]) - 6
    assert set(left["mixing"]) <= set(left["decontaminate"]) and docs.where(F.col("_rate") <= 0).count() == 0
    assert cp.run(spark, str(tmp_path)).count() == docs.count()
