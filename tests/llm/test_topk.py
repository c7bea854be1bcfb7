"""Top-k against all pairs, on odd rows, many tiles and vectors on which the bounds skip."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from millrace.llm import topk
from pyspark.sql import functions as F


def all_pairs(rows, asks, k=20):
    """rows: (id, integers). Counts of (query, rank, id, score), as ids may repeat."""
    out = Counter()
    for i, (q, v) in enumerate(rows):
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), key) for j, (key, w) in enumerate(rows) if j != i)[:k]
            out.update((q, n + 1, key, -s) for n, (s, key) in enumerate(best))
    return out


def found(df):
    return Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def test_odd_rows(spark):
    rows = [(i, [float((i * 7 + j * 3) % 5 - 2) / 3 for j in range(6)], 0) for i in range(90)]
    rows += [(200, None, 0), (201, [1.0, None], 0), (202, [float("nan")] * 6, 0), (220, [], 0), (240, [0.5], 0), (None, [1.0], 0), (260, [float("inf")], 0), (280, [9.0] * 500, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").withColumns({"v": F.lit("x"), "query": F.lit(1), "shard": F.lit(2)}).repartition(4)
    q = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    data = topk.quantised(frame)
    assert found(topk.top_k(data, F.col("id") % 20 == 0)) == all_pairs(q, lambda i: i % 20 == 0)
    assert topk.top_k(data.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(data, F.lit(False)).count() == 0


def test_repeated_ids(spark):
    rows = [(20, [64, 0]), (1, [64, 0]), (1, [32, 0]), (2, [12, 0]), (20, [0, 64]), (20, [64, 0])]
    data = spark.createDataFrame(rows, "id long, v array<long>")
    got = found(topk.top_k(data, F.col("id") == 20, 4))
    assert got == all_pairs(rows, lambda i: i == 20, 4) and got[(20, 1, 1, 4096)] == 2


@pytest.mark.parametrize("clustered", [False, True])
def test_many_tiles(spark, monkeypatch, clustered):
    """Many shards and query sets: every query meets every row that can be among its best."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "CELL_BYTES", 8 * 4 * 20)
    rng = np.random.default_rng(6)
    x = rng.integers(-40, 40, (400, 8))
    if clustered:
        x = rng.integers(-3, 4, (400, 8)) + 60 * np.eye(8, dtype=int)[rng.integers(0, 8, 400)]
    x[50:120] = x[50]  # a group of copies: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, "id long, v array<long>").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(topk.top_k(data, F.col("id") % 20 == 0))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == all_pairs(rows, lambda i: i % 20 == 0)


def test_bounds_skip_blocks_of_clusters():
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (4096, 32)) + 60 * np.eye(32, dtype=int)[np.sort(rng.integers(0, 32, 4096))]
    scored: list[int] = []
    got = topk.best_of_shard(x[::64], np.arange(4096), x, 10, np.arange(0, 4096, 64), rows=64, scored=scored)
    for i, (best, s) in zip(range(0, 4096, 64), got, strict=True):
        every = x @ x[i]
        want = sorted((-int(every[j]), j) for j in range(4096) if j != i)[:10]
        assert [(-int(a), int(b)) for a, b in zip(s, best, strict=True)] == want
    assert sum(scored) < 0.1 * 64 * 64  # of 64 queries and 64 blocks


