"""Exact top-k by inner product, block at a time.

Vectors are integer term weights: term j of component j. Rows are put in ranges of like
vectors (by their three heaviest components, then id) and cut into shards of at most CELL_BYTES,
and these into blocks of BLOCK_ROWS; a block has its forward index (the rows themselves) and,
for each term, the largest and smallest weight in it. For a query, the sum over terms of the
larger of weight times maximum and weight times minimum bounds every score in the block. Blocks
are taken in order of their bound and scored through their forward index; a query stops where
the bound falls below its kth score.

A query's kth score starts from its own shard, where the rows most like it are, and is carried
to all others: a query set (the queries of one shard) meets only those shards whose own bound
reaches the kth score of one of its queries; the others are not sent to it at all. Sets and
shards meet as tiles of bounded size, so a task's memory does not grow with the data, and each
tile returns k rows a query at most. Ties go to the smaller id, exactly.

How much the bounds skip depends on the vectors: much where like vectors stand together in few
components, nothing where components are independent (see the README).

Nulls: a row whose id or vector is null, or whose vector holds a null or non-finite
component, takes no part. Vectors of different lengths compare as if padded with zeros; an
empty vector scores 0. Rows that share an id are different rows: each is a candidate, and each
a query of its own that all rows but itself are compared with. An empty table gives an empty
one. Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, rows_of

BLOCK_ROWS = 1_024
CELL_BYTES = 8 << 20
NONE = np.iinfo(np.int64).min + 1


def _whole_numbers(x: np.ndarray) -> np.ndarray:
    """As few bytes as the numbers need."""
    return x.astype(np.int32) if not x.size or np.abs(x).max() < 2**31 else x


def _read(row: dict, of: str) -> np.ndarray:
    return np.frombuffer(row[of], np.int32 if row["small"] else np.int64).reshape(-1, row["width"]).astype(np.int64) if row["width"] else np.zeros((len(row["ids"]) // 8, 0), np.int64)


def _shards(rows: DataFrame) -> DataFrame:
    """rows: id, v, query, in order. part, width, small, ids, weights, query (a flag a row), high
    and low: the shards of each partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list[int] = []
        vs: list[np.ndarray] = []
        flags: list[bool] = []
        width = 0

        def out() -> dict:
            m = np.zeros((len(vs), width), np.int64)
            for i, v in enumerate(vs):
                m[i, : len(v)] = v
            m = _whole_numbers(m)
            return {"part": [part], "width": [width], "small": [m.dtype == np.int32], "ids": [np.array(ids, np.int64).tobytes()], "weights": [m.tobytes()], "query": [np.array(flags, bool).tobytes()], "high": [m.max(0).tobytes()], "low": [m.min(0).tobytes()]}

        for batch in batches:
            values, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *batch.column(1).value_lengths().to_pylist()])
            for i, (key, query) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                v = values[ends[i] : ends[i + 1]]
                if ids and (len(ids) + 1) * max(width, len(v), 2) * 4 > CELL_BYTES:
                    yield out()
                    ids, vs, flags, width = [], [], [], 0
                ids.append(key)
                vs.append(v)
                flags.append(query)
                width = max(width, len(v))
        if ids:
            yield out()

    schema = "part int, width int, small boolean, ids binary, weights binary, query binary, high binary, low binary"
    return materialise(rows_of(rows, [F.col("id"), F.col("v"), F.col("query")], schema, pack).withColumn("shard", F.monotonically_increasing_id()))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly: in doubles where every sum stays below 2^53, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no score of a query with a row between low and high exceeds, for each pair."""
    return _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)


def _same_width(*arrays: np.ndarray) -> list[np.ndarray]:
    width = max(x.shape[1] for x in arrays)
    return [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in arrays]


def best_of_shard(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None, least: np.ndarray | None = None, rows: int = BLOCK_ROWS, scored: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best rows of the shard, best first. own: the
    row of the shard that each query is itself; least: scores below it are not asked for;
    scored: gets the number of queries each time a block is scored."""
    q, x = _same_width(q, x)
    blocks = [(lo, ids[lo : lo + rows], x[lo : lo + rows]) for lo in range(0, len(ids), rows)]
    high, low = (np.array([f(b, axis=0) for _, _, b in blocks]) for f in (np.max, np.min))
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    top_s = np.full((len(q), k), NONE)
    top_i = np.full((len(q), k), np.iinfo(np.int64).max)
    have = np.zeros(len(q), np.int64)
    least = np.full(len(q), NONE) if least is None else least
    live = np.arange(len(q))
    for step in range(len(blocks)):
        at = order[live, step]
        # a bound equal to the kth score may still hide a smaller id
        go = bound[live, at] >= np.maximum(top_s[live, k - 1], least[live])
        live, at = live[go], at[go]
        if not len(live):
            break
        for b in np.unique(at):
            who = live[at == b]
            if scored is not None:
                scored.append(len(who))
            for lo in range(0, len(who), 1024):
                w = who[lo : lo + 1024]
                first, block_ids, block = blocks[b]
                s = _product(q[w], block)
                if own is not None:
                    here = np.flatnonzero((own[w] >= first) & (own[w] < first + len(block)))
                    s[here, own[w][here] - first] = NONE
                take = min(k, s.shape[1])
                kth = -np.partition(-s, take - 1, axis=1)[:, take - 1]
                floor = np.maximum(np.maximum(kth if take == k else NONE, top_s[w, k - 1]), least[w])
                for row, r in enumerate(w):
                    c = np.flatnonzero((s[row] >= floor[row]) & (s[row] > NONE))
                    if not len(c):
                        continue
                    every_s, every_i = np.concatenate([top_s[r, : have[r]], s[row, c]]), np.concatenate([top_i[r, : have[r]], block_ids[c]])
                    best = np.lexsort((every_i, -every_s))[:k]
                    have[r] = len(best)
                    top_s[r, : have[r]], top_i[r, : have[r]] = every_s[best], every_i[best]
    return [(top_i[r, : have[r]], top_s[r, : have[r]]) for r in range(len(q))]


def _at_home(shards: DataFrame, k: int) -> DataFrame:
    """The query set of each shard that holds queries: shard, part, width, small, ids, weights,
    kth (what the shard itself gives; NONE where it has fewer rows) and the best of the shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.flatnonzero(np.frombuffer(row["query"], bool))
                if not len(own):
                    continue
                ids, x = np.frombuffer(row["ids"], np.int64), _read(row, "weights")
                best = best_of_shard(x[own], ids, x, k, own)
                kth = [s[-1] if len(s) == k else NONE for _, s in best]
                q = x[own].astype(np.int32 if row["small"] else np.int64)
                yield {"shard": [row["shard"]], "part": [row["part"]], "width": [row["width"]], "small": [row["small"]], "ids": [ids[own].tobytes()], "weights": [q.tobytes()], "kth": [np.array(kth, np.int64).tobytes()], "best": [[{"ids": i.tolist(), "scores": s.tolist()} for i, s in best]]}

    columns = [F.col(c) for c in ("shard", "part", "width", "small", "ids", "weights", "query")]
    return materialise(rows_of(shards, columns, "shard long, part int, width int, small boolean, ids binary, weights binary, kth binary, best array<struct<ids:array<long>,scores:array<long>>>", work))


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: query sets, right: shards' bounds. Which sets need which shards."""
    out: list[list[int]] = [[], []]
    sums = right.to_pylist()
    for row in left.to_pylist():
        q, kth = _read(row, "weights"), np.frombuffer(row["kth"], np.int64)
        for s in sums:
            if s["shard"] != row["queries"]:
                a, high, low = _same_width(q, _read({**s, "ids": b"12345678"}, "high"), _read({**s, "ids": b"12345678"}, "low"))
                if (bounds(a, high, low)[:, 0] >= kth).any():
                    out[0].append(row["queries"])
                    out[1].append(s["shard"])
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names=["queries", "shard"])


def _tile(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    out: list[list] = [[], [], [], []]
    for row in right.to_pylist():
        q = _read(row, "weights")
        for s in left.to_pylist():
            found = best_of_shard(q, np.frombuffer(s["ids"], np.int64), _read(s, "weights"), k, None, np.frombuffer(row["kth"], np.int64))
            for j, (best, scores) in enumerate(found):
                if len(best):
                    for column, x in zip(out, (row["queries"], j, best.tolist(), scores.tolist()), strict=True):
                        column.append(x)
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["queries", "j", "ids", "scores"])


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """id, v: components as floor(scale * component); rows that can take no part are left out."""
    v = F.transform(vectors[vector], lambda x: x.cast("double"))
    whole = vectors[key].isNotNull() & vectors[vector].isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(whole).select(vectors[key].cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def top_k(rows: DataFrame, query: Column, k: int = 20) -> DataFrame:
    """rows: id, v (integers). For each row where the condition query holds: query_id, rank from
    1, id, score of its k best other rows."""
    heavy = F.sort_array(F.transform("v", lambda x, i: F.struct(F.abs(x).alias("w"), i.alias("i"))), asc=False)
    like = F.slice(F.transform(heavy, lambda s: s["i"]), 1, 3)
    marked = rows.select("id", "v", F.coalesce(query, F.lit(False)).alias("query"), like.alias("like"))
    shards = _shards(marked.repartitionByRange("like", "id").sortWithinPartitions("like", "id"))
    sets = _at_home(shards, k).withColumnRenamed("shard", "queries")
    parts = (shards.agg(F.max("part")).first()[0] or 0) + 1
    every = lambda: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    sums = shards.select("shard", F.col("part").alias("of"), "width", "small", "high", "low").withColumn("part", every())
    asking = sets.select("queries", "part", "width", "small", "ids", "weights", "kth").withColumn("of", every())
    keys = ("of", "part")
    need = materialise(asking.groupBy(*keys).cogroup(sums.groupBy(*keys)).applyInArrow(_pairs, "queries long, shard long"))
    wide = [F.col(c).alias(c) for c in ("width", "small", "ids", "weights")]
    left = need.join(shards.select(F.col("shard").alias("at"), *wide), F.col("shard") == F.col("at")).select(F.col("shard").alias("x"), F.col("queries").alias("y"), *wide)
    right = need.join(sets.select(F.col("queries").alias("at"), *wide, "kth"), F.col("queries") == F.col("at")).select(F.col("shard").alias("x"), F.col("queries").alias("y"), *wide, "queries", "kth")
    keys = ("x", "y")
    far = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _tile(a, b, k), "queries long, j int, ids array<long>, scores array<long>")
    near = sets.select("queries", F.posexplode("best").alias("j", "b")).select("queries", "j", "b.ids", "b.scores")
    pairs = far.unionByName(near).select("queries", "j", F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("id"))).alias("best"))
    best = pairs.groupBy("queries", "j").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield {"at": [shard] * len(own), "place": list(range(len(own))), "query_id": own}

    named = rows_of(sets, [F.col("queries"), F.col("ids")], "at long, place int, query_id long", names)
    found = best.join(named, (F.col("queries") == F.col("at")) & (F.col("j") == F.col("place")))
    return found.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))
