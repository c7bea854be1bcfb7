"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits over word shingles; two documents link when their fingerprints
differ in at most two bits, and a class is a connected component of links.

Equal fingerprints are one point, so a group of copies costs one row however large it is.
Distinct points are dealt out by agreement: cut 64 bits into three blocks, and two points
within two bits agree on one whole block. Points that agree on a block meet in one group;
a group above GROUP_ROWS is cut again by agreement on a block of its other bits, and so on
until at most 2^13 distinct points can be left, so no group outgrows a task, whatever the
skew, and no link is lost. In a group the points, in order, are a binary trie; pairs of
nodes are walked from the roots down, level by level, adding one error where the branches
differ and dropping the pair at the third. Each group returns a spanning forest of its
links, which keeps components. Components come from alternating star contractions.

Nulls: a null text has no words and, as every text without words, fingerprint zero. A null
doc_id never is the smallest of its class unless all are null. Repeated rows each get a row.
An empty table gives an empty one. Bits that are set in just half the shingles are 0. Columns may have
any names; kept ones called fp or component_id are replaced. Copies of one text are joined to
their class in several tasks where there are very many of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, join_counted, materialise, pack, spaced, unpack

ERRORS = 2
GROUP_ROWS = 50_000
SEED = 42


def fingerprint(text: bytes, size: int) -> int:
    ws = spaced(text)
    if not ws:
        return 0
    if len(ws) < size:
        return xxhash.xxh64_intdigest(b" ".join(ws), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    votes = np.zeros(64, np.int64)
    grams = zip(*[ws[i:] for i in range(size)])
    n = len(ws) - size + 1
    h = np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, n)
    for lo in range(0, n, 65_536):
        part = h[lo : lo + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """The kept columns and the fingerprint as a signed 64-bit integer."""

    def work(got: dict) -> dict:
        return {name: pa.array(np.array([fingerprint(t, size) for t in as_bytes(got["text"])], np.uint64).view(np.int64))}

    return arrow_map(docs, {"text": docs[text]}, docs.columns if keep is None else keep, {name: "long"}, work)


def trie_pairs(values: np.ndarray, group: np.ndarray, errors: int = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of one group whose values differ in at most so many bits. values are
    sorted within each group and distinct there; groups stand together."""
    n = len(values)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [n]]) if n else starts
    a0, a1 = starts.astype(np.int64), ends.astype(np.int64)
    b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), np.int8)
    left, right = [], []
    for bit in range(63, -1, -1):
        own = a0 == b0
        live = ~(own & (a1 - a0 < 2))
        a0, a1, b0, b1, err, own = a0[live], a1[live], b0[live], b1[live], err[live], own[live]
        one = ~own & (a1 - a0 == 1) & (b1 - b0 == 1)  # two leaves: compare what is left of the bits
        if one.any():
            i, j = a0[one], b0[one]
            close = np.bitwise_count(values[i] ^ values[j]) <= errors
            left.append(i[close])
            right.append(j[close])
            a0, a1, b0, b1, err, own = (x[~one] for x in (a0, a1, b0, b1, err, own))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am = a1 - (ones[a1] - ones[a0])
        bm = b1 - (ones[b1] - ones[b0])
        more, other = err + np.int8(1), ~own
        parts = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, more, None), (am, a1, b0, bm, more, other)]
        kept = []
        for x0, x1, y0, y1, e, also in parts:
            ok = (x1 > x0) & (y1 > y0) & (e <= errors)
            if also is not None:
                ok &= also  # within one node, 0 with 1 is the same pair as 1 with 0
            kept.append([x[ok] for x in (x0, x1, y0, y1, e)])
        a0, a1, b0, b1, err = (np.concatenate([k[c] for k in kept]) for c in range(5))
    one = (a0 != b0) & (a1 > a0) & (b1 > b0)
    left.append(a0[one])
    right.append(b0[one])
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that links lead to."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if np.array_equal(low, high):
            return root
        np.minimum.at(root, high, low)
        while not np.array_equal(root, root[root]):
            root = root[root]


def _cut(mask: int, parts: int) -> list[int]:
    """The bits outside mask, in so many runs; each result is mask with one run more."""
    free = [b for b in range(64) if not mask >> b & 1]
    runs = [free[len(free) * k // parts : len(free) * (k + 1) // parts] for k in range(parts)]
    return [mask | sum(1 << b for b in run) for run in runs if run]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(groups: DataFrame) -> DataFrame:
    """groups: mask, part, fp. Spanning links a, b (b the smaller place's point)."""
    spread = groups.repartition("mask", "part").sortWithinPartitions("mask", "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def join(rows: np.ndarray) -> pa.RecordBatch:
            _, group = np.unique(rows[:2], axis=1, return_inverse=True)
            group = group.ravel()
            values = rows[2].view(np.uint64)
            order = np.lexsort((values, group))
            group, values = group[order], values[order]
            i, j = trie_pairs(values, group)
            root = forest(len(values), i, j)
            some = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(values[root[some]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.int64))
            size += batch.num_rows
            if size >= 4 * GROUP_ROWS:  # all whole groups; the last goes on
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield join(rows[:, :cut].copy())
                held, size = [rows[:, cut:].copy()], rows.shape[1] - cut
        if size:
            yield join(np.concatenate(held, axis=1))

    return spread.select("mask", "part", "fp").mapInArrow(work, "a long, b long")


def trie_links(points: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """points: distinct fp. Links a, b whose components are those of all links."""
    masks = _cut(0, ERRORS + 1)
    level = points.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    out = None
    while True:
        level = level.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp")
        sizes = level.groupBy("mask", "part").count().where("count > 1")
        free = 64 - min(m.bit_count() for m in masks)
        hot = materialise(sizes.where(F.col("count") > group_rows)) if free > 13 else None
        some = hot is not None and not hot.isEmpty()
        small = level.join(hot.select("mask", "part"), ["mask", "part"], "left_anti") if some else level
        links = _links(small)
        out = links if out is None else out.unionByName(links)
        if not some:
            return materialise(out.distinct())
        cuts = {m: _cut(m, ERRORS + 1) for m in masks}
        pick = F.coalesce(*[F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(c)) for c in cs])) for m, cs in cuts.items()])
        level = materialise(level.join(hot.select("mask", "part"), ["mask", "part"], "left_semi").select("fp", F.explode(pick).alias("mask")).distinct())
        masks = [c for cs in cuts.values() for c in cs]


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for each node of links (a, b), by
    large-star and small-star contraction; only sums come to the driver."""
    edges, before = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialise(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every document, with fp (signed 64 bits) and component_id (the
    smallest key in the class)."""
    keep = [key] if keep is None else keep
    packed = pack(docs, keep, id=docs[key], t=docs[text])
    marked = materialise(fingerprints(packed, size, "t", ["_doc", "id"], "fp"))
    points = materialise(marked.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    roots = components(trie_links(points.select("fp"))).withColumnRenamed("root", "of")
    rooted = points.join(roots, points.fp == roots.node, "left").select("fp", "rep", "copies", F.coalesce("of", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = materialise(rooted.join(classes, "root").select("fp", "copies", "component_id"))
    out = join_counted(marked, found, "fp", "copies", F.monotonically_increasing_id())
    return unpack(out, keep, fp=F.col("fp"), component_id=F.col("component_id"))
