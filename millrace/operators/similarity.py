"""Edit distance, Jaro-Winkler, key collisions, clusters and fuzzy de-duplication.

Built-in functions do edit distance and n-gram keys; Jaro-Winkler and Unicode decomposition
are Arrow functions. Pairwise work is dealt out in tiles of bounded size, and only values whose
lengths and letters leave room for the threshold are compared; the greedy, order-dependent
rules then run on each connected group of similar values, which is where they can act, so no
block of the data goes to one task as a whole.
"""

from __future__ import annotations

import heapq
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..plans.scratch import materialise
from ..plans.table import RID, Table

TILE = 512


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / most)


def jaro_winkler_of(a: str, b: str) -> float:
    """Prefix up to 4, weight 0.1, whatever the Jaro similarity is; half transpositions count."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, unused in zip(b, free, strict=True) if not unused]
    m = len(left)
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def most_similar(n: int, m: int) -> float:
    """The highest similarity that texts of these lengths can have."""
    if not n or not m:
        return 1.0 if n == m else 0.0
    jaro = (2 + min(n, m) / max(n, m)) / 3
    return jaro + 0.4 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def _plain(c: pd.Series) -> pd.Series:
    """Lower case, decomposed, without diacritics."""
    return c.map(lambda s: None if s is None else "".join(x for x in unicodedata.normalize("NFKD", s.strip().lower()) if not "̀" <= x <= "ͯ"))


def fingerprint(c: Column) -> Column:
    """Sorted distinct words without case, accents and punctuation."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(_plain(c), r"[^a-z0-9\s]", " "), r"\s+", " ")), " ")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def ngram_fingerprint(c: Column, n: int = 2) -> Column:
    """Sorted distinct n-grams of letters and digits; empty for shorter texts."""
    x = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(F.length(x) < n, F.lit("")).otherwise(F.array_join(F.array_sort(F.array_distinct(grams)), ""))


# -- clusters -----------------------------------------------------------------------------------


def value_counts(t: Table, column: str) -> DataFrame:
    """value, n, first: non-blank cells as text."""
    m = t.find(column)
    if m is None:
        raise KeyError(f"no column {column!r}")
    return t.df.where(~t.blank(m)).groupBy(t.render(m).alias("value")).agg(F.count("*").alias("n"), F.min(RID).alias("first"))


def _cluster_rows(members: DataFrame, key: str) -> DataFrame:
    """key, suggestion, total, first, values: clusters of two or more distinct values."""
    one = F.struct((-F.col("n")).alias("m"), F.col("first"), F.col("value"))
    by = members.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("all"), F.sum("n").alias("total"), F.min("first").alias("first"))
    return by.where(F.size("all") >= 2).select(F.col(key).alias("key"), F.col("all")[0]["value"].alias("suggestion"), "total", "first", F.transform("all", lambda x: x["value"]).alias("values"))


def key_clusters(values: DataFrame, method: str = "fingerprint") -> DataFrame:
    """Values that share a key, heaviest cluster first when ordered by total and first."""
    key = fingerprint(F.col("value")) if method == "fingerprint" else ngram_fingerprint(F.col("value"))
    return _cluster_rows(values.withColumn("key", key).where("key <> ''"), "key")


def similar_pairs(items: DataFrame, threshold: float, block: str | None = None) -> DataFrame:
    """items: id, s (distinct) and the block column. a < b of one block whose similarity reaches
    the threshold. The items of a block and length are dealt out into chunks of some TILE items,
    and a chunk meets those whose length leaves room for the threshold: each such pair of chunks
    is a tile, one group of bounded size. In a tile, pairs whose letters can't reach the
    threshold are passed over before any is compared."""
    place = items.select("id", "s", (F.lit("") if block is None else F.col(block)).alias("b"), F.length("s").alias("n"))
    sizes = materialise(place.groupBy("b", "n").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks")))  # a row for each length of a block
    own = place.join(sizes, ["b", "n"]).select("b", "n", "id", "s", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    other = sizes.select(F.col("b").alias("ob"), F.col("n").alias("on"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("oc"))
    small, large = F.least("n", "on"), F.greatest("n", "on")
    most = F.when(large == 0, 1.0).otherwise((2 + small / large) / 3)
    met = own.join(other, (F.col("b") == F.col("ob")) & (most + 0.4 * (1 - most) >= threshold - 1e-9))
    mine, theirs = F.struct("n", "chunk"), F.struct(F.col("on").alias("n"), F.col("oc").alias("chunk"))
    spread = met.select("b", F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), (mine == theirs).alias("same"), (mine <= theirs).alias("left"), "id", "s")

    def tile(key, table):
        ids, texts = table.column("id").to_numpy(), table.column("s").to_pylist()
        counts, lengths = _letters(texts), np.array([len(x) for x in texts])
        same, left = table.column("same").to_numpy(zero_copy_only=False), table.column("left").to_numpy(zero_copy_only=False)
        one = bool(same[0])
        rows = np.arange(len(texts)) if one else np.flatnonzero(left)
        others = rows if one else np.flatnonzero(~left)
        out: list[tuple[int, int]] = []
        for k, x in enumerate(rows):
            rest = others[k + 1 :] if one else others
            for y in rest[_could_reach(counts[x], lengths[x], counts[rest], lengths[rest], threshold)]:
                if jaro_winkler_of(texts[x], texts[y]) >= threshold:
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.Table.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return spread.groupBy("b", "i", "j").applyInArrow(tile, "a long, b long")


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has each letter, letters dealt into 64 kinds."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, x in enumerate(texts):
        np.add.at(out[i], np.frombuffer(x.encode("utf-32-le"), np.uint32) & 63, 1)
    return out


def _could_reach(one: np.ndarray, n: int, others: np.ndarray, ns: np.ndarray, threshold: float) -> np.ndarray:
    """Whether as many matches as the letters allow would reach the threshold."""
    m = np.minimum(one, others).sum(1)
    most, least = np.maximum(np.maximum(n, ns), 1), np.maximum(np.minimum(n, ns), 1)
    jaro = np.where(m > 0, (m / most + m / least + 1) / 3, 0.0)
    jaro = np.where((n == 0) & (ns == 0), 1.0, np.minimum(jaro, 1.0))
    return jaro + 0.4 * (1 - jaro) >= threshold - 1e-9


def groups_of(pairs: DataFrame) -> DataFrame:
    """id, root for all ids of pairs (a, b): connected groups, by repeated least neighbours."""
    both = materialise(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    root = both.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("root"))
    while True:
        near = both.join(root, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("near"))
        new = root.join(near, root.id == near.a).select("id", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved"))
        # jump to the root's root
        jump = new.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = materialise(new.join(jump, "root").select("id", F.col("far").alias("root"), (F.col("moved") | (F.col("far") < F.col("root"))).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("id", "root")
        root = new.select("id", "root")


def nearest_clusters(values: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Greedy leaders: in order of first appearance, an unused value takes all later unused
    values that are similar enough."""
    items = values.select(F.col("first").alias("id"), F.lower("value").alias("s"), "value", "n")
    leaders = _leaders(items.select("id", "s"), threshold)
    members = items.join(leaders, "id").select(F.concat(F.lit("nn_"), F.col("leader")).alias("k"), "value", "n", F.col("id").alias("first"))
    return _cluster_rows(members, "k")


def _leaders(items: DataFrame, threshold: float, block: str | None = None) -> DataFrame:
    """id, leader of each of some items (id, s, a block column) that has a similar one. Items
    of one text share their similarities, so the first stands for all. The rule runs in each
    connected group of similar texts."""
    by = [c for c in ("s", block) if c]
    firsts = materialise(items.groupBy(*by).agg(F.min("id").alias("id")))
    pairs = materialise(similar_pairs(firsts, threshold, block))
    near = pairs.groupBy("a").agg(F.collect_list("b").alias("later"))
    rows = groups_of(pairs).join(near, F.col("id") == F.col("a"), "left").select("root", "id", F.coalesce("later", F.array().cast("array<bigint>")).alias("later"))

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        leader: dict[int, int] = {}
        for i, later in group.sort_values("id")[["id", "later"]].itertuples(index=False):
            if i not in leader:
                leader[i] = i
                for j in later:
                    leader.setdefault(j, i)
        return pd.DataFrame({"one": list(leader), "leader": list(leader.values())})

    led = firsts.join(rows.groupBy("root").applyInPandas(lead, "one long, leader long"), F.col("id") == F.col("one"), "left")
    to = led.select(*[F.col(c).alias(f"_{c}") for c in by], F.coalesce("leader", "id").alias("leader"))
    match = F.lit(True)
    for c in by:
        match = match & (F.col(c) == F.col(f"_{c}"))
    return items.join(to, match).select("id", "leader")


def clusters(t: Table, column: str, method: str = "fingerprint", threshold: float = 0.82) -> DataFrame:
    """The clusters of a column's values: fingerprint, ngram or levenshtein (nearest)."""
    values = value_counts(t, column)
    return nearest_clusters(values, threshold) if method == "levenshtein" else key_clusters(values, method)


def mapping_of(found: DataFrame) -> dict[str, str]:
    """The merge mapping that accepts all clusters."""
    return {v: r["suggestion"] for r in found.toLocalIterator() for v in r["values"]}


# -- fuzzy de-duplication -------------------------------------------------------------------------


def fuzzy_key(t: Table, columns) -> Column:
    joined = F.lower(F.concat_ws(" ", *[t.text(m) for m in t.pick(columns)])) if t.pick(columns) else F.lit("")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9 ]", ""), " +", " "))


def fuzzy_dedupe(t: Table, columns, threshold: float, survivorship: str = "first") -> Table:
    """Rows whose keys are similar enough, within blocks of the key's first character, lose
    all but one: the first, the longest key or the row with fewest blanks. Greedy in row
    order, as stated; rows with empty keys are never compared. Keys are compared once each,
    however many rows have them; for "first" no group's rows are gathered either, for the
    others a connected group of similar keys is settled in one task, from three numbers a row."""
    if threshold > 1:
        return t  # nothing is so similar
    keyed = t.df.select(F.col(RID).alias("id"), fuzzy_key(t, columns).alias("s"), _blanks(t).alias("blanks")).where("s <> ''").withColumn("block", F.substring("s", 1, 1))
    if survivorship not in ("longest", "mostComplete"):
        led = _leaders(keyed.select("id", "s", "block"), threshold, "block")
        gone = led.where(F.col("id") != F.col("leader")).select(F.col("id").alias("__gone"))
    else:
        gone = _settled(materialise(keyed), threshold, survivorship)
    return t.with_df(t.df.join(gone, F.col(RID) == F.col("__gone"), "left_anti"))


def _blanks(t: Table) -> Column:
    return sum((t.blank(m).cast("int") for m in t.metas), F.lit(0))


def _settled(keyed: DataFrame, threshold: float, survivorship: str) -> DataFrame:
    """The rows that go, where a later row may replace an earlier one."""
    keys = materialise(keyed.groupBy("block", "s").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    pairs = materialise(similar_pairs(keys.drop("n"), threshold, "block"))
    roots = groups_of(pairs).withColumnRenamed("id", "at")
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.groupBy("a").agg(F.collect_list("b").alias("near"))
    known = keys.join(roots, F.col("id") == F.col("at"), "left").join(near, F.col("id") == F.col("a"), "left")
    known = known.where(F.col("at").isNotNull() | (F.col("n") > 1)).select(F.col("block").alias("_block"), F.col("s").alias("_s"), F.col("id").alias("key"), F.coalesce("root", "id").alias("root"), F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    rows = keyed.join(known, (F.col("s") == F.col("_s")) & (F.col("block") == F.col("_block")))
    rows = rows.select("root", "id", "key", F.length("s").alias("size"), "blanks", F.when(F.col("id") == F.col("key"), F.col("near")).alias("near"))

    def survive(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        near = {k: {k, *n} for k, n in group[["key", "near"]].itertuples(index=False) if n is not None}
        left: dict[int, list[tuple[int, int, int]]] = {}
        for i, k, size, blanks in group[["id", "key", "size", "blanks"]].itertuples(index=False):
            left.setdefault(k, []).append((i, size, blanks))
        gone: set[int] = set()
        for i, k, size, blanks in group[["id", "key", "size", "blanks"]].itertuples(index=False):
            if i in gone:
                continue
            # what the row is compared with, in row order; rows that go are never met again
            met = heapq.merge(*[left[o] for o in near[k]])
            taken: set[int] = set()
            for j, other_size, other_blanks in met:
                if j <= i or j in gone:
                    continue
                if (survivorship == "longest" and other_size > size) or (survivorship == "mostComplete" and other_blanks < blanks):
                    gone.add(i)
                    break
                taken.add(j)
            gone |= taken
            for o in near[k]:
                left[o] = [r for r in left[o] if r[0] > i and r[0] not in gone]
        return pd.DataFrame({"__gone": sorted(gone)}, dtype="int64")

    return rows.groupBy("root").applyInPandas(survive, "__gone long")
