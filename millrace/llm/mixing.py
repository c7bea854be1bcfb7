"""Mixing to target weights with soft domain membership. DataFrame functions only.

A naive Bayes classifier, fitted on labelled rows, gives each document a posterior over the
domains (the values of a label). Its features are words of the text that tell the domains
apart (the VOCABULARY words of highest mutual information) and the shape of the text: the
share of signs that prose seldom holds and the mean word length, in steps.

Then each document gets a rate (how often it is to be read), so that the expected tokens of
each domain, the sum over documents of rate * tokens * posterior, match the targets. The
rates solve a nonnegative least-squares problem by projected gradient: from rate 1, each
step moves every rate along the posterior-weighted residual, scaled by the small matrix of
domain overlaps, and cuts it at zero. A step is one aggregate of as many sums as domains
squared; rates live in the documents' rows alone.

The classifier is fitted on the labelled ids with the smallest hash, SAMPLE_ROWS of each
domain at most; everything else is over all rows. Nulls: a null text has no tokens, the
prior as its posterior, and a rate as any other; rows with a null label or id teach nothing.
Without labels there is no domain and every rate is 1. Repeated rows each get a row, and an
empty table gives an empty one. Ties between words of equal information go to the smaller
word. Columns of the documents may have any names, as none is carried along; rates are joined
to rows by file and row in the file, which are the same however a scan is split.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, place, stable

SAMPLE_ROWS = 4_000
VOCABULARY = 256
MERGED = 4
STEPS = 40
TOLERANCE = 1e-7
RIDGE = 1e-3
KEPT = 6  # steps after which the rates so far become a column


#: Signs that prose seldom holds.
SIGNS = r"[#$%&*|_+=<>@^~/\\]"


def _split(rows: DataFrame) -> DataFrame:
    """_t as words w, in lower case, between ASCII white space."""
    plain = F.regexp_replace(F.lower(F.col("_t")), "[\\x09-\\x0D]", " ")
    return rows.withColumn("_w", F.array_remove(F.split(plain, " "), ""))


def _shape() -> Column:
    """A few names of what the text looks like; a text without characters has none."""
    n, words = F.length("_t"), F.size("_w")
    step = lambda name, x, most: F.concat(F.lit(f"\u0001{name}"), F.least(F.floor(x), F.lit(most)).cast("string"))
    shares = [step("p", 40 * F.regexp_count("_t", F.lit(SIGNS)) / n, 12), step("w", 2 * n / F.greatest(words, F.lit(1)), 40)]
    return F.when(n > 0, F.array(*shares)).otherwise(F.array().cast("array<string>"))


class Classifier:
    def __init__(self, prior: dict[int, float], logs: dict[str, list[float]]):
        self.domains, self.logs = sorted(prior), logs
        total = sum(prior.values())
        self.prior = [math.log(prior[d] / total) for d in self.domains]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier | None:
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("c")).where(F.col("k").isNotNull() & F.col("c").isNotNull()).groupBy("k").agg(F.max("c").alias("c"))
    sizes = {r["c"]: r["count"] for r in known.groupBy("c").count().collect()}
    if not sizes:
        return None
    chosen = None
    for c in sorted(sizes):
        part = known.where(F.col("c") == c).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(materialise(chosen)), "k")  # at most SAMPLE_ROWS ids a domain
    features = materialise(_split(texts).select("c", F.array_distinct(F.concat("_w", _shape())).alias("f")))
    n = {r["c"]: r["count"] for r in features.groupBy("c").count().collect()}
    if not n:
        return None
    domains = sorted(sizes)
    found = features.select("c", F.explode("f").alias("w")).groupBy("w").agg(*[F.sum((F.col("c") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)])
    every = float(sum(n.values()))
    total = sum(F.col(f"n{i}") for i in range(len(domains)))
    gain: Column = F.lit(0.0)
    for i, d in enumerate(domains):
        own = float(n.get(d, 0))
        for hit, size in ((F.col(f"n{i}"), total), (F.lit(own) - F.col(f"n{i}"), F.lit(every) - total)):
            gain = gain + F.when((hit > 0) & (size > 0), hit / every * F.log(hit * every / (size * F.lit(max(own, 1.0))))).otherwise(0.0)
    shape = F.col("w").startswith("\u0001")
    # a bounded sample's words: a few tasks, so that their best ones are few rows to merge
    top = found.where(~shape & (total >= 5)).coalesce(MERGED).orderBy(gain.desc(), "w").limit(VOCABULARY).unionByName(found.where(shape)).collect()  # a bounded vocabulary, and the few shapes
    logs = {r["w"]: [math.log((r[f"n{i}"] + 0.5) / (n.get(d, 0) + 1.0)) for i, d in enumerate(domains)] for r in top}
    return Classifier({d: float(sizes[d]) for d in domains}, logs)


def posteriors(docs: DataFrame, model: Classifier | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs: a table from stable(). _row (its file and row), key, n_tokens, p (an array, one share
    a domain) of every document."""
    rows = docs.select(place().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = _split(rows)
    size = F.size("_w").cast("long").alias("n_tokens")
    if model is None:
        return rows.select("_row", "_key", size, F.array(F.lit(1.0)).alias("p"))
    words = [F.lit(w) for w in model.logs if not w.startswith("\u0001")]
    vocabulary = F.array(*words) if words else F.array().cast("array<string>")
    base = materialise(rows.select("_row", "_key", size, F.concat(F.array_intersect("_w", vocabulary), _shape()).alias("f")))
    spark, k = docs.sparkSession, len(model.domains)
    weights = spark.createDataFrame([(w, *map(float, x)) for w, x in model.logs.items()], "w string, " + ", ".join(f"l{i} double" for i in range(k)))
    found = base.select("_row", F.explode("f").alias("w")).join(F.broadcast(weights), "w").groupBy("_row").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(k)])
    logs = base.join(found, "_row", "left").select("_row", "_key", "n_tokens", *[(F.coalesce(F.col(f"l{i}"), F.lit(0.0)) + model.prior[i]).alias(f"l{i}") for i in range(k)])
    top = F.greatest(*[F.col(f"l{i}") for i in range(k)]) if k > 1 else F.col("l0")
    raw = [F.exp(F.col(f"l{i}") - top) for i in range(k)]
    total = sum(raw[1:], raw[0])
    return logs.select("_row", "_key", "n_tokens", F.array(*[x / total for x in raw]).alias("p"))


def rates(members: DataFrame, targets: list[float]) -> tuple[DataFrame, dict]:
    """members: n_tokens, p. members with the rate, and what was reached."""
    k = len(targets)
    n, p = F.col("n_tokens").cast("double"), [F.col("p")[i] for i in range(k)]
    budget = float(members.agg(F.coalesce(F.sum(n), F.lit(0.0))).first()[0])
    goal = np.array(targets, float) / max(sum(targets), 1e-300)
    if not budget:
        return members.withColumn("rate", F.lit(1.0)), {"budget": 0.0, "reached": goal.tolist(), "steps": 0}
    columns = members.columns
    rate: Column = F.lit(1.0)
    best, best_gap, reached = rate, math.inf, goal
    for step in range(STEPS):
        sums = [F.sum(rate * n * p[i] / budget) for i in range(k)]
        overlap = [F.sum(F.when(rate > 0, n * p[i] * p[j] / budget).otherwise(0.0)) for i in range(k) for j in range(i, k)]
        got = [float(x or 0.0) for x in members.agg(*sums, *overlap).first()]
        gap = np.array(got[:k]) - goal
        if np.abs(gap).max() < best_gap:
            best, best_gap, reached = rate, float(np.abs(gap).max()), np.array(got[:k])
        if best_gap < TOLERANCE:
            break
        a = np.zeros((k, k))
        a[np.triu_indices(k)] = got[k:]
        a = a + a.T - np.diag(np.diag(a))
        move = np.linalg.solve(a + RIDGE * np.trace(a) / k * np.eye(k), gap)
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(float(m)) * x for m, x in zip(move, p, strict=True)), F.lit(0.0)))
        if step % KEPT == KEPT - 1:  # else each step makes the expression longer
            members = materialise(members.select(*columns, rate.alias("_rate"), best.alias("_best")))
            rate, best = F.col("_rate"), F.col("_best")
    return members.select(*columns, best.alias("rate")), {"budget": budget, "reached": reached.tolist(), "steps": step}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[int, float], key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """_row (file and row of a table from stable()), _key, n_tokens, p, rate of every document. A
    domain without a target gets none."""
    docs = stable(docs)
    model = fit(docs, labels, key, text, label)
    members = materialise(posteriors(docs, model, key, text))
    goal = [float(targets.get(d, 0.0)) for d in model.domains] if model else [1.0]
    return rates(members, goal if sum(goal) > 0 else [1.0] * len(goal))[0]
