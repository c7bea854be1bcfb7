"""Toxicity by two class-conditional Kneser-Ney models.

One model is of texts labelled toxic, one of ordinary ones. A word's probability after the word
before it is interpolated: the bigram's count of texts less PAIRS, and the rest of the mass from the
word's lower-order probability. There a word counts once for each different word that it
follows (its continuations), less DISCOUNT, and backs off to its first letters (PREFIXES bytes,
longer ones first), which count the continuations of all words that begin so. Within what a
level backs off to, an expression has its share of the counts of both classes together, and so
has the last level as a whole: so an expression that the classes have too rarely to tell is
as likely in either, and an unseen word is judged by words that begin like it.

A token's evidence is the log ratio of its toxic and its ordinary probability. A text's is the
mean over its tokens (the two log-likelihoods, length-normalised and compared), and the sum of
what its different words have above a bound, in logs and set against the length, which a long
text doesn't dilute. That sum is over evidence by continuations alone (a passage that some texts
share gives its words one continuation, however many the texts, while its bigrams look strong)
or over that after the word before (for expressions that always follow one word). A logistic curve over these gives the score; it is fitted on texts that the
counts it sees have not seen (two halves, crosswise), and so are the bound, one of EVIDENT, and
the kind of sum: those with the likeliest labels.

Fitted on a sample of labelled rows: of each class the SAMPLE_ROWS rows whose id has the
smallest hash, a bound however many there are, less near copies of others (a bigram counts once
a text). Expressions that a class has no oftener than the discount have no mass of their own, so the
model holds the others, and none of them is cut. Only words of the text are
inputs. Every text is scored whole.

Nulls: a null text is an empty text; rows with a null label or id teach nothing, and a
null id counts as the empty text for the fold. A text without words has no evidence. If a
class has no labelled text, the score is the share of toxic rows (0 if none). Repeated rows
each get a row; of rows with one id one teaches, with the higher label. An empty table gives an
empty one. Columns may have any names; a kept one with the score's name is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, as_bytes, id_hash, letter_words, materialise, release, rows_of
from .near_dedup import shingles, sketch

SAMPLE_ROWS = 4_000
DISCOUNT = 1
PAIRS = 3  # the discount of bigrams: near copies of a text may give it that often
EVIDENT = (3.0, 4.0, 5.0, 6.0)
PREFIXES = (6, 4)
COPY_BITS = 96  # of 384 that two texts' sketches may differ in and still be copies
FLUSH = 60_000


@dataclass
class Model:
    place: dict[bytes, int] = field(default_factory=dict)  # of a word
    begins: list[dict[bytes, int]] = field(default_factory=list)  # places by first letters, longest first
    word: np.ndarray | None = None  # 2 x places: P_c(w), or what an unseen word with those letters gets
    backoff: np.ndarray | None = None  # 2 x places: the weight of P_c(w) after v
    keys: np.ndarray | None = None  # place of v * places + place of w, sorted
    bigram: np.ndarray | None = None  # 2 x keys: the discounted part
    weights: np.ndarray | None = None
    evident: int = 0  # which of EVIDENT, by continuations and then after the word before
    prior: float = 0.0

    def places(self, ws: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.place.get, ws, [0] * len(ws)), np.int64, len(ws))
        for i in np.flatnonzero(at == 0).tolist():
            for size, known in zip(PREFIXES, self.begins, strict=True):
                found = known.get(ws[i][:size])
                if found:
                    at[i] = found
                    break
        return at

    def evidence(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token after the one before it, and of each by its continuations alone."""
        w = self.places(ws)
        v = np.concatenate([[0], w[:-1]])
        lower = self.word[:, w]
        p = self.backoff[:, v] * lower
        if len(self.keys):
            k = v * len(self.word[0]) + w
            at = np.searchsorted(self.keys, k)
            at[at == len(self.keys)] = 0
            some = np.flatnonzero(self.keys[at] == k)
            p[:, some] += self.bigram[:, at[some]]
        return np.log(p[1] / p[0]), np.log(lower[1] / lower[0])

    def features(self, text: bytes) -> list[float]:
        ws = letter_words(text)
        n = len(ws)
        if not n:
            return [0.0] * (2 + 4 * len(EVIDENT))
        e, lower = self.evidence(ws)
        out = [float(e.mean()), float(np.log1p(n))]
        for each in (lower, e):
            strong = {ws[i]: float(each[i]) for i in np.flatnonzero(each > EVIDENT[0]).tolist()}
            for least in EVIDENT:
                found = sum(x - least for x in strong.values() if x > least)
                out += (float(np.log1p(found)), found / n)
        return out

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return self.prior
        f = self.features(text)
        x = np.array([1.0, *f[:2], *f[2 + 2 * self.evident : 4 + 2 * self.evident]])
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40))))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn) -> tuple[DataFrame, dict[int, int]]:
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("c")).where(F.col("k").isNotNull() & F.col("c").isin(0, 1) & learn(F.col("k")))
    known = known.groupBy("k").agg(F.max("c").alias("c"))
    sizes = {r["c"]: r["count"] for r in known.groupBy("c").count().collect()}
    chosen = None
    for c in sizes:
        part = known.where(F.col("c") == c).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return None, sizes
    chosen = materialise(chosen)  # at most 2 * SAMPLE_ROWS ids
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    texts = materialise(texts.select("k", "c", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(2)).cast("int").alias("half"), "t"))
    return _without_copies(texts), sizes


def _without_copies(texts: DataFrame) -> DataFrame:
    """Of texts that are nearly the same, the one with the smallest id. The sample is bounded,
    and so are its sketches."""
    sketches = arrow_map(texts, {"t": F.col("t")}, ["k"], {"s": "binary"}, lambda got: {"s": [sketch(shingles(t, 3)) for t in as_bytes(got["t"])]}).toArrow().sort_by("k")
    if not sketches.num_rows:
        return texts
    bits = np.frombuffer(b"".join(sketches.column("s").to_pylist()), np.uint8).reshape(sketches.num_rows, -1).view(np.uint64)
    free = np.ones(len(bits), bool)
    for i in range(len(bits)):
        if free[i]:
            free[i + 1 :] &= np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(1) > COPY_BITS
    ids = {k for k, stays in zip(sketches.column("k").to_pylist(), free.tolist(), strict=True) if stays}
    kept = texts.sparkSession.createDataFrame([(k,) for k in sorted(ids)], T.StructType([T.StructField("k", texts.schema["k"].dataType)]))
    return texts.join(F.broadcast(kept), "k").dropDuplicates(["k"])


#: The counts of one model each: of both halves, and of each half, by class.
MODELS = ("", "0", "1")


def _counts(texts: DataFrame) -> DataFrame:
    """v, w, and by half and class (n00, n01, n10, n11) how many texts hold each bigram; v is
    empty at a text's start."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: Counter = Counter()
        for batch in batches:
            for half, c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                held.update((2 * half + c, v, w) for v, w in set(pairwise([b"", *letter_words(t)])))
                if len(held) >= FLUSH:
                    yield flat(held)
                    held.clear()
        yield flat(held)

    def flat(held: Counter) -> dict:
        return {"v": [k[1] for k in held], "w": [k[2] for k in held]} | {f"n{i:02b}": [n * (k[0] == i) for k, n in held.items()] for i in range(4)}

    found = rows_of(texts, [F.col("half"), F.col("c"), F.col("t")], "v binary, w binary, n00 long, n01 long, n10 long, n11 long", count)
    return found.groupBy("v", "w").agg(*[F.sum(n).alias(n) for n in ("n00", "n01", "n10", "n11")])


def _by_model(c: int, half: str) -> Column:
    return F.col(f"n{half}{c}") if half else F.col(f"n0{c}") + F.col(f"n1{c}")


_COLUMNS = [f"m{half}_{c}" for half in MODELS for c in (0, 1)]


def _held(rows: DataFrame, discount: int) -> DataFrame:
    """Rows that some model has oftener than the discount in a class, and so holds."""
    some = F.lit(False)
    for c in _COLUMNS:
        some = some | (F.col(c) > discount)
    return rows.where(some)


def _levels(counts: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """By word and by first letters: x, continuations for each model and class. By bigram: v, w,
    counts. By first word: x, sum of counts and of discounted counts."""
    texts = [_by_model(c, half).alias(f"m{half}_{c}") for half in MODELS for c in (0, 1)]
    pairs = counts.select("v", "w", *texts)
    once = pairs.select("w", *[(F.col(c) > 0).cast("long").alias(c) for c in _COLUMNS])
    words = materialise(once.groupBy(F.col("w").alias("x")).agg(*[F.sum(c).alias(c) for c in _COLUMNS]))
    begins = [words.groupBy(F.substring("x", 1, k).alias("x")).agg(*[F.sum(c).alias(c) for c in _COLUMNS]) for k in PREFIXES]
    less = [F.sum(F.greatest(F.col(c) - PAIRS, F.lit(0))).alias(f"d{c}") for c in _COLUMNS]
    firsts = pairs.where(F.length("v") > 0).groupBy(F.col("v").alias("x")).agg(*[F.sum(c).alias(c) for c in _COLUMNS], *less)
    return [words, *map(materialise, begins)], pairs, firsts


class Levels:
    """What all models need, gathered once: expressions that some model holds, and their places
    in every model, which the models share."""

    def __init__(self, counts: DataFrame):
        levels, pairs, firsts = _levels(counts)
        self.sums, self.names, self.counts = [], [], []
        for level in levels:
            total = level.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COLUMNS], *[F.coalesce(F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0))), F.lit(0)).alias(f"d{c}") for c in _COLUMNS]).first()
            self.sums.append({c: (float(total[c]), float(total[f"d{c}"])) for c in _COLUMNS})
            held = _held(level, DISCOUNT).orderBy("x").toArrow()
            self.names.append([bytes(x) for x in held.column("x").to_pylist()])
            self.counts.append({c: held.column(c).to_numpy().astype(float) for c in _COLUMNS})
        heads = firsts.where(sum((F.col(f"d{c}") for c in _COLUMNS), F.lit(0)) > 0).toArrow()
        self.heads = [bytes(x) for x in heads.column("x").to_pylist()]
        self.head_counts = {c: heads.column(c).to_numpy().astype(float) for c in (*_COLUMNS, *(f"d{c}" for c in _COLUMNS))}
        kept = _held(pairs.where(F.length("v") > 0), PAIRS).toArrow()
        self.pair_counts = {c: kept.column(c).to_numpy().astype(float) for c in _COLUMNS}
        # place 0 is an expression that no level knows
        starts = np.cumsum([1, *map(len, self.names)]).tolist()
        self.places = [dict(zip(x, range(at, at + len(x)), strict=True)) for x, at in zip(self.names, starts, strict=False)]
        # of each name the place of its first letters in the level below, from 1
        self.below = [np.array([known.get(x[:size], at - 1) - at + 1 for x in names], np.int64) for names, known, at, size in zip(self.names, self.places[1:], starts[1:], PREFIXES, strict=False)]
        get = lambda xs: np.array([self.places[0].get(x, 0) for x in xs], np.int64)
        of = {x: i for i, x in enumerate(self.heads)}
        first = kept.column("v").to_pylist()
        self.head_places = get(self.heads)
        self.pair_places = get(first), get(kept.column("w").to_pylist())
        self.pair_heads = np.array([of.get(x, 0) for x in first], np.int64)

    def model(self, half: str) -> Model | None:
        columns = [f"m{half}_{c}" for c in (0, 1)]
        if not all(self.sums[0][c][0] for c in columns):
            return None
        made = Model()
        blocks = []
        below, total = None, sum(self.sums[-1][c][0] for c in columns)
        # from the fewest letters up to whole words
        for level in range(len(self.names) - 1, -1, -1):
            counts = np.array([self.counts[level][c] for c in columns])
            n = counts.sum(0)
            if below is None:
                lower = np.tile(np.maximum(n, 1) / total, (2, 1))
            else:
                p, weight, size = below
                place = self.below[level]
                # what this model hasn't seen gets its first letters' probability, but for a factor
                # that is the same for both classes
                share = np.where(n > 0, n / np.maximum(size[place], 1), 1.0)
                lower = np.where(place > 0, p[:, place], weight[:, None]) * share
            free = np.array([1 - self.sums[level][c][1] / self.sums[level][c][0] for c in columns])
            own = np.array([np.maximum(counts[c] - DISCOUNT, 0) / self.sums[level][columns[c]][0] for c in (0, 1)])
            p = own + free[:, None] * lower
            rest = free * (below[1] if below else 1.0)
            below = (np.concatenate([rest[:, None], p], axis=1), rest, np.concatenate([[0.0], n]))
            blocks.append((p, free))
        # an unseen word with known first letters: the mass that levels above leave to them
        made.place, *made.begins = self.places
        p, weight = blocks[-1]
        table = [below[1][:, None], p]
        for p, free in blocks[-2::-1]:
            table.append(p * weight[:, None])
            weight = weight * free
        made.word = np.maximum(np.concatenate(table, axis=1), 1e-300)
        self._bigrams(made, columns)
        return made

    def _bigrams(self, made: Model, columns: list[str]) -> None:
        n = made.word.shape[1]
        made.backoff = np.ones((2, n))
        sums = np.array([self.head_counts[c] for c in columns])
        less = np.array([self.head_counts[f"d{c}"] for c in columns])
        free = np.where(sums > 0, 1 - less / np.maximum(sums, 1), 1.0)
        known = np.flatnonzero(self.head_places)
        made.backoff[:, self.head_places[known]] = free[:, known]
        (v, w), head = self.pair_places, self.pair_heads
        counts = np.array([self.pair_counts[c] for c in columns]).reshape(2, -1)
        p = np.maximum(counts - PAIRS, 0) / np.maximum(sums[:, head], 1) if len(head) else counts
        kept = np.flatnonzero((v > 0) & (w > 0) & (p.sum(0) > 0)) if len(head) else np.zeros(0, np.int64)
        order = kept[np.argsort(v[kept] * n + w[kept])]
        made.keys, made.bigram = v[order] * n + w[order], p[:, order]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn=lambda k: F.lit(True)) -> Model:
    """learn: which ids may teach."""
    sample, sizes = _sample(docs, labels, key, text, label, learn)
    model = Model(prior=sizes.get(1, 0) / max(1, sum(sizes.values())))
    if len(sizes) < 2:
        return model
    levels = Levels(materialise(_counts(sample)))
    whole, *halves = [levels.model(half) for half in MODELS]
    if whole is None or None in halves:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(halves)
    crosswise = arrow_map(sample, {"t": F.col("t"), "half": F.col("half")}, ["c"], {"f": "array<double>"}, lambda got: {"f": [sent.value[1 - h].features(x) for h, x in zip(got["half"].to_pylist(), as_bytes(got["t"]), strict=True)]})
    rows = crosswise.collect()  # at most 2 * SAMPLE_ROWS labelled ids, eighteen numbers each
    sent.destroy()
    del levels, halves
    release()
    y = np.array([r["c"] for r in rows], float)
    if len(set(y)) < 2:
        return model
    f = np.array([r["f"] for r in rows])
    share = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    share /= share.mean()
    best = np.inf
    for k in range(2 * len(EVIDENT)):
        x = np.concatenate([np.ones((len(f), 1)), f[:, :2], f[:, 2 + 2 * k : 4 + 2 * k]], axis=1)
        scale = np.where(x.std(0) > 0, x.std(0), 1.0)
        weights = _logistic(x / scale, y, share) / scale
        loss = float((share * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ weights))).sum())
        if loss < best:
            best, whole.weights, whole.evident = loss, weights, k
    whole.prior = model.prior
    return whole


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (share * (p - y)) + ridge * w
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns (default: all) of every document, and its score from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs, {"t": docs[text]}, docs.columns if keep is None else keep, {name: "double"}, lambda got: {name: [sent.value.score(t) for t in as_bytes(got["t"])]})


def may_teach(k):
    """The fold of the query: ids whose crc32 mod 4 is 2 are held out."""
    return id_hash(k) % 4 != 2
