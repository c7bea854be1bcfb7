"""LM scoring by a gated recurrent model with a class-factored output softmax.

A token's probability is that of its class given the text so far, times that of the word
within its class given the text so far: two softmaxes over the state of a gated recurrent
network. Classes: each of the SINGLES most frequent words (and the end) is a class of its own;
the other words share classes by their last two bytes. Units of a shared class, over which its
softmax runs, are those of its words that are among the UNITS most frequent ones, and one unit
for all its other words; of these, each has its smoothed share of the unit's training tokens,
(c + 0.1) / (N + 0.1 (V + 1)), and an unknown word is one more of them. So the vocabulary has
no bound, and the probabilities of all words of it and an unknown one sum to 1.

The network reads units: it has an input vector for each. Its state is carried from window to
window, so a text is scored whole; it is trained by backpropagation truncated to a window's
tokens. Output biases start at the logs of the training counts.

All counts are over all training texts, and the network learns from all of them once, in
ROUNDS: a round takes a share of the texts (by the hash of the text), each partition trains
the same weights on its own texts of that share, and the results are averaged by tokens (sums
go up a tree of tasks). Shares grow from round to round, and so does the number of places in
which texts run abreast, one text after another in each; long texts cost no padding. Rounds,
places and rates are the same at every size.

Counts of the HEAD most frequent words go to every executor, a fixed bound; other words of
a text are joined to the table of counts, which is never gathered anywhere. Each text is cut
into words and numbered once; the numbers are a table in the shared folder that all rounds and
the scoring read. Texts are cut in pieces of HELD bytes; what depends on a word alone is looked
up once for each different word of a piece. A text is held as words while it is numbered, so a
task needs some 60 bytes a word of its longest text.

Nulls: a null text is empty (its end is its one token); a null id counts as the empty text
for the fold. Repeated rows each get a row, and teach as often as they occur; words of equal
counts are taken in the order of their bytes. Without training texts (an empty table, too)
every word is unknown. Columns of the documents may have any names; a kept one that has the
name of a result is replaced.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, materialise, pack, rows_of, unpack

CLASSES = 64
SINGLES = 24
REST = 8
UNITS = 768
HIDDEN = 16
WINDOW = 16  # steps at least; more, up to LONGEST, where few texts are left and a window has less than FULL tokens
LONGEST = 128
FULL = 8_192
EACH = 1  # words within classes are learned in one of so many windows: in all
SLOTS = 1_024
CHUNK = 4_000_000  # tokens held at once: whole texts, or one text
HEAD = 131_072
HELD = 8_000_000  # bytes of texts that are cut into words at once, or one text
SHARES = 32
#: First and last of SHARES, places, learning rate.
ROUNDS = ((0, 0, 64, 0.02), (1, 3, 128, 0.02), (4, 9, 256, 0.015), (10, 31, 512, 0.008))
PIECE = 4_096  # rows of the output layer at once, for the processor's cache
FAN = 32  # results of training that one task adds up
ALPHA = 0.1
END = b"\n"  # no word holds white space


# -- classes and units -----------------------------------------------------------------------


class Classes:
    """Class of any token: of single tokens, of known words by one look-up, of others by ending."""

    def __init__(self, singles: list[bytes], endings: list[bytes]):
        self.singles = {w: i for i, w in enumerate(singles)}
        self.single = len(singles)
        shared = max(1, CLASSES - self.single - REST)
        self.ending = {e: self.single + i for i, e in enumerate(endings[:shared])}

    def of(self, word: bytes) -> int:
        found = self.singles.get(word)
        if found is None:
            found = self.ending.get(word[-2:])
        return CLASSES - REST + word[-1] % REST if found is None else found


class Units:
    """Units of all classes, numbered class by class; a shared class has its rest last."""

    def __init__(self, classes: Classes, words: list[bytes], counts: list[int], of_class: list[tuple[int, int]]):
        own: list[list[tuple[bytes, int]]] = [[] for _ in range(CLASSES)]
        for w, n in zip(words, counts, strict=True):
            own[classes.of(w)].append((w, n))
        self.of_word: dict[bytes, int] = {}
        self.rest = np.full(CLASSES, -1, np.int64)  # the unit of a class's other words
        self.others: list[tuple[int, int]] = []  # tokens and words of that unit
        starts, size = [0], []
        for k in range(CLASSES):
            tokens, kinds = of_class[k]
            for w, n in own[k]:
                self.of_word[w] = len(size)
                size.append(n)
                tokens, kinds = tokens - n, kinds - 1
            if k >= classes.single:
                self.rest[k] = len(size)
                size.append(tokens)
            elif not own[k]:  # a single word that no text holds
                size.append(0)
            self.others.append((max(tokens, 0), max(kinds, 0)))
            starts.append(len(size))
        self.starts = np.array(starts)
        self.cls = np.repeat(np.arange(CLASSES), np.diff(self.starts)).astype(np.int16)
        self.number = len(size)
        self.shared = [k for k in range(CLASSES) if starts[k + 1] - starts[k] > 1]
        self.bias = np.log(np.array(size, float) + 1)
        total = np.add.reduceat(np.array(size, float) + 1, self.starts[:-1])
        self.class_bias = np.log(total / total.sum())


class Head:
    """The most frequent words, numbered, with what scoring needs of each: its unit, log10 of
    its share of the unit, log10 of the base probability."""

    def __init__(self, words: list[bytes], counts: list[int], classes: Classes, units: Units, base):
        self.known = pa.array(words, pa.binary())
        self.end_place = 0 if words[:1] == [END] else None  # known wherever there is a training text
        # units of other words, none of which is single: by the last two bytes, or the one byte of a word
        self.by_end = units.rest[CLASSES - REST + np.arange(256) % REST].repeat(256).reshape(256, 256).T.copy()
        self.by_byte = self.by_end[0].copy()
        for e, k in classes.ending.items():
            if len(e) == 2:
                self.by_end[e[0], e[1]] = units.rest[k]
            else:
                self.by_byte[e[0]] = units.rest[k]
        n = np.array(counts or [0], float)
        cls = np.array([classes.of(w) for w in words] or [0], np.int64)
        of_word = [units.of_word.get(w, -1) for w in words] or [-1]
        known = np.array(of_word) >= 0
        self.unit = np.where(known, of_word, units.rest[cls]).astype(np.uint16)
        cn, cv = np.array(units.others, float)[cls].T
        self.share = np.where(known, 0.0, np.log10((n + ALPHA) / (cn + ALPHA * (cv + 1))))
        self.base = base(n)
        self.end = units.of_word.get(END, 0)

    def units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each of the words, -1 if it is not of the head, and its unit."""
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        out = self.unit[at]
        others = words.filter(pa.array(at < 0))
        size = pc.binary_length(others).to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join([b"\0", *others.to_pylist()]), np.uint8)
        last = np.cumsum(size)
        out[at < 0] = np.where(size > 1, self.by_end[raw[last - 1], raw[last]], self.by_byte[raw[last]])
        return at, out


# -- the network ---------------------------------------------------------------------------


def start_weights(units: Units, seed: int = 5) -> dict[str, np.ndarray]:
    """x: input vectors, u and n: of the gates, o and b: of classes, w and v: of units."""
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0])).astype(np.float32)
    x = (rng.standard_normal((units.number + 1, 3 * HIDDEN)) * 0.3).astype(np.float32)
    return {"x": x, "u": r(HIDDEN, 3 * HIDDEN), "n": np.zeros(HIDDEN, np.float32), "o": r(HIDDEN, CLASSES), "b": units.class_bias.astype(np.float32), "w": r(HIDDEN, units.number), "v": units.bias.astype(np.float32)}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.asarray(values[at : at + like[k].size], np.float32).reshape(like[k].shape)
        at += like[k].size
    return out


class Abreast:
    """Texts dealt to places, one after another in each, the longest place first. Tokens
    stay in one flat array, so places of unlike length cost nothing."""

    def __init__(self, texts: list[np.ndarray], slots: int, first: int):
        """first: what stands before a text."""
        slots = max(1, min(slots, len(texts)))
        heap = [(0, s) for s in range(slots)]
        held: list[list[int]] = [[] for _ in range(slots)]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            n, s = heapq.heappop(heap)
            held[s].append(i)
            heapq.heappush(heap, (n + len(texts[i]), s))
        held.sort(key=lambda own: -sum(len(texts[i]) for i in own))
        self.order = [i for own in held for i in own]
        self.token = np.concatenate([texts[i] for i in self.order])
        self.starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in self.order])[:-1]]).astype(np.int64)
        self.given = np.empty_like(self.token)
        self.given[1:] = self.token[:-1]
        self.given[self.starts] = self.first = first
        lengths = np.array([sum(len(texts[i]) for i in own) for own in held])
        self.base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.steps, self.slots = int(lengths[0]), slots
        self.active = np.searchsorted(-lengths, -np.arange(self.steps), side="left")  # places with more than t tokens

    def windows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """First step, the one after the last, and for all steps of the window one after another
        where each active place's token is."""
        lo = 0
        while lo < self.steps:
            hi, size = lo, 0
            while hi < self.steps and (hi - lo < WINDOW or (size < FULL and hi - lo < LONGEST)):
                size += int(self.active[hi])
                hi += 1
            yield lo, hi, np.concatenate([self.base[: self.active[t]] + t for t in range(lo, hi)])
            lo = hi

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of values (by flat place) over the tokens of each text."""
        out = np.zeros(len(self.order))
        out[self.order] = np.add.reduceat(values, self.starts)
        return out


def _gates(x: np.ndarray) -> np.ndarray:
    """n x 3 HIDDEN as 3 x n x HIDDEN: what is of one gate lies together."""
    return x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2)


def _forward(w: dict, run: Abreast, lo: int, hi: int, given: np.ndarray, h: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The state after each token of a window, and the last one. kept: gets what going back
    needs of each step."""
    every = np.empty((len(given), HIDDEN), h.dtype)
    inputs, u = np.take(_gates(w["x"]), given, axis=1), np.ascontiguousarray(_gates(w["u"]))
    first = given == run.first
    half, at = h.dtype.type(0.5), 0
    for t in range(lo, hi):
        s = run.active[t]
        now = slice(at, at + s)
        h = h[:s]
        go = None
        if first[now].any():
            go = ~first[now, None]
            h = h * go
        b = h @ u
        zr = b[:2]
        zr += inputs[:2, now]
        zr *= half
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        z, r = zr
        un = b[2]
        un += w["n"]
        n = r * un
        n += inputs[2, now]
        np.tanh(n, out=n)
        if kept is not None:
            kept.append((h, z, r, un, n, go))
        new = every[now]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        h = new
        at += s
    return every, h


def _by_class(units: Units, target: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """For each shared class: the places of its tokens, its units, which of them each is."""
    cls = units.cls[target]
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for k in units.shared:
        rows = order[ends[k] : ends[k + 1]]
        if len(rows):
            lo, hi = int(units.starts[k]), int(units.starts[k + 1])
            yield rows, slice(lo, hi), target[rows].astype(np.int64) - lo


def _normalised(x: np.ndarray) -> np.ndarray:
    """exp(x) in place; the sum of each row."""
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def log_likelihood(w: dict[str, np.ndarray], units: Units, texts: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Natural log-likelihood of the units of each text."""
    if not texts:
        return np.zeros(0)
    run = Abreast(texts, slots, units.number)
    h = np.zeros((run.slots, HIDDEN), w["u"].dtype)
    out = np.zeros(len(run.token))
    for lo, hi, where in run.windows():
        target = run.token[where]
        every, h = _forward(w, run, lo, hi, run.given[where], h)
        found = np.empty(len(where))
        cls = units.cls[target]
        for at in range(0, len(every), PIECE):
            x = every[at : at + PIECE] @ w["o"]
            x += w["b"]
            hit = x[np.arange(len(x)), cls[at : at + PIECE]]
            found[at : at + PIECE] = hit - np.log(_normalised(x))
        for rows, own, place in _by_class(units, target):
            x = every[rows] @ w["w"][:, own]
            x += w["v"][own]
            hit = x[np.arange(len(x)), place]
            found[rows] += hit - np.log(_normalised(x))
        out[where] = found
    return run.sums(out)


class Trainer:
    def __init__(self, weights: dict[str, np.ndarray], units: Units, rate: float):
        self.units = units
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.rate, self.step, self.tokens = rate, 0, 0

    def learn(self, texts: list[np.ndarray], slots: int) -> None:
        if not texts:
            return
        run = Abreast(texts, slots, self.units.number)
        h = np.zeros((run.slots, HIDDEN), self.w["u"].dtype)
        for lo, hi, where in run.windows():
            h = self._window(run, h, lo, hi, where)
        self.tokens += sum(len(t) for t in texts)

    def _window(self, run: Abreast, h: np.ndarray, lo: int, hi: int, where: np.ndarray) -> np.ndarray:
        w, kept = self.w, []
        given, target = run.given[where], run.token[where]
        every, h = _forward(w, run, lo, hi, given, h, kept)
        share, size = every.dtype.type(1 / len(every)), len(every)
        cls = self.units.cls[target]
        g = {"o": np.zeros_like(w["o"]), "b": np.zeros_like(w["b"])}
        back = np.empty_like(every)
        for at in range(0, size, PIECE):
            e = every[at : at + PIECE]
            x = e @ w["o"]
            x += w["b"]
            x *= (share / _normalised(x))[:, None]
            x[np.arange(len(x)), cls[at : at + PIECE]] -= share
            g["o"] += e.T @ x
            g["b"] += np.ones(len(x), x.dtype) @ x
            back[at : at + PIECE] = x @ w["o"].T
        if self.step % EACH == 0:
            g["w"], g["v"] = np.zeros_like(w["w"]), np.zeros_like(w["v"])
            for rows, own, place in _by_class(self.units, target):
                e = every[rows]
                x = e @ w["w"][:, own]
                x += w["v"][own]
                x *= (share / _normalised(x))[:, None]
                x[np.arange(len(x)), place] -= share
                g["w"][:, own] = e.T @ x
                g["v"][own] = np.ones(len(x), x.dtype) @ x
                back[rows] += x @ w["w"][:, own].T
        dx, inside = np.empty((3, size, HIDDEN), every.dtype), np.empty((size, HIDDEN), every.dtype)
        back_u = np.ascontiguousarray(_gates(w["u"]).transpose(0, 2, 1))
        ahead, end = None, size
        for before, z, r, un, n, go in reversed(kept):
            at = slice(end - len(before), end)
            end = at.start
            d = back[at]
            if ahead is not None:
                d[: len(ahead)] += ahead
            dn, dun = dx[2, at], inside[at]
            np.multiply(d * (1 - z), 1 - n * n, out=dn)
            np.multiply(d * (before - n), z * (1 - z), out=dx[0, at])
            np.multiply(dn * un, r * (1 - r), out=dx[1, at])
            np.multiply(dn, r, out=dun)
            ahead = d * z
            ahead += dx[0, at] @ back_u[0]
            ahead += dx[1, at] @ back_u[1]
            ahead += dun @ back_u[2]
            if go is not None:
                ahead *= go
        order = np.argsort(given, kind="stable")
        got = given[order]
        starts = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]]))
        g["x"] = np.zeros_like(w["x"])
        _gates(g["x"])[:, got[starts]] = np.add.reduceat(np.take(dx, order, axis=1), starts, axis=1)
        states = np.concatenate([step[0] for step in kept]).T
        g["u"] = np.concatenate([states @ dx[0], states @ dx[1], states @ inside], axis=1)
        g["n"] = np.ones(size, every.dtype) @ inside
        self._adam(g)
        return h

    def _adam(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = np.float32(min(1.0, 1.0 / (size + 1e-9)))
        fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        rate = np.float32(self.rate * fix)
        for k, x in g.items():
            x = x * scale
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.v[k] += np.float32(0.001) * (x * x - self.v[k])
            self.w[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))


def chunks(batches: Iterator[list[np.ndarray]], most: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """Whole texts, of so many tokens together (or one text)."""
    held, size = [], 0
    for batch in batches:
        for t in batch:
            if held and size + len(t) > most:
                yield held
                held, size = [], 0
            held.append(t)
            size += len(t)
    if held:
        yield held


# -- counts and model over the corpus ---------------------------------------------------------


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of HELD bytes at most, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space, with A-Z lower-cased, of all texts one after another: the
    different words, which of them each is, and which text it is of. Null is the empty text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten().dictionary_encode()
    which = found.indices.to_numpy()
    of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    words = found.dictionary.cast(pa.binary())
    none = pc.index(words, pa.scalar(b"", pa.binary())).as_py()  # before white space that a text begins or ends with
    if none >= 0:
        some = which != none
        which, of = which[some], of[some]
        which = which - (which > none)
        words = pa.concat_arrays([words.slice(0, none), words.slice(none + 1)])
    return words, which, of


def word_counts(texts: DataFrame) -> DataFrame:
    """w, n over all texts (column t), the end of each text among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = 0
        for batch in batches:
            n += batch.num_rows
            for part in pieces(batch.column(0)):
                words, which, _ = cut(part)
                often = np.bincount(which, minlength=len(words))
                some = pa.array(often > 0)
                yield {"w": words.filter(some), "n": pa.array(often, pa.int64()).filter(some)}
        if n:
            yield {"w": [END], "n": [n]}

    return rows_of(texts, [F.col("t")], "w binary, n long", count).groupBy("w").agg(F.sum("n").alias("n"))


class Model:
    """counts of all words, their totals N and V, the classes, the units and the head."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.n, self.v = int(total[0]), int(total[1])
        ends_here = counts.where(F.col("w") == F.lit(END)).first()
        top = counts.where(F.col("w") != F.lit(END)).orderBy(F.desc("n"), "w").limit(HEAD).toArrow()
        words, n = [bytes(w) for w in top.column("w").to_pylist()], top.column("n").to_pylist()
        singles = [END, *words[:SINGLES]]
        if ends_here:
            words, n = [END, *words], [ends_here["n"], *n]
        single = F.col("w").isin(*[bytearray(w) for w in singles])
        ends = counts.where(~single).groupBy(F.substring("w", -2, 2).alias("e")).agg(F.sum("n").alias("n"))
        self.classes = classes = Classes(singles, [bytes(r["e"]) for r in ends.orderBy(F.desc("n"), "e").limit(CLASSES).collect()])
        classed = arrow_map(counts, {"w": F.col("w")}, ["n"], {"k": "int"}, lambda got: {"k": [classes.of(w) for w in as_bytes(got["w"])]})
        size = {r["k"]: (r["n"], r["v"]) for r in classed.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
        self.units = Units(classes, words[: SINGLES + UNITS], n[: SINGLES + UNITS], [size.get(k, (0, 0)) for k in range(CLASSES)])
        self.head = Head(words, n, classes, self.units, self.base)

    def base(self, c):
        return np.log10((c + ALPHA) / (self.n + ALPHA * (self.v + 1)))


def _encoded(batch: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.to_pylist()]


def _sum_of(blobs: DataFrame) -> np.ndarray | None:
    """blobs: s (doubles as bytes), one row for each partition that learned. Their sum, up a
    tree of tasks that add FAN rows each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = None
        for batch in batches:
            for blob in batch.column(0):
                x = np.frombuffer(blob.as_buffer(), float)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield {"s": [total.tobytes()]}

    blobs = materialise(blobs)
    while (n := blobs.count()) > 1:
        blobs = materialise(rows_of(blobs.repartition(-(-n // FAN)), [F.col("s")], "s binary", add))
    row = blobs.first()
    return None if row is None else np.frombuffer(bytes(row["s"]), float)


def train(table: DataFrame, units: Units) -> dict[str, np.ndarray]:
    """table: share, seq (units as bytes) of the texts to learn from. The network's weights."""
    spark = table.sparkSession
    weights = start_weights(units)
    for first, last, slots, rate in ROUNDS:
        sent = spark.sparkContext.broadcast((weights, units))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, slots=slots, rate=rate) -> Iterator[dict]:
            net = Trainer(*sent.value, rate)
            for part in chunks(_encoded(b.column(0)) for b in batches):
                net.learn(part, slots)
            if net.tokens:
                yield {"s": [np.append(flat(net.w).astype(float) * net.tokens, net.tokens).tobytes()]}

        total = _sum_of(rows_of(table.where(F.col("share").between(first, last)), [F.col("seq")], "s binary", learn))
        if total is not None:
            weights = unflat(total[:-1] / total[-1], weights)
    return weights


def numbered(h: Head, texts: pa.Array) -> dict[str, pa.Array]:
    """Of each text: seq (units as bytes, with the end), n_tokens; of its words of the head: known,
    base, log_share; its other words: tail."""
    words, which, of = cut(texts)
    n = len(texts)
    at, unit = h.units(words)
    sizes = np.bincount(of, minlength=n)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    seq = np.full(starts[-1], h.end, np.uint16)
    seq[np.arange(len(which)) + of] = unit[which]
    seqs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * starts).astype(np.int32)), pa.py_buffer(seq)])
    hit = at >= 0
    summed = lambda x: pa.array(np.bincount(of, np.where(hit, x[at], 0.0)[which], n))
    rare = np.flatnonzero(~hit[which])
    pairs, often = np.unique(of[rare] * max(1, len(words)) + which[rare], return_counts=True)
    text, word = np.divmod(pairs, max(1, len(words)))
    tail = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(often, pa.int32())], ["w", "f"])
    ends = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
    known = pa.array(np.bincount(of, hit[which], n).astype(np.int64))
    return {"seq": seqs, "n_tokens": pa.array(sizes + 1), "known": known, "base": summed(h.base), "log_share": summed(h.share), "tail": pa.ListArray.from_arrays(ends, tail)}


def encode(docs: DataFrame, learn: Column, text: str, keep: list[str], model: Model) -> DataFrame:
    """_doc (the kept columns), row, learn, share, seq, n_tokens; of the words of the head: known,
    base, log_share; the other words of the text: tail."""
    head = docs.sparkSession.sparkContext.broadcast(model.head)
    end = model.head.end_place
    end_share, end_base = (float(model.head.share[end]), float(model.head.base[end])) if end is not None else (0.0, float(model.base(0)))

    def work(got: dict) -> dict:
        parts = [numbered(head.value, part) for part in pieces(got["t"])]
        out = {k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]} if parts else {k: [] for k in schema}
        return out | {
            "share": [xxhash.xxh3_64_intdigest(t) % SHARES for t in as_bytes(got["t"])],
            "known": np.asarray(out["known"]) + (end is not None),
            "base": np.asarray(out["base"]) + end_base,
            "log_share": np.asarray(out["log_share"]) + end_share,
        }

    schema = {"share": "int", "seq": "binary", "n_tokens": "long", "known": "long", "base": "double", "log_share": "double", "tail": "array<struct<w:binary,f:int>>"}
    packed = pack(docs, keep, learn=F.coalesce(learn, F.lit(False)), t=docs[text])
    return materialise(arrow_map(packed, {"t": F.col("t")}, ["_doc", "learn"], schema, work).withColumn("row", F.monotonically_increasing_id()))


def score(docs: DataFrame, learn: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every document, with n_tokens, n_known, train_tokens, base_score
    and score; the model learns from the rows where learn holds."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    model = Model(materialise(word_counts(docs.where(learn).select(F.col(text).alias("t")))))
    table = encode(docs, learn, text, keep, model)
    weights = train(table.where("learn"), model.units)
    sent = spark.sparkContext.broadcast((weights, model.units))

    def work(got: dict) -> dict:
        net: list[float] = []
        for part in chunks([_encoded(got["seq"])]):
            longest = max(map(len, part))  # the places only decide how fast it goes
            net += log_likelihood(*sent.value, part, int(np.clip(sum(map(len, part)) // longest, 64, SLOTS))).tolist()
        return {"net": [x / np.log(10) for x in net]}

    own = ["_doc", "row", "n_tokens", "known", "base", "log_share"]
    scored = arrow_map(table, {"seq": F.col("seq")}, own, {"net": "double"}, work, whole=True)
    tail = table.select("row", F.explode("tail").alias("e")).select(F.col("row").alias("at"), F.col("e.w").alias("w"), F.col("e.f").alias("f"))
    found = tail.join(model.counts, "w", "left").select("at", "f", "w", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = spark.createDataFrame([(k, float(n), float(v)) for k, (n, v) in enumerate(model.units.others)], "k int, cn double, cv double")
    # the class of a word by its ending, as in Classes
    by_end = spark.createDataFrame([(bytearray(e), k) for e, k in model.classes.ending.items()] or [(bytearray(b""), 0)], "e binary, ek int")
    last = F.conv(F.hex(F.substring("w", -1, 1)), 16, 10).cast("int")
    classed = found.withColumn("e", F.substring("w", -2, 2)).join(F.broadcast(by_end), "e", "left").withColumn("k", F.coalesce("ek", (F.lit(CLASSES - REST) + last % REST).cast("int"))).join(F.broadcast(sizes), "k")
    per = classed.groupBy("at").agg(
        F.sum(F.when(F.col("n") > 0, F.col("f")).otherwise(0)).alias("k2"),
        F.sum(F.col("f") * F.log10((F.col("n") + ALPHA) / F.lit(model.n + ALPHA * (model.v + 1)))).alias("b2"),
        F.sum(F.col("f") * F.log10((F.col("n") + ALPHA) / (F.col("cn") + ALPHA * (F.col("cv") + 1)))).alias("s2"),
    )
    out = scored.join(per, scored["row"] == per["at"], "left")
    more = lambda c, d: F.col(c) + F.coalesce(F.col(d), F.lit(0))
    return unpack(out, keep, n_tokens=F.col("n_tokens"), n_known=more("known", "k2").cast("long"), train_tokens=F.lit(model.n).cast("long"), base_score=more("base", "b2"), score=F.col("net") + more("log_share", "s2"))
