"""The gated recurrent model against a plain one, differences, and sums of probabilities."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from millrace.llm import language_model as lm
from millrace.llm import queries
from pyspark.sql import functions as F

from . import brute

DOCS = "doc_id long, text string, row string, seq long, score string, _doc string"


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def some_units(seed: int = 1) -> lm.Units:
    rng = np.random.default_rng(seed)
    words = [b"w%dx%d" % (i, rng.integers(40)) for i in range(300)]
    counts = sorted(rng.integers(1, 500, 300).tolist(), reverse=True)
    classes = lm.Classes([lm.END, *words[: lm.SINGLES]], [b"x%d" % i for i in range(9)])
    of = Counter()
    kinds = Counter()
    for w, n in zip(words, counts, strict=True):
        of[classes.of(w)] += n
        kinds[classes.of(w)] += 1
    return lm.Units(classes, [lm.END, *words[:200]], [50, *counts[:200]], [(of[k] + 50 * (k == 0), kinds[k] + (k == 0)) for k in range(lm.CLASSES)])


def sequences(units: lm.Units, sizes, seed: int = 1) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.integers(0, units.number, n).astype(np.uint16) for n in sizes]


def plain(w: dict, units: lm.Units, text) -> tuple[float, list[float]]:
    """One token after another: the text's log-likelihood, and the sum over all units each time."""
    H = lm.HIDDEN
    sigma = lambda x: 1 / (1 + np.exp(-x))
    h, given, total, sums = np.zeros(H), units.number, 0.0, []
    for token in text.tolist():
        a, b = w["x"][given], h @ w["u"]
        z, r = sigma(a[:H] + b[:H]), sigma(a[H : 2 * H] + b[H : 2 * H])
        n = np.tanh(a[2 * H :] + r * (b[2 * H :] + w["n"]))
        h = (1 - z) * n + z * h
        p = np.exp(h @ w["o"] + w["b"])
        p /= p.sum()
        every = np.empty(units.number)
        for k in range(lm.CLASSES):
            own = slice(units.starts[k], units.starts[k + 1])
            q = np.exp(h @ w["w"][:, own] + w["v"][own])
            every[own] = p[k] * q / q.sum()
        sums.append(every.sum())
        total += math.log(every[token])
        given = token
    return total, sums


def test_against_a_plain_model():
    units = some_units()
    seqs = sequences(units, (40, 1, 17, 16, 90))
    w = {k: x.astype(float) for k, x in lm.start_weights(units).items()}
    got = lm.log_likelihood(w, units, seqs, 2)
    for s, x in zip(seqs, got, strict=True):
        want, sums = plain(w, units, s)
        assert math.isclose(x, want, rel_tol=1e-9) and np.allclose(sums, 1)


def test_shares_of_other_words_sum_to_one():
    units = some_units()
    for k in units.shared:
        tokens, kinds = units.others[k]
        # as if each word had an equal count, and one unknown word
        n = tokens / kinds if kinds else 0
        whole = sum((n + lm.ALPHA) / (tokens + lm.ALPHA * (kinds + 1)) for _ in range(kinds)) + lm.ALPHA / (tokens + lm.ALPHA * (kinds + 1))
        assert math.isclose(whole, 1)


def test_gradients():
    """Backpropagation against differences, within a window."""
    units = some_units()
    seqs = sequences(units, (9, 4, 3, 7))
    w = {k: x.astype(float) for k, x in lm.start_weights(units).items()}

    class Seen(lm.Trainer):
        def _adam(self, g):
            self.g = g

    net = Seen(w, units, 0.1)
    net.learn(seqs, 2)
    total = sum(map(len, seqs))
    assert len(list(lm.Abreast(seqs, 2, units.number).windows())) == 1
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(net.g[k])), w[k].shape)
        step = 1e-4
        up, down = ({n: x.copy() for n, x in w.items()} for _ in range(2))
        up[k][at] += step
        down[k][at] -= step
        slope = -(lm.log_likelihood(up, units, seqs, 2).sum() - lm.log_likelihood(down, units, seqs, 2).sum()) / (2 * step * total)
        assert math.isclose(slope, net.g[k][at], rel_tol=1e-5), k


def test_state_is_carried_and_places_dont_matter(monkeypatch):
    monkeypatch.setattr(lm, "LONGEST", 16)
    units = some_units()
    seqs = sequences(units, (100, 1, 37, 250, 16, 17), 2)
    w = lm.start_weights(units)
    alone = [lm.log_likelihood(w, units, [s])[0] for s in seqs]
    for slots in (1, 2, 6):
        assert np.allclose(lm.log_likelihood(w, units, seqs, slots), alone, rtol=1e-4)
    cut = sum(lm.log_likelihood(w, units, [seqs[3][i : i + lm.WINDOW]])[0] for i in range(0, 250, lm.WINDOW))
    assert not math.isclose(cut, alone[3], rel_tol=1e-4)


def test_training_learns_words_within_classes(monkeypatch):
    """In one class, which word follows depends on the word before."""
    monkeypatch.setattr(lm, "EACH", 1)
    monkeypatch.setattr(lm, "FULL", 1)
    units = some_units()
    k = max(units.shared, key=lambda k: units.starts[k + 1] - units.starts[k])
    lo = int(units.starts[k])
    rng = np.random.default_rng(4)
    seqs = []
    for _ in range(200):
        firsts = rng.integers(0, 3, 30)
        seqs.append(np.stack([firsts, 10 + firsts * 0 + lo + firsts], 1).ravel().astype(np.uint16) if lo > 3 else np.stack([lo + firsts, lo + firsts], 1).ravel().astype(np.uint16))
    net = lm.Trainer(lm.start_weights(units), units, 0.02)
    for _ in range(8):
        net.learn(seqs, 16)
    before = lm.log_likelihood(lm.start_weights(units), units, seqs).sum() / 12_000
    after = lm.log_likelihood(net.w, units, seqs).sum() / 12_000
    assert after > before + 1 and after > -0.75  # log(3) for each pair at best: -0.55 a token


def test_query(spark, small, texts):
    rows = queries.op2_language_model(spark, small).collect()
    train = Counter()
    for i, t in texts.items():
        if crc32(str(i).encode()) % 10:
            train.update([*brute.spaced(t), "\n"])
    n, v = sum(train.values()), len(train)
    sums = Counter()
    for r in rows:
        ws = [*brute.spaced(texts[r["doc_id"]]), "\n"]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(base, r["base_score"], rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(train[w] > 0 for w in ws), n, crc32(str(r["doc_id"]).encode()) % 10 == 0)
        if r["held_out"]:
            sums.update(model=r["score"], base=r["base_score"])
    assert len(rows) == len(texts) and sums["model"] > sums["base"]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (None, "no id here"), (3, "  \n\t\n "), (4, long), (5, "a b a b"), (5, "a b a b"), (6, "Ünïcode \U0001f600 \u00a0x")]
    odd = spark.createDataFrame([(*r, "kept", 7, "replaced", "kept") for r in rows], DOCS).repartition(3)
    got = lm.score(odd, F.col("doc_id") != 4)
    assert got.columns == [*(c for c in odd.columns if c != "score"), "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = got.collect()
    assert len(out) == len(rows) and {(r["row"], r["seq"], r["_doc"]) for r in out} == {("kept", 7, "kept")}
    assert all(r["score"] is not None and r["score"] < 0 for r in out) and len({r["score"] for r in out if r["doc_id"] == 5}) == 1
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0
    assert lm.score(odd, F.lit(False)).where("n_known > 0 or train_tokens > 0").count() == 0


def test_every_window_teaches_words_within_classes():
    units = some_units()
    seen = []

    class Seen(lm.Trainer):
        def _adam(self, g):
            seen.append(set(g))
            super()._adam(g)

    net = Seen(lm.start_weights(units), units, 0.01)
    net.learn(sequences(units, (700, 300), 3), 2)
    assert len(seen) > 4 and all(g == set(net.w) for g in seen)


def test_texts_are_cut_alike_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["  Ab aB\u00a0c\tÜ x\x0b\x0cx ", None, "", "\r\n", "one", "a b a", "\x1c\x85 q\x00q"] * 3
    monkeypatch.setattr(lm, "HELD", 12)
    words = []
    for part in lm.pieces(pa.array(texts)):
        ws, which, of = lm.cut(part)
        words += [[ws[int(k)].as_py() for k in which[of == i]] for i in range(len(part))]
    assert words == [[w.encode() for w in brute.spaced(t or "")] for t in texts]


def test_units_of_words():
    """Of the head and by ending, as Classes has them."""
    import pyarrow as pa

    classes = lm.Classes([lm.END, b"the"], [b"ng", b"a", b"\xc3\xa9"])
    units = lm.Units(classes, [lm.END, b"the", b"long"], [5, 4, 3], [(9, 3)] * lm.CLASSES)
    head = lm.Head([lm.END, b"the", b"long", b"ring"], [5, 4, 3, 1], classes, units, lambda n: n)
    ws = [b"the", b"long", b"ring", b"sing", b"a", b"b", b"ba", "é".encode(), "né".encode(), b"qq", b"ng"]
    at, unit = head.units(pa.array(ws, pa.binary()))
    assert at.tolist() == [1, 2, 3, *[-1] * 8]
    assert unit.tolist() == [units.of_word.get(w, units.rest[classes.of(w)]) for w in ws]
    assert [x.tolist() for x in head.units(pa.array([], pa.binary()))] == [[], []]
