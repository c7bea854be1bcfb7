"""Secret scans: fixed patterns, and character Markov models of random strings against
ordinary identifiers.

Each model is an order-2 Markov chain over characters, shrunk towards order 1 and that towards
the even chain. Ordinary text teaches one: the character transitions of all texts of all
documents outside of what the patterns find, as it stands and in one of the forms in which
words are joined to identifiers (snake, kebab, camel or upper case, dealt out by the text's
hash). What the patterns find, labelled by them, teaches the other, with as many transitions of
strings drawn by a seeded generator over the alphabets that keys are written in. Counts are
tables of fixed size that each task sums up and that are added by aggregation.

A candidate, a run of CANDIDATE_LENGTH or more key characters, is a secret if its
log-likelihood ratio per character passes a threshold. The threshold is learned from labelled
strings that the chains have not seen: all different words of each text of all documents joined
as identifiers, in other forms and other runs of words than those that taught the chains,
against further strings of the generator: it lets MISSED of these go, and more only where that
avoids false alarms, one of which counts for ALARM misses. The least error is always at the
ratio of one of the generator's strings, so each task counts how many identifiers lie between
two such ratios, and the counts are added. Dates, numbers and rules (runs of one character) are
ordinary, too, as running text may lack them.

Spans found by the patterns stay; a candidate that overlaps one is not added again (kind
markov). Positions are in code points, ends exclusive; spans that start together are in the order
of KINDS. Nulls: a null text is empty. Repeated rows each get a row and teach as often. An empty
table gives an empty one, and the chains then know the generator's strings alone. Columns may
have any names; kept ones called base or all are replaced. Texts are scanned whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, arrow_map, as_texts, rows_of

CANDIDATE_LENGTH = 16
MISSED = 0.01
ALARM = 20
FORMS = 0.01  # weight of dates, numbers and rules beside running text
DRAWN = 400  # strings of the generator for each alphabet
KINDS = ("assign", "access", "hex", "markov")

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}")
_HINT = re.compile(rb"[:=][\x20]*[\"']?[A-Za-z0-9+/_.=-]{12}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of what the patterns find, by start and then kind."""
    found = []
    if _HINT.search(text.encode()):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


class Markov:
    """Log-likelihood ratio of the two chains, as one table over character pairs and next."""

    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
    size = len(alphabet) + 1
    place = np.zeros(256, np.int64)
    place[[ord(c) for c in alphabet]] = np.arange(1, size)

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, threshold: float = 0.0):
        """Counts of transitions."""
        self.table = (self.chain(random) - self.chain(ordinary)).ravel()
        self.threshold = threshold

    @classmethod
    def codes(cls, raw: bytes) -> np.ndarray:
        """A number for each key character with the two before it; what is none begins anew."""
        c = np.concatenate([[0, 0], cls.place[np.frombuffer(raw, np.uint8)]])
        far = np.where(c[1:-1] == 0, 0, c[:-2])
        return ((far * cls.size + c[1:-1]) * cls.size + c[2:])[c[2:] > 0]

    @classmethod
    def count(cls, texts: list[bytes]) -> np.ndarray:
        return np.bincount(cls.codes(b"\n".join(texts)), minlength=cls.size**3)

    @classmethod
    def chain(cls, n: np.ndarray) -> np.ndarray:
        """Order 2, its rows shrunk towards order 1 and that towards the even chain."""
        n = n.astype(float).reshape(cls.size, cls.size, cls.size)
        one = n.sum(0)
        one = (one + 4 / cls.size) / (one.sum(-1, keepdims=True) + 4)
        two = (n + 8 * one[None]) / (n.sum(-1, keepdims=True) + 8)
        return np.log(two)

    def ratio(self, text: str) -> float:
        return float(self.table[self.codes(text.encode())].sum() / max(1, len(text)))

    def ratios(self, texts: list[bytes]) -> np.ndarray:
        """ratio of each of some texts of key characters."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        sums = np.concatenate([[0.0], np.cumsum(self.table[self.codes(b"\n".join(texts))])])
        ends = np.cumsum(sizes)
        return (sums[ends] - sums[ends - sizes]) / np.maximum(1, sizes)


def random_strings(seed: int, each: int = DRAWN) -> list[bytes]:
    """Of 16 to 63 characters, over the alphabets of keys."""
    rng = np.random.default_rng(seed)
    sets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", Markov.alphabet[:62], Markov.alphabet[:64], Markov.alphabet[:62] + "-_"]
    return ["".join(np.array(list(s))[rng.integers(0, len(s), rng.integers(16, 64))]).encode() for s in sets for _ in range(each)]


_WORD = re.compile(rb"[A-Za-z]+")
STYLES = ("_", "-", "/", "camel", "UPPER")


def joined(words: list[bytes], style: str) -> bytes:
    """Words as one identifier."""
    if style == "camel":
        return words[0].lower() + b"".join(w.title() for w in words[1:])
    return b"_".join(w.upper() for w in words) if style == "UPPER" else style.encode().join(w.lower() for w in words)


def ordinary_forms(seed: int = 9) -> list[bytes]:
    """Dates, numbers and runs of one character."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    out = [c * 40 for c in Markov.alphabet for _ in range(3)]
    for _ in range(400):
        cut = ("-", "/", "")[rng.integers(0, 3)]
        day = cut.join((f"{rng.integers(1990, 2040)}", f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}"))
        out += [day, f"{day}-{day}", f"{day}_{digits(6)}", digits(rng.integers(4, 24))]
    return [x.encode() for x in out]


def _samples(text: str) -> tuple[bytes, list[bytes]]:
    """The text without what the patterns find, and that."""
    found, left, at = [], [], 0
    for a, b, kind in base_spans(text):
        found.append((ASSIGN.match(text, a).group(1) if kind == "assign" else text[a:b]).encode())
        left.append(text[at : max(at, a)])
        at = max(at, b)
    left.append(text[at:])
    return "\n".join(left).encode(), found


def _identifiers(words: list[bytes], style: str) -> list[bytes]:
    """All words of a text, three to an identifier."""
    return [joined(words[i : i + 3], style) for i in range(0, len(words), 3)]


def transitions(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of transitions in what the patterns find and in all else, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = np.zeros((2, Markov.size**3), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                rows = [_samples(t) for t in as_texts(batch.column(0).slice(lo, BATCH))]
                plain = [x for x, _ in rows]
                names = [b"\n".join(_identifiers(_WORD.findall(x), STYLES[zlib.crc32(x) % len(STYLES)])) for x in plain]
                n[0] += Markov.count([v for _, found in rows for v in found])
                n[1] += Markov.count(plain) + Markov.count(names)
        some = np.flatnonzero(n.any(0))
        yield {"i": some, "found": n[0, some], "plain": n[1, some]}

    sums = rows_of(docs, [F.col(text)], "i int, found long, plain long", count).groupBy("i").agg(F.sum("found").alias("found"), F.sum("plain").alias("plain")).toArrow()
    out = np.zeros((2, Markov.size**3))
    out[:, sums.column("i").to_numpy()] = sums.column("found").to_numpy(), sums.column("plain").to_numpy()  # tables of fixed size
    return out[0], out[1]


def labelled_identifiers(text: str) -> list[bytes]:
    """All different words of a text, outside of what the patterns find: in runs of 2 to 6, some
    with a number, in the forms by turns but for the one that the text taught the chains in;
    those of candidates' length."""
    plain, _ = _samples(text)
    words = sorted({w for w in _WORD.findall(plain) if len(w) > 2}, key=lambda w: (zlib.crc32(w), w))
    taught, out, lo, i = zlib.crc32(plain), [], 0, 0
    while lo < len(words):
        # a last word left alone would be in no identifier
        hi = lo + 2 + (taught + i) % 4
        hi = len(words) if len(words) - hi < 2 else hi
        name = joined(words[lo:hi], STYLES[(taught + 1 + i % (len(STYLES) - 1)) % len(STYLES)]) + (b"%d" % (taught % 2_100) if i % 3 == 0 else b"")
        if len(name) >= CANDIDATE_LENGTH:
            out.append(name)
        lo, i = hi, i + 1
    return out


def ordinary_above(docs: DataFrame, model: Markov, tried: np.ndarray, text: str = "text") -> np.ndarray:
    """How many identifiers of all documents have at least each of the ratios tried, which
    ascend, and how many there are."""
    sent = docs.sparkSession.sparkContext.broadcast((model, tried))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model, tried = sent.value
        n = np.zeros(len(tried) + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                names = [x for t in as_texts(batch.column(0).slice(lo, BATCH)) for x in labelled_identifiers(t)]
                n += np.bincount(np.searchsorted(tried, model.ratios(names), side="right"), minlength=len(n))
        some = np.flatnonzero(n)
        yield {"i": some, "n": n[some]}

    sums = rows_of(docs, [F.col(text)], "i int, n long", count).groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # a row for each ratio at most
    out = np.zeros(len(tried) + 1)
    out[sums.column("i").to_numpy()] = sums.column("n").to_numpy()
    return np.append(out[::-1].cumsum()[::-1][1:], out.sum())


def train(docs: DataFrame, text: str = "text") -> Markov:
    found, plain = transitions(docs, text)
    drawn = Markov.count(random_strings(7))
    forms = Markov.count(ordinary_forms())
    plain = plain + forms * max(1.0, FORMS * plain.sum() / forms.sum())
    model = Markov(found + drawn * max(1.0, found.sum() / drawn.sum()), plain)
    secret = np.array([model.ratio(x.decode()) for x in random_strings(8)])
    tried = np.unique(secret)
    tried = tried[tried >= np.quantile(secret, MISSED)]
    *above, every = ordinary_above(docs, model, tried, text)
    errors = np.searchsorted(np.sort(secret), tried) / len(secret) + ALARM * np.array(above) / max(1, every)
    model.threshold = float(tried[np.argmin(errors)])
    return model


def added_spans(text: str, base: list[tuple[int, int, str]], model: Markov) -> list[tuple[int, int, str]]:
    out = []
    for m in CANDIDATE.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b, _ in base) and model.ratio(m.group()) >= model.threshold:
            out.append((m.start(), m.end(), "markov"))
    return out


def scan(docs: DataFrame, model: Markov, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every document, with base and all: arrays of kind, start, end."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(got: dict) -> dict:
        out: dict[str, list] = {"base": [], "all": []}
        for t in as_texts(got["t"]):
            base = base_spans(t)
            every = sorted(base + added_spans(t, base, sent.value), key=lambda s: (s[0], KINDS.index(s[2])))
            out["base"].append([{"kind": k, "start": a, "end": b} for a, b, k in base])
            out["all"].append([{"kind": k, "start": a, "end": b} for a, b, k in every])
        return out

    spans = "array<struct<kind:string,start:long,end:long>>"
    return arrow_map(docs, {"t": docs[text]}, docs.columns if keep is None else keep, {"base": spans, "all": spans}, work)
