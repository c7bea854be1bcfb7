"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows of n consecutive words (an item of fewer
words, but not none, is one window). A window is the set of its shingles. Containment
of the whole window is asked for (threshold 1), so the prefix of a window, its shingles
in order of rarity, needs only its first, rarest one: a document that lacks it lacks the
window. Documents are joined with those prefix shingles alone; a hit at position p of a
shingle that stands at o in its window fixes the window's place, p - o, which must lie
inside the document (positional and length bounds) and is then compared word by word.

Rarity is counted over all documents in a first pass. The benchmark is cut into blocks of
at most BLOCK_WORDS words (or one item); each block is one pass over the documents, so what is
held and broadcast has a fixed bound however large the benchmark is: its words and windows
are numbers in flat arrays, some 150 bytes a word at the peak, and a table of its distinct
words.

Nulls: a null text has no words and is not contaminated; benchmark rows with a null id or
text take no part. Repeated document rows each get a row; repeated items count once, and
windows that several items share are compared once. Of shingles equally rare the earliest is
the prefix. An empty table or benchmark gives rows without spans. Columns of the documents may
have any names; kept ones called n_words, spans or items are replaced. A task holds the words
of one text at a time, as numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, materialise, pack, rows_of, unpack, words

SHINGLE = 5
BLOCK_WORDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Windows of some items, with their words numbered from 1 (0: any other word): flat
    arrays of the windows' words, sizes and owners."""

    def __init__(self, vocab: dict[bytes, int], items: list[tuple[str, np.ndarray]], n: int, shingle: int):
        self.vocab, self.shingle, self.names = vocab, shingle, [k for k, _ in items]
        rows, owner, sizes = [], [], []
        for i, (_, ids) in enumerate(items):
            size = min(n, len(ids))
            windows = np.zeros((len(ids) - size + 1, n), np.int32)
            windows[:, :size] = np.lib.stride_tricks.sliding_window_view(ids, size)
            rows.append(windows)
            owner.append(np.full(len(windows), i, np.int32))
            sizes.append(np.full(len(windows), size, np.int32))
        every, own = np.concatenate(rows), np.concatenate(owner)
        del rows, owner
        self.windows, first, of = np.unique(every, axis=0, return_index=True, return_inverse=True)
        self.lengths = np.concatenate(sizes)[first]
        del every
        pairs = np.unique(np.stack([of.ravel().astype(np.int32), own], axis=1), axis=0)
        self.owners, self.owner_from = pairs[:, 1].copy(), np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.sizes = sorted(set(np.minimum(shingle, np.unique(self.lengths)).tolist()))
        # the same place in different windows may hold one shingle: it is counted once
        self.hashes = {s: np.unique(np.concatenate([h.ravel() for _, h in self._shingles(s)])) for s in self.sizes}

    def _shingles(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For windows of each length whose shingles are of that size: the windows, and the
        hashes of the shingles at each place in them."""
        for length in np.unique(self.lengths).tolist():
            if min(self.shingle, length) == size:
                rows = np.flatnonzero(self.lengths == length)
                yield rows, np.stack([hashed_rows(self.windows[rows, o : o + size]) for o in range(length - size + 1)], axis=1)

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keep of each window its rarest shingle (ties: the earliest): the prefix. By size, its
        hashes, sorted, with the windows and places in them that each is of."""
        self.prefix = {}
        for s in self.sizes:
            found = []
            for rows, h in self._shingles(s):
                o = counts[s][np.searchsorted(self.hashes[s], h)].argmin(axis=1)
                found.append((h[np.arange(len(rows)), o], rows, o))
            h, rows, o = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.argsort(h, kind="stable")
            keys, at = np.unique(h[order], return_index=True)
            self.prefix[s] = (keys, np.append(at, len(order)), rows[order].astype(np.int32), o[order].astype(np.int32))
        self.hashes = {}  # counted; not to be sent again

    def items_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.owner_from[window] : self.owner_from[window + 1]].tolist()]


def hashed_rows(ids: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of words; equal rows get equal numbers."""
    out = np.zeros(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ids.shape[1]):
            out = (out ^ ids[:, j].astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
    return out


def known_runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Where runs of size words begin that all are words of the benchmark."""
    if len(ids) < size:
        return np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(bad[size:] == bad[:-size])


def run_hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = (out ^ ids[at + j].astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
    return out


def numbered(text: bytes, vocab: dict[bytes, int]) -> np.ndarray:
    get = vocab.get
    ws = words(text)
    return np.fromiter((get(w, 0) for w in ws), np.int32, len(ws))


def _rarity(docs: DataFrame, block, text: str) -> DataFrame:
    """Occurrences of each benchmark shingle in all documents: size, place, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        b = block.value
        total = {s: np.zeros(len(b.hashes[s]), np.int64) for s in b.sizes}
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                ids = numbered(t, b.vocab)
                for s in b.sizes:
                    at = known_runs(ids, s)
                    if len(at):
                        h = run_hashes(ids, at, s)
                        place = np.searchsorted(b.hashes[s], h)
                        place[place == len(b.hashes[s])] = 0
                        np.add.at(total[s], place[b.hashes[s][place] == h], 1)
        for s in b.sizes:
            some = np.flatnonzero(total[s])
            yield {"size": np.full(len(some), s, np.int32), "place": some, "n": total[s][some]}

    return rows_of(docs, [F.col(text)], "size int, place long, n long", count).groupBy("size", "place").agg(F.sum("n").alias("n"))


def _hits(ids: np.ndarray, b: Block) -> tuple[list[int], set[str]]:
    """Start and end of each occurrence of a window, and the items it is of."""
    spans: list[int] = []
    items: set[str] = set()
    for s in b.sizes:
        keys, starts, rows, offsets = b.prefix[s]
        at = known_runs(ids, s)
        if not len(at):
            continue
        h = run_hashes(ids, at, s)
        place = np.searchsorted(keys, h)
        place[place == len(keys)] = 0
        for i in np.flatnonzero(keys[place] == h):
            p = int(at[i])
            for k in range(starts[place[i]], starts[place[i] + 1]):
                size = int(b.lengths[rows[k]])
                lo = p - int(offsets[k])
                if lo >= 0 and lo + size <= len(ids) and np.array_equal(ids[lo : lo + size], b.windows[rows[k], :size]):
                    spans += (lo, lo + size)
                    items.update(b.items_of(int(rows[k])))
    return spans, items


def _blocks(benchmark: DataFrame, key: str, text: str, n: int) -> Iterator[Block]:
    held: list[tuple[str, np.ndarray]] = []
    vocab: dict[bytes, int] = {}
    size = 0
    rows = benchmark.select(F.col(key).cast("string"), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    for k, t in rows.toLocalIterator():
        ws = words(t.encode())
        if held and size + len(ws) > BLOCK_WORDS:
            yield Block(vocab, held, n, SHINGLE)
            held, vocab, size = [], {}, 0
        if ws:
            held.append((k, np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int32)))
            size += len(ws)
    if held:
        yield Block(vocab, held, n, SHINGLE)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every document (default: all), with n_words, spans (starts and
    ends, in words, of the windows that occur) and items (ids as text, sorted)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    none = {"spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")}
    out = pack(docs, keep, t=docs[text], **none)
    schema = {"spans": "array<int>", "items": "array<string>", "n_words": "long"}
    blocks = _blocks(benchmark, item, item_text, n)
    block, passed = next(blocks, None), False
    while block is not None:
        if passed:
            out = materialise(out)
        more_to_come = next(blocks, None)
        counts = {s: np.zeros(len(block.hashes[s]), np.int64) for s in block.sizes}
        sent = spark.sparkContext.broadcast(block)
        for r in _rarity(docs, sent, text).toLocalIterator():
            counts[r["size"]][r["place"]] = r["n"]
        block.choose(counts)
        held = spark.sparkContext.broadcast(block)

        def scan(got: dict, held=held) -> dict:
            b = held.value
            made: dict[str, list] = {k: [] for k in schema}
            for t, spans, items in zip(as_bytes(got["t"]), got["spans"].to_pylist(), got["items"].to_pylist(), strict=True):
                ids = numbered(t, b.vocab)
                more, owners = _hits(ids, b)
                made["spans"].append(spans + more)
                made["items"].append(sorted(owners.union(items)))
                made["n_words"].append(len(ids))
            return made

        out = arrow_map(out, {c: F.col(c) for c in ("t", "spans", "items")}, ["_doc", "t"] if more_to_come else ["_doc"], schema, scan)
        block, passed = more_to_come, True
    if not passed:
        out = arrow_map(out, {"t": F.col("t")}, ["_doc", "spans", "items"], {"n_words": "long"}, lambda got: {"n_words": [len(words(t)) for t in as_bytes(got["t"])]})
    return unpack(out, keep, n_words=F.col("n_words"), spans=F.col("spans"), items=F.col("items"))


def hit_words(spans) -> F.Column:
    """How many words lie in any of the spans (a flat array of starts and ends)."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), lambda i: F.struct(F.get(spans, i * 2).alias("a"), F.get(spans, i * 2 + 1).alias("b"))))
    start = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(pairs, start, lambda s, p: F.struct(F.greatest(s["end"], p["b"]).alias("end"), (s["n"] + F.greatest(p["b"] - F.greatest(s["end"], p["a"]), F.lit(0))).cast("long").alias("n")))["n"]
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(total)
