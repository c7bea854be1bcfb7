"""Near-duplicate documents by SimHash and a binary trie self-join, for a stated similarity.

Two documents link when the Jaccard similarity of their sets of word shingles is at least
SIMILARITY (0.8 over five words, unless told otherwise). Two equal fingerprints of 64 bits
tell little about that, so a document gets TABLES short fingerprints of WORD_BITS bits, one
sketch together. In each table the fingerprints form a binary trie that is joined with
itself: node pairs are walked together, differing bits add up, and a pair of nodes is
dropped beyond ERRORS bits. Large documents of similarity 0.8 differ in 15 % of their bits, so
a table finds 27 % of such pairs and the tables together 99 %, more of closer ones; of short
documents, whose majority bits are biased, they find fewer.

A table is dealt out in cells: two fingerprints within ERRORS bits agree on one of
ERRORS + 1 blocks of bits, and those that agree meet; a cell above CELL_ROWS is cut again
by agreement on a block of its other bits. What a cell finds is compared over the whole
sketch (at most NEAR bits of it may differ, which similarity 0.8 passes but for 1 in 300), and the cell
returns the spanning forest of its links that is made of the most similar ones: as many
rows as documents at most, not all pairs of a group. Each returned link is then verified on
the two whole shingle sets.

That joins large groups cheaply, but a forest may drop a true link for ones that only look
nearer. So an exact join follows: sets of the stated similarity share a shingle among the
first n - ceil(SIMILARITY n) + 1 of each, in any order of all shingles. Points that share one,
are not yet in one component and pass the bounds of size and position are verified too, all
of them but those whose sketches differ in more than FAR bits (of two sets of the similarity and
of LARGE shingles or more less than one pair in 10^12 does so, by the binomial tail; smaller ones
are all verified). Documents
with the same set are one point throughout, so groups of copies cost one row; one document of
each point is read for its shingles. Shingles and sets are known by 64-bit hashes, and sets are
compared by 48 bits of each. Classes are the components of all links of the similarity.

Nulls: a null text, as any text without words, has the empty set, and such texts are one
class. The keeper of a class is its smallest id (null ids last), then its first row, by file
and place in the file; a row's place is the same however a scan is split. Repeated rows are
copies. An empty table gives an empty one. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, bit_filter, discard, join_counted, materialise, pack, place, rows_of, spaced, stable, unpack
from .simhash import components, trie_pairs

TABLES = 16
WORD_BITS = 24
ERRORS = 2
NEAR = 78
FAR = 128
LARGE = 64
CELL_ROWS = 20_000
COMMON = 200_000  # shingles known as common: those of COMMON_ROWS texts of a sample of 1 in COMMON_SHARE
COMMON_ROWS = 3
COMMON_SHARE = 16
_SALT = (np.arange(1, TABLES * WORD_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of size words; of fewer words, the whole text's."""
    ws = spaced(text)
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws))], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(g)) for g in zip(*[ws[i:] for i in range(size)])), np.uint64, len(ws) - size + 1))


def sketch(h: np.ndarray) -> bytes:
    """TABLES * WORD_BITS bits, each the majority of one bit over all shingles."""
    votes = np.zeros(TABLES * WORD_BITS, np.int64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), 16_384):
            x = h[lo : lo + 16_384, None] ^ _SALT
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            votes += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(h)).tobytes()


def _words_of(sketches: np.ndarray) -> np.ndarray:
    """n x TABLES short fingerprints of n x bytes sketches."""
    b = sketches.reshape(len(sketches), TABLES, WORD_BITS // 8).astype(np.int64)
    return sum(b[:, :, i] << (8 * i) for i in range(WORD_BITS // 8))


def _cut(mask: int) -> list[int]:
    free = [b for b in range(WORD_BITS) if not mask >> b & 1]
    runs = [free[len(free) * k // (ERRORS + 1) : len(free) * (k + 1) // (ERRORS + 1)] for k in range(ERRORS + 1)]
    return [mask | sum(1 << b for b in run) for run in runs if run]


def _deal(points: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """points: cell (0, or of the level above), pid, n, sketch. A row for each cell that the
    point is in, for the masks below that of its cell."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            words = _words_of(raw)
            for mask, below in masks.items():
                for t in range(TABLES):
                    rows = np.flatnonzero((cell >> WORD_BITS & ((1 << WORD_BITS) - 1) == mask) & ((cell >> 2 * WORD_BITS == t) | (mask == 0)))
                    for m in below if len(rows) else ():
                        where = (t << 2 * WORD_BITS) | (m << WORD_BITS) | (words[rows, t] & m)
                        take = pa.array(rows)
                        yield {"cell": pa.array(where), "pid": batch.column(1).take(take), "n": batch.column(2).take(take), "sketch": batch.column(3).take(take)}

    return rows_of(points, [F.col(c) for c in ("cell", "pid", "n", "sketch")], "cell long, pid long, n int, sketch binary", deal)


def _forest(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest of the nearest links."""
    root = np.arange(n)
    keep: list[np.ndarray] = []
    order = np.lexsort((j, i, far))
    i, j, place = i[order], j[order], order
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, place, a, b = i[open_], j[open_], place[open_], a[open_], b[open_]
        if not len(i):
            break
        # each component's nearest link (links are in order): Boruvka's step
        first = np.full(n, len(i))
        np.minimum.at(first, a, np.arange(len(i)))
        np.minimum.at(first, b, np.arange(len(i)))
        chosen = np.unique(first[first < len(i)])
        keep.append(place[chosen])
        x, y = a[chosen], b[chosen]
        while True:
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            if np.array_equal(low, high):
                break
            np.minimum.at(root, high, low)
            while not np.array_equal(root, root[root]):
                root = root[root]
    return np.concatenate(keep) if keep else np.zeros(0, np.int64)


def cell_links(cell: np.ndarray, pid: np.ndarray, n: np.ndarray, sketches: np.ndarray, similarity: float, batch: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (places, places, differing bits) of a forest for each of several whole cells."""
    words = _words_of(sketches)[np.arange(len(cell)), cell >> 2 * WORD_BITS]
    order = np.lexsort((words, cell))
    cell, words, pid, n, sketches = cell[order], words[order], pid[order], n[order], sketches[order]
    same = np.concatenate([[True], (cell[1:] != cell[:-1]) | (words[1:] != words[:-1])])
    start = np.flatnonzero(same)
    count = np.diff(np.concatenate([start, [len(cell)]]))
    a, b = trie_pairs(words[start].astype(np.uint64), cell[start], ERRORS)
    a, b = np.concatenate([a, np.flatnonzero(count > 1)]), np.concatenate([b, np.flatnonzero(count > 1)])
    bits = np.ascontiguousarray(sketches).view(np.uint64)
    best: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
    sizes = count[a] * count[b]
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + batch, side="right")))
        # members of both leaves, as flat pairs, never more than a batch or one pair of leaves at once
        for x, y in _members(a[lo:hi], b[lo:hi], start, count, batch):
            p = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])
            x, y = x[p], y[p]
            far = np.bitwise_count(bits[x] ^ bits[y]).sum(1)
            p = far <= NEAR
            got = [np.concatenate([u, v]) for u, v in zip(best, (x[p], y[p], far[p].astype(np.int64)), strict=True)]
            if len(got[0]) > len(cell):
                tree = _forest(len(cell), *got)
                got = [g[tree] for g in got]
            best = tuple(got)
        lo = hi
    tree = _forest(len(cell), *best)
    return pid[best[0][tree]], pid[best[1][tree]], best[2][tree]


def _members(a: np.ndarray, b: np.ndarray, start: np.ndarray, count: np.ndarray, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the members of leaves a and b (of one leaf, each pair once)."""
    sizes = count[a] * count[b]
    if len(a) == 1 and sizes[0] > batch:
        left = np.arange(start[a[0]], start[a[0]] + count[a[0]])
        right = np.arange(start[b[0]], start[b[0]] + count[b[0]])
        step = max(1, batch // len(right))
        for lo in range(0, len(left), step):
            x, y = np.repeat(left[lo : lo + step], len(right)), np.tile(right, len(left[lo : lo + step]))
            ok = (x < y) if a[0] == b[0] else slice(None)
            yield x[ok], y[ok]
        return
    pair = np.repeat(np.arange(len(a)), sizes)
    inside = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = start[a[pair]] + inside // count[b[pair]]
    y = start[b[pair]] + inside % count[b[pair]]
    ok = (a[pair] != b[pair]) | (x < y)
    yield x[ok], y[ok]


def _links(cells: DataFrame, similarity: float) -> DataFrame:
    spread = cells.repartition("cell").sortWithinPartitions("cell")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def join(table: pa.Table) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(table.num_rows, -1)
            a, b, _ = cell_links(table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy(), raw, similarity)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * CELL_ROWS:
                table = pa.Table.from_batches(held)
                cell = table.column(0).to_numpy()
                whole = np.flatnonzero(cell != cell[-1])
                cut = int(whole[-1]) + 1 if len(whole) else 0
                if cut:
                    yield join(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size -= cut
        if size:
            yield join(pa.Table.from_batches(held))

    return spread.select("cell", "pid", "n", "sketch").mapInArrow(work, "a long, b long")


def candidate_links(points: DataFrame, similarity: float) -> DataFrame:
    """points: pid, n, sketch. Distinct links a < b to verify."""
    masks = {0: _cut(0)}
    level = points.select(F.lit(0).cast("long").alias("cell"), "pid", "n", "sketch")
    out = None
    while True:
        level = _deal(level, masks)
        below = [m for ms in masks.values() for m in ms]
        deepest = WORD_BITS - min(m.bit_count() for m in below) <= ERRORS + 1
        hot = None if deepest else materialise(level.groupBy("cell").count().where(F.col("count") > CELL_ROWS).select("cell"))
        some = hot is not None and not hot.isEmpty()
        links = _links(level.join(hot, "cell", "left_anti") if some else level, similarity)
        out = links if out is None else out.unionByName(links)
        if not some:
            return materialise(out.distinct())
        level = materialise(level.join(hot, "cell", "left_semi"))
        masks = {m: _cut(m) for m in below}


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs: a table from stable(). row (file and place), root (the class), keeper (none, id, row:
    whom the class keeps) for every document."""
    rows = docs.select(place().alias("row"), docs[key].alias("key"), docs[text].alias("t"))

    def work(got: dict) -> dict:
        out: dict[str, list] = {"pid": [], "n": [], "sketch": []}
        for t in as_bytes(got["t"]):
            h = shingles(t, size)
            out["pid"].append(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64))
            out["n"].append(len(h))
            out["sketch"].append(sketch(h))
        return out

    marked = materialise(arrow_map(rows, {"t": F.col("t")}, ["row", "key"], {"pid": "long", "n": "int", "sketch": "binary"}, work))
    keeper = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), "row")).alias("keeper")
    points = materialise(marked.groupBy("pid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), keeper, F.count("*").alias("copies")))
    texts = rows.select("row", "t")
    links = candidate_links(points.where("n > 0").select("pid", "n", "sketch"), similarity)
    verified = _verified(texts, points, links, size, similarity)
    of = materialise(_rooted(points, verified))
    pairs = materialise(open_pairs(texts, of.where("n > 0"), size, similarity))
    missed = materialise(_not_far(pairs, points))
    if not missed.isEmpty():
        verified = materialise(verified.unionByName(_verified(texts, points, missed, size, similarity)))
        of = materialise(_rooted(points, verified))
    best = of.groupBy("root").agg(F.min("keeper").alias("keeper"))
    found = materialise(of.select("pid", "copies", "root").join(best, "root"))
    out = materialise(join_counted(marked.select("row", "pid"), found, "pid", "copies", F.col("row")).select("row", "root", "keeper"))
    discard(marked, points, links, pairs, missed)
    return out


def _rooted(points: DataFrame, links: DataFrame) -> DataFrame:
    return points.join(components(links), points.pid == F.col("node"), "left").select("pid", "n", "copies", "keeper", F.coalesce("root", "pid").alias("root"))


def _not_far(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs a, b whose sketches differ in FAR bits at most, or of which one set is small."""
    end = lambda c: points.select(F.col("pid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")

    def work(got: dict) -> dict:
        x, y = (np.frombuffer(b"".join(as_bytes(got[c])), np.uint64).reshape(len(got[c]), -1) for c in ("sa", "sb"))
        small = np.minimum(got["na"].to_numpy(), got["nb"].to_numpy()) < LARGE
        return {"near": pa.array(small | (np.bitwise_count(x ^ y).sum(1) <= FAR))}

    return arrow_map(both, {c: F.col(c) for c in ("sa", "sb", "na", "nb")}, ["a", "b"], {"near": "boolean"}, work).where("near").select("a", "b")


def _common(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts of a sample hold, rarest first; at most
    COMMON. Which ones they are decides the order of shingles, not what is found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            hs = [shingles(t, size) for t in as_bytes(batch.column(0))]
            yield {"h": pa.array(np.concatenate([np.zeros(0, np.uint64), *hs]).view(np.int64))}

    some = rows.where(F.pmod(F.xxhash64("t"), F.lit(COMMON_SHARE)) == 0)
    held = rows_of(some, [F.col("t")], "h long", work).groupBy("h").count().where(F.col("count") >= COMMON_ROWS)
    got = held.orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()
    return got.column("h").to_numpy()[::-1].copy()


def open_pairs(rows: DataFrame, of: DataFrame, size: int, similarity: float) -> DataFrame:
    """of: pid, n, keeper, root. Distinct pairs a < b of different roots, among them all
    pairs of the given similarity: two such sets share a shingle of their prefixes, whatever
    the order of shingles; here it is rare ones first."""
    common = _common(rows, size)
    place = np.argsort(common)
    sent = rows.sparkSession.sparkContext.broadcast((common[place], place))

    def prefix(got: dict) -> dict:
        known, rank = sent.value
        out: list[np.ndarray] = []
        for t in as_bytes(got["t"]):
            h = shingles(t, size).view(np.int64)
            if len(h) and len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                h = h[np.lexsort((h, np.where(known[at] == h, rank[at] + 1, 0)))]
            out.append(h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1])
        return {"hs": out}

    starts = arrow_map(rows, {"t": F.col("t")}, ["row"], {"hs": "array<long>"}, prefix)
    named = starts.join(of.select("pid", "n", "root", F.col("keeper.row").alias("at")), F.col("row") == F.col("at"))
    # most points are their own roots, which a null says in fewer bytes
    flat = named.select("pid", F.when(F.col("root") != F.col("pid"), F.col("root")).alias("root"), "n", F.posexplode("hs").alias("pos", "h"))
    spread = flat.repartition("h").sortWithinPartitions("h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches):
            h, pid, root, n, pos = (part.column(c).to_numpy() for c in ("h", "pid", "root", "n", "pos"))
            for a, b in cross_pairs(h, pid, root, n.astype(np.int64), pos.astype(np.int64), similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return spread.select("h", "pid", F.coalesce("root", "pid").alias("root"), "n", "pos").mapInArrow(work, "a long, b long").distinct()


def cross_pairs(h: np.ndarray, pid: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: float, batch: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points that share h, have different roots, and whose sizes and places of h
    (which may be the first they share) leave room for the similarity."""
    order = np.lexsort((root, h))
    h, pid, root, n, pos = h[order], pid[order], root[order], n[order], pos[order]
    new_list = np.concatenate([[True], h[1:] != h[:-1]])
    new_root = new_list | np.concatenate([[True], root[1:] != root[:-1]])

    def end(new: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(new)
        return np.concatenate([starts[1:], [len(h)]])[np.cumsum(new) - 1]

    # a member meets those of its list that come after its own root's
    first, last = end(new_root), end(new_list)
    some = np.flatnonzero(last > first)
    sizes = (last - first)[some]
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + batch, side="right")))
        count = sizes[lo:hi]
        x = np.repeat(some[lo:hi], count)
        y = np.repeat(first[some[lo:hi]], count) + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        shared = np.minimum(n[x] - pos[x], n[y] - pos[y])
        ok = (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9) & (shared * (1 + similarity) >= similarity * (n[x] + n[y]) - 1e-9)
        a, b = np.minimum(pid[x[ok]], pid[y[ok]]), np.maximum(pid[x[ok]], pid[y[ok]])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        yield a[fresh], b[fresh]
        lo = hi


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where the first column changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 10 * CELL_ROWS:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            whole = np.flatnonzero(key != key[-1])
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            size -= cut
    if size:
        yield pa.Table.from_batches(held)


def _verified(texts: DataFrame, points: DataFrame, links: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links whose whole shingle sets are similar enough. texts: row, t. Of each point one text
    is read, and the sets of both ends of a link meet: one is sent once, one with each link."""
    ends = links.select(F.explode(F.array("a", "b")).alias("pid")).distinct()
    reps = materialise(points.select("pid", F.col("keeper.row").alias("at")).join(ends, "pid"))
    # a bit for each row spares most texts the shuffle
    flag = F.coalesce(bit_filter(reps.select("at"))(F.col("row")), F.lit(False))
    own = texts.where(flag).join(reps.hint("shuffle_hash"), F.col("row") == F.col("at")).select("pid", "t")

    def work(got: dict) -> dict:
        return {"h": [shingles(t, size).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for t in as_bytes(got["t"])]}

    sets = materialise(arrow_map(own, {"t": F.col("t")}, ["pid"], {"h": "binary"}, work))
    pairs = links.join(sets.select(F.col("pid").alias("b"), F.col("h").alias("hb")), "b").join(sets.select(F.col("pid").alias("a"), F.col("h").alias("ha")), "a")

    def compare(got: dict) -> dict:
        out = []
        for x, y in zip(as_bytes(got["ha"]), as_bytes(got["hb"]), strict=True):
            n = (len(x) + len(y)) // 6
            both = n - len(np.unique(_numbers(x + y)))
            out.append(both >= similarity * (n - both) - 1e-9)
        return {"near": out}

    found = materialise(arrow_map(pairs, {"ha": F.col("ha"), "hb": F.col("hb")}, ["a", "b"], {"near": "boolean"}, compare).where("near").select("a", "b"))
    discard(sets, reps)
    return found


def _numbers(raw: bytes) -> np.ndarray:
    """Numbers of six bytes each."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that their classes keep, with their columns."""
    docs = stable(docs)
    found = classes(docs, key, text, size, similarity)
    gone = materialise(found.where(F.col("row") != F.col("keeper.row")).select(F.col("row").alias("gone")))
    discard(found)
    rows = pack(docs, docs.columns, row=place())
    # a row whose bit is not set stays surely, without a shuffle of its text
    flag = F.coalesce(bit_filter(gone)(F.col("row")), F.lit(False))
    left = rows.where(flag).join(gone.hint("shuffle_hash"), F.col("row") == F.col("gone"), "left_anti").unionByName(rows.where(~flag))
    return unpack(left, docs.columns)
