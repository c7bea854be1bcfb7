"""Line de-duplication by distinct-site spread. DataFrame functions only.

A line is known by two 64-bit hashes of its text without outer blanks (one of them groups, both
have to agree); lines without text are never touched. For each line a HyperLogLog sketch of the
sites it is on is built where the rows are and merged by aggregation, so a line that a third of
all rows hold sends one small sketch from each task. A line whose estimate is surely below
min_sites stays, one surely above it is boilerplate, and lines within MARGIN of the threshold
get an exact distinct count from (line, site) pairs, which are made unique before they are
shuffled.

Boilerplate is removed from all documents but one: the first (by id, then text hash) that
holds it, so that no text is lost altogether. Documents keep their rows, their other lines and
their order; a document may be left without text. Documents are joined to their lines by file
and row in the file, which are the same however a scan is split; the documents of a very
common line are dealt out to several tasks.

Nulls: a null text stays null and has no lines; a null site is a site of its own. A null id
comes after all others. Repeated rows each get a row; the copies of the first holder (same
id, same text: the tie is not broken) all keep the line. An empty table gives an empty one. Columns
of the documents may have any names; one that has the name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, join_counted, materialise, place, stable, unpack

MIN_SITES = 5
LG_K = 12
MARGIN = 0.1  # six standard errors of a sketch of 2^12 buckets




def line_hash(line: Column) -> Column:
    """Null for a line without text."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def second_hash(line: Column) -> Column:
    return F.xxhash64(F.concat(F.lit("\u0001"), F.trim(line)))


def _lines(docs: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """h, g (the hashes of a line), site, id, t (hash of the whole text) for each line with text."""
    both = F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(line_hash(x).alias("h"), second_hash(x).alias("g")))
    rows = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"), F.col(key).alias("id"), F.xxhash64(text).alias("t"), F.inline(both))
    return rows.where(F.col("h").isNotNull())


def boilerplate(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """h, g, n, keeper (id, t): lines on at least min_sites sites, their number and who keeps them."""
    lines = _lines(docs, key, site, text)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("t")))
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n"), first.alias("keeper"))
    spread = spread.select("h", "g", "n", "keeper", F.when(F.col("n") >= min_sites, F.hll_sketch_estimate("sketch")).otherwise(0).alias("sites")).where(F.col("sites") >= int(min_sites * (1 - MARGIN)))
    spread = materialise(spread)
    sure = F.col("sites") > min_sites * (1 + MARGIN) + 1
    near = spread.where(~sure).select("h", "g")
    exact = lines.select("h", "g", "site").distinct().join(near, ["h", "g"]).groupBy("h", "g").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites).select("h", "g")
    return spread.where(sure).select("h", "g", "n", "keeper").unionByName(spread.where(~sure).join(exact, ["h", "g"]).select("h", "g", "n", "keeper"))


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """Every document with its columns, its text without boilerplate, and _lines, _removed."""
    docs = stable(docs)
    flagged = materialise(boilerplate(docs, key, site, text, min_sites))
    doc = lambda c: F.col("_doc")[c]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), place().alias("row"))
    # most documents hold no flagged line: a bit for each hash tells, and spares them the join
    flag = bit_filter(flagged.select("h"))
    hashes = F.array_distinct(F.transform(F.split(doc(text), "\n"), line_hash))
    suspect = F.filter(hashes, lambda h: h.isNotNull() & F.coalesce(flag(h), F.lit(False)))
    held = rows.select(F.col("row").alias("at"), doc(key).alias("id"), F.xxhash64(doc(text)).alias("t"), F.explode(suspect).alias("h"))
    gone = join_counted(held, flagged, "h", "n", F.col("at")).where(~(F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("t") == F.col("keeper.t"))))
    gone = materialise(gone.groupBy("at").agg(F.collect_list(F.struct("h", "g")).alias("gone")))  # at most the lines of one document
    some = F.coalesce(F.size(suspect) > 0, F.lit(False))
    found = rows.where(some).join(gone.hint("shuffle_hash"), F.col("row") == F.col("at"), "left").select("_doc", "gone")
    out = found.unionByName(rows.where(~some).select("_doc", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")))
    lines = F.split(doc(text), "\n")
    kept = F.filter(lines, lambda x: ~F.exists("gone", lambda b: F.coalesce((b["h"] == line_hash(x)) & (b["g"] == second_hash(x)), F.lit(False))))
    new = F.when(F.col("gone").isNull(), doc(text)).otherwise(F.array_join(kept, "\n"))
    made = {"_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")}
    order = [c for c in docs.columns if c not in made]
    return unpack(out, order, **made, **{text: new}).select(*[F.col(f"`{c}`") for c in (*order, *made)])
