"""What the operators of this subpackage share: rows' places, joins, words, scans."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import materialise


def _scans_a_file(df: DataFrame) -> bool:
    """Whether df is one table of Parquet files, at most filtered and projected."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:  # files of a kind that has no row numbers
        return False
    return True


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables from materialise() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Give memory that the driver's Python no longer uses back to the system, where the C
    library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def stable(df: DataFrame) -> DataFrame:
    """df itself if it is a table of Parquet files, else df written as one: then place() names
    each row."""
    return df if _scans_a_file(df) else materialise(df)


def place() -> Column:
    """For a table from stable(): which file and which row of it a row is. The same however
    a scan is split, so results of two scans can be joined by it. (The file is given as the
    64-bit hash of its path.)"""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def pack(docs: DataFrame, keep: list[str], **more: Column) -> DataFrame:
    """The kept columns as one struct, _doc, so that no name among them clashes with those
    that an operator makes; and further columns of docs under the given names."""
    doc = F.struct(*[docs[c].alias(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    return docs.select(doc.alias("_doc"), *[c.alias(n) for n, c in more.items()])


def unpack(packed: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """The kept columns again, and the made ones, which replace kept ones of their names. (Made
    ones are computed first: inside of a lambda a name would mean a kept column beside it.)"""
    first = packed.select("_doc", *[c.alias(f"_m{i}") for i, c in enumerate(made.values())])
    return first.select(*[F.col("_doc")[c].alias(c) for c in keep if c not in made], *[F.col(f"_m{i}").alias(n) for i, n in enumerate(made)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(key: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, without decoding it; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


FILTER_BITS = 1 << 21
BATCH = 2_000  # rows that a function over texts gets at once


def bit_filter(values: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """values: one long column. A test that is false for most numbers that values lacks and
    true for all it holds. It has one bit for each of so many remainders, so its size is
    bounded; where values fills it, it only saves less."""
    place = F.pmod(F.xxhash64(values[0]), F.lit(bits))
    on = np.zeros(bits, bool)
    on[values.select(place.alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    held = F.from_json(F.lit(str(np.packbits(on, bitorder="little").view(np.int64).tolist())), "array<long>")

    def test(x: Column) -> Column:
        at = F.pmod(F.xxhash64(x), F.lit(bits))
        return F.call_function("shiftright", F.get(held, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


HOT = 100_000
SALTS = 64


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, by: Column) -> DataFrame:
    """left joined to right by key. right has a row for each key and in the column count how many
    rows of left have it; keys of HOT rows or more are joined in SALTS parts, into which left
    is dealt by the hash of by, so that no task gets all rows of a key."""
    hot = right.where(F.col(count) >= HOT)
    if hot.isEmpty():
        return left.join(right, key)
    is_hot = F.coalesce(bit_filter(hot.select(key))(F.col(key)), F.lit(False))
    parts = right.where(is_hot).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = left.where(is_hot).withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return some.join(parts, [key, "_part"]).drop("_part").unionByName(left.where(~is_hot).join(right.where(~is_hot), key))


#: A-Z become a-z; digits, letters and bytes of non-ASCII characters stay; all else is a gap.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: As WORD_BYTES, but digits are gaps too.
LETTER_BYTES = bytes(32 if 48 <= b <= 57 else WORD_BYTES[b] for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def letter_words(text: bytes) -> list[bytes]:
    return text.translate(LETTER_BYTES).split()


def spaced(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.lower().split()


def arrow_map(df: DataFrame, columns: dict[str, Column], keep: list[str], out: dict[str, str], work: Callable[[dict[str, pa.Array]], dict[str, list | pa.Array]], whole: bool = False) -> DataFrame:
    """One row out for each row in: the kept columns of df, and what work makes of the
    given columns. The given columns get names of their own, so that no name of df
    clashes with them; a made column replaces a kept one of the same name. work gets BATCH
    rows at a time, or, if whole, as many as an Arrow batch has."""
    keep = [c for c in keep if c not in out]
    kept = {f"_k{i}": c for i, c in enumerate(keep)}
    given = {f"_g{i}": n for i, n in enumerate(columns)}
    source = df.select(*[df[c].alias(k) for k, c in kept.items()], *[columns[n].alias(g) for g, n in given.items()])
    made = {n: T._parse_datatype_string(t) for n, t in out.items()}
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(n, t) for n, t in made.items()])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            step = max(1, every.num_rows) if whole else BATCH
            for lo in range(0, every.num_rows, step):
                batch = every.slice(lo, step)
                got = work({n: batch.column(g) for g, n in given.items()})
                arrays = [batch.column(k) for k in kept]
                arrays = [a if a.type == arrow.field(i).type else a.cast(arrow.field(i).type) for i, a in enumerate(arrays)]
                for n in made:
                    kind = arrow.field(n).type
                    arrays.append(got[n].cast(kind) if isinstance(got[n], pa.Array) else pa.array(got[n], kind))
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


def rows_of(df: DataFrame, columns: list[Column], schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]]) -> DataFrame:
    """mapInArrow over the given columns; work yields dicts of columns."""
    kinds = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in work(batches):
            yield pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, kinds)
