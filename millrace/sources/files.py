"""Reading and writing tables: CSV, TSV, JSON, XLSX, Parquet.

Text sources give text cells with inferred logical types; rows keep the order of files and
of rows in a file in __rid, however a scan is split. A path may be a file or a folder of part
files. Files go through Spark's readers; only a head is looked at on the driver, to find a
delimiter or the order of keys. A JSON array is one cell while it is read (a file up to
2 GB); one object a line is read in parallel, and so is CSV, unless a quoted cell holds a line
break, which makes a file one task.
"""

from __future__ import annotations

import csv
import io
import json
import mmap
import os
import re
import tempfile
import zipfile
from array import array
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import chain
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..operators.analysis import with_types
from ..plans.scratch import scratch_path
from ..plans.table import RID, ColumnMeta, Table
from ..plans.view import view

HEAD_BYTES = 1 << 16
#: Cells, and characters in them, of a workbook that the driver holds at once (and one row).
CELLS_HELD = 400_000
CHARACTERS_HELD = 16_000_000
FILE_BITS = 40  # files up to a TB, eight million of them


def format_of(path: str) -> str:
    """By the ending: xlsx, json, tsv, parquet, otherwise csv."""
    end = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return {"xlsx": "xlsx", "xls": "xlsx", "json": "json", "tsv": "tsv", "parquet": "parquet"}.get(end, "csv")


def _first_file(spark: SparkSession, path: str):
    """The file system and path of a file, or of a folder's first data file (None if it has none)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        parts = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(at) if s.isFile())
        parts = [n for n, size_ in parts if size_ and not n.startswith(("_", "."))]
        return fs, jvm.org.apache.hadoop.fs.Path(at, parts[0]) if parts else None
    return fs, at


def _head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """The first bytes (all, if size is 0) of a file, or of a folder's first data file."""
    jvm = spark.sparkContext._jvm
    fs, at = _first_file(spark, path)
    if at is None:
        return b""
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size))) if size else bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole small file, such as a recipe."""
    return _head(spark, path, 0)


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """A small file on any file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def encoding_of(head: bytes) -> str:
    """UTF-8 if it reads as such (a cut last character aside), else Latin-1."""
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as error:
        if len(head) - error.start > 3:
            return "ISO-8859-1"
    return "UTF-8"


def sniff_delimiter(head: str) -> str:
    """The sign that cuts the first lines into most cells, as many in each line."""
    best, most = ",", 0.0
    for d in (",", "\t", ";", "|"):
        sizes = [len(r) for r in list(csv.reader(io.StringIO(head), delimiter=d))[:20] if r]
        if sizes and sizes[0] > 1:
            fit = sizes[0] * sum(s == sizes[0] for s in sizes) / len(sizes)
            if fit > most:
                best, most = d, fit
    return best


def _numbered(df: DataFrame, columns: list[Column], at: Column | None = None) -> DataFrame:
    """__rid and the columns: a number that grows with the file's name and the row in it. A split
    of a file begins at a byte, and its rows, one byte long at least, are counted on from there;
    rows that know their place (at) have it already."""
    if at is None:
        at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    paths = sorted(set(df.inputFiles()))
    if len(paths) < 2:
        return df.select(at.alias(RID), *columns)
    spark = df.sparkSession
    ranks = spark.createDataFrame([(p, i << FILE_BITS) for i, p in enumerate(paths)], "__path string, __base long")
    out = df.select(F.col("_metadata.file_path").alias("__file"), at.alias("__at"), *columns)
    out = out.join(ranks, F.col("__file") == F.col("__path"), "left")
    return out.select((F.col("__base") + F.col("__at")).alias(RID), *[c for c in out.columns if not c.startswith("__")])


def _ordered(df: DataFrame, names: list[str]) -> Table:
    metas = tuple(ColumnMeta(f"c{i}", n or f"Column {i + 1}") for i, n in enumerate(names))
    return Table(_numbered(df, [F.col(f"`{c}`").alias(m.id) for c, m in zip(df.columns, metas, strict=True)]), metas, len(metas))


def _broken_lines(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a line has an odd number of quotes, so that a quoted cell goes on in the next."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("encoding", encoding).text(path)
    return not lines.where(quotes % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool | None = None) -> Table:
    """multiline: whether quoted cells hold line breaks; if not told, a scan finds out."""
    head = _head(spark, path)
    encoding = encoding_of(head)
    text = head.decode(encoding, "ignore").lstrip("﻿")
    delimiter = delimiter or sniff_delimiter(text)
    header = next(csv.reader(io.StringIO(text), delimiter=delimiter), [])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    if multiline is None:
        multiline = _broken_lines(spark, path, encoding)
    options = {"header": True, "multiLine": multiline, "sep": delimiter, "quote": '"', "escape": '"', "encoding": encoding, "enforceSchema": True, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t = _ordered(spark.read.options(**options).schema(schema).csv(path), header)
    some = F.lit(False)
    for m in t.metas:
        some = some | ~t.blank(m)
    return with_types(t.filter(some))


def _one_a_line(head: bytes) -> bool:
    """Whether the first lines are whole JSON objects, and more than one."""
    lines = [x for x in head.split(b"\n")[:3] if x.strip()]
    try:
        return len(lines) > 1 and all(isinstance(json.loads(x), dict) for x in lines[:2])
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str) -> Table:
    """An array of objects (or one object); keys in order of first sight, nested values as
    JSON text. The keys come from a scan that keeps the least place of each."""
    if _one_a_line(_head(spark, path)):
        items = _numbered(raw := spark.read.text(path), [F.col("value").alias("item")]).withColumnRenamed(RID, "base").where(F.trim("item") != "")
    else:
        raw = _numbered(spark.read.text(path, wholetext=True), [F.col("value")])
        whole = F.regexp_replace("value", r"^[\s\uFEFF]+", "")
        listed = F.when(whole.startswith("["), whole).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
        items = raw.select(RID, F.posexplode(F.from_json(listed, "array<string>")).alias("i", "item")).select((F.col(RID) + F.col("i")).alias("base"), "item")
    keyed = items.select("base", "item", F.json_object_keys("item").alias("keys"))
    firsts = keyed.select("base", F.posexplode("keys").alias("at", "k")).groupBy("k").agg(F.min(F.struct("base", "at")).alias("first")).orderBy("first").collect()
    names = [r["k"] for r in firsts]
    values = F.from_json("item", "map<string,string>")
    df = items.select("base", values.alias("m"))
    metas = tuple(ColumnMeta(f"c{i}", n) for i, n in enumerate(names))
    return with_types(Table(df.select(F.col("base").alias(RID), *[F.try_element_at("m", F.lit(n)).alias(m.id) for n, m in zip(names, metas, strict=True)]), metas, len(metas)))


def read_parquet(spark: SparkSession, path: str) -> Table:
    """Columns keep their Spark types."""
    df = spark.read.parquet(path)
    of = {"bigint": cells.INTEGER, "int": cells.INTEGER, "double": cells.DECIMAL, "float": cells.DECIMAL, "boolean": cells.BOOLEAN}
    metas = tuple(ColumnMeta(f"c{i}", f.name, of.get(f.dataType.simpleString(), cells.TEXT)) for i, f in enumerate(df.schema))
    return Table(_numbered(df, [F.col(f"`{f.name}`").alias(m.id) for f, m in zip(df.schema, metas, strict=True)], F.col("_metadata.row_index")), metas, len(metas))


def rows_table(spark: SparkSession, names: list[str], rows: list[list]) -> Table:
    """A small table from rows of text cells; short rows are filled with nulls."""
    n = len(names)
    schema = T.StructType([T.StructField(RID, T.LongType()), *[T.StructField(f"c{i}", T.StringType()) for i in range(n)]])
    data = [(i, *[None if j >= len(r) or r[j] is None else str(r[j]) for j in range(n)]) for i, r in enumerate(rows)]
    return with_types(Table(spark.createDataFrame(data, schema), tuple(ColumnMeta(f"c{i}", x or f"Column {i + 1}") for i, x in enumerate(names)), n))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


# The number formats that workbooks know by number alone.
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm"}
_DATE_PART = re.compile(r"AM/PM|y+|m+|d+|h+|s+", re.IGNORECASE)


def shown(value: str, code: str) -> str:
    """A cell's number as its format shows it: dates and times, decimals, thousands, percent."""
    try:
        number = float(value)
    except ValueError:
        return value
    bare = re.sub(r"\\(.)", r"\1", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code.split(";")[0]))
    if re.search("[ymdhs]", bare, re.IGNORECASE) and not re.search("[0#]", bare):
        return _as_date(number, bare)
    places = re.search(r"[0#]+(?:\.([0#]+))?", bare.replace(",", ""))
    if not places:
        return repr(int(number)) if number == int(number) else value
    number *= 100 if "%" in bare else 1
    return f"{number:{',' if ',' in bare else ''}.{len(places[1] or '')}f}" + ("%" if "%" in bare else "")


def _as_date(serial: float, code: str) -> str:
    at = datetime(1899, 12, 30) + timedelta(days=int(serial), seconds=round(serial % 1 * 86400))
    half, after_hour = "am/pm" in code.lower(), False

    def put(m: re.Match) -> str:
        nonlocal after_hour
        part = m[0].lower()
        n, minute = len(part), part[0] == "m" and (after_hour or code[m.end() :].lstrip(":. ").lower().startswith("s"))
        after_hour = part[0] == "h"
        if part == "am/pm":
            return "AM" if at.hour < 12 else "PM"
        if minute:
            return f"{at.minute:0{min(n, 2)}d}"
        if part[0] == "y":
            return f"{at.year:04d}" if n > 2 else f"{at.year % 100:02d}"
        if part[0] == "m":
            return at.strftime("%b" if n == 3 else "%B") if n > 2 else f"{at.month:0{n}d}"
        if part[0] == "d":
            return at.strftime("%a" if n == 3 else "%A") if n > 2 else f"{at.day:0{n}d}"
        hour = (at.hour % 12 or 12) if half else at.hour
        return f"{hour if part[0] == 'h' else at.second:0{min(n, 2)}d}"

    return _DATE_PART.sub(put, code)


def _formats(z: zipfile.ZipFile) -> list[str]:
    """The number format of each cell style."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(x.get("numFmtId", 0)): x.get("formatCode", "") for x in root.iter(f"{{{_NS['m']}}}numFmt")}
    styles = root.find("m:cellXfs", _NS)
    return [own.get(k) or BUILT_IN.get(k, "") for k in (int(x.get("numFmtId", 0)) for x in (styles if styles is not None else []))]


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of the sheet that the workbook lists first."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        sheet = ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
        wanted = None if sheet is None else next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            if x.get("Id") == wanted:
                part = x.get("Target", "").lstrip("/")
                part = part if part.startswith("xl/") else f"xl/{part}"
                if part in names:
                    return part
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _elements(part: IO[bytes], name: str, within: str) -> Iterator[ElementTree.Element]:
    """Elements of that name as they end, inside of one called within, which is emptied after
    each: only one is held at a time."""
    name, within, holder = f"{{{_NS['m']}}}{name}", f"{{{_NS['m']}}}{within}", None
    for event, x in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            if x.tag == within and holder is None:
                holder = x
        elif x.tag == name:
            yield x
            if holder is not None:
                holder.clear()


class _Strings:
    """Texts by number, in a file of their own: of each only its place is in memory."""

    def __init__(self, texts: Iterator[str]):
        self.file, self.ends = tempfile.TemporaryFile(), array("q", [0])
        for t in texts:
            self.ends.append(self.ends[-1] + self.file.write(t.encode()))
        self.file.flush()
        self.raw = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ) if self.ends[-1] else b""

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends) - 1:
            raise IndexError(f"shared string {i}")
        return self.raw[self.ends[i] : self.ends[i + 1]].decode()


def _place(letters: str) -> int:
    """Number of a column from its letters."""
    return sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1


def _sheet_rows(book: str | IO[bytes]) -> Iterator[list[str | None]]:
    """Rows of the first sheet, one after another: cells as text, as their formats show them."""
    m = f"{{{_NS['m']}}}"
    with zipfile.ZipFile(book) as z:
        shared, formats = _Strings(iter(())), _formats(z)
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = _Strings("".join(x.text or "" for x in si.iter(f"{m}t")) for si in _elements(part, "si", "sst"))
        places: dict[str, int] = {}
        with z.open(_first_sheet(z)) as part:
            for row in _elements(part, "row", "sheetData"):
                got: list[str | None] = []
                for c in row.findall(f"{m}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = len(got)
                    if letters:
                        at = places[letters[0]] if letters[0] in places else places.setdefault(letters[0], _place(letters[0]))
                    got += [None] * (at + 1 - len(got))
                    kind, v = c.get("t"), c.find(f"{m}v")
                    if kind == "inlineStr":
                        got[at] = "".join(x.text or "" for x in c.iter(f"{m}t"))
                    elif v is not None and v.text is not None:
                        style = int(c.get("s", 0))
                        code = formats[style] if style < len(formats) else ""
                        got[at] = shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else shown(v.text, code) if code and kind in (None, "n") else v.text
                yield got


def _xlsx_rows(raw: bytes) -> list[list[str | None]]:
    """All rows of a small workbook."""
    return list(_sheet_rows(io.BytesIO(raw)))


def _held(rows: Iterator[list[str | None]], n: int) -> Iterator[list[list[str | None]]]:
    """Rows cut to n cells, in lists of some CELLS_HELD cells or CHARACTERS_HELD characters."""
    held: list[list[str | None]] = []
    size = 0
    for r in rows:
        held.append(r[:n])
        size += sum(map(len, filter(None, held[-1])))
        if len(held) * max(1, n) >= CELLS_HELD or size >= CHARACTERS_HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_xlsx(spark: SparkSession, path: str) -> Table:
    """A workbook is one compressed file: the driver goes through it once, row by row, and what
    it doesn't hold at once is written to a table in the shared folder."""
    with tempfile.TemporaryDirectory() as folder:
        local = f"{os.path.realpath(folder)}/book.xlsx"
        fs, at = _first_file(spark, path)
        if at is None:
            raise ValueError(f"no workbook in {path}")
        fs.copyToLocalFile(False, at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)
        rows = _sheet_rows(local)
        names = [x or "" for x in next(rows, [])]
        parts = _held((r for r in rows if any((x or "").strip() for x in r)), len(names))
        first, second = next(parts, []), next(parts, None)
        if second is None:
            return rows_table(spark, names, first)
        ids = [f"c{i}" for i in range(len(names))]
        schema = pa.schema([(RID, pa.int64()), *[(c, pa.string()) for c in ids]])
        out, done = scratch_path(spark), 0
        for part in chain([first, second], parts):
            cells_of = [[r[i] if i < len(r) else None for r in part] for i in range(len(ids))]
            spark.createDataFrame(pa.Table.from_arrays([pa.array(range(done, done + len(part)), pa.int64()), *[pa.array(x, pa.string()) for x in cells_of]], schema=schema)).write.mode("append").parquet(out)
            done += len(part)
    df = spark.read.schema(T.StructType([T.StructField(RID, T.LongType()), *[T.StructField(c, T.StringType()) for c in ids]])).parquet(out)
    return with_types(Table(df, tuple(ColumnMeta(c, x or f"Column {i + 1}") for i, (c, x) in enumerate(zip(ids, names, strict=True))), len(ids)))


def read(spark: SparkSession, path: str) -> Table:
    kind = format_of(path)
    if kind == "tsv":
        return read_csv(spark, path, "\t")
    return {"csv": read_csv, "json": read_json, "xlsx": read_xlsx, "parquet": read_parquet}[kind](spark, path)


# -- sinks --------------------------------------------------------------------------------------


def write_csv(t: Table, path: str, delimiter: str = ",", single: bool = False) -> None:
    """Header and rows in order, cells as text, in a folder of part files (one, if single)."""
    df = t.df.orderBy(RID).select(*[t.text(m).alias(m.id) for m in t.metas])
    df = df.coalesce(1) if single else df
    named = df.toDF(*_unique(t.names))
    named.write.mode("overwrite").csv(path, header=True, sep=delimiter, quote='"', escape='"', lineSep="\r\n" if single else "\n", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_tsv(t: Table, path: str, single: bool = False) -> None:
    write_csv(t, path, "\t", single)


def write_json(t: Table, path: str) -> None:
    """One object a line, nulls written, typed cells as such."""
    t.df.orderBy(RID).select(*[F.col(m.id).alias(n) for m, n in zip(t.metas, _unique(t.names), strict=True)]).write.mode("overwrite").json(path, ignoreNullFields=False)


def json_array(t: Table) -> Iterator[str]:
    """The pieces of one JSON array of all rows, two spaces deep, in order."""
    first = True
    yield "["
    for row in t.ordered().select(*[m.id for m in t.metas]).toLocalIterator(prefetchPartitions=True):
        item = json.dumps(dict(zip(_unique(t.names), row, strict=True)), indent=2, ensure_ascii=False, default=str)
        yield ("\n" if first else ",\n") + "\n".join(f"  {line}" for line in item.split("\n"))
        first = False
    yield "]" if first else "\n]"


def write_parquet(t: Table, path: str) -> None:
    """Columns without __rid, in row order: files and rows in them are in the order of rows."""
    names = _unique(t.names)
    t.ordered().select(*[F.col(m.id).alias(n) for m, n in zip(t.metas, names, strict=True)]).write.mode("overwrite").parquet(path)


def write_view(t: Table, path: str, text: str = "", column: str | None = None, direction: str | None = None) -> None:
    """The searched and sorted rows as CSV."""
    df = view(t, text, column, direction)
    df.select(*[t.text(m).alias(m.id) for m in t.metas]).toDF(*_unique(t.names)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def _cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _letters(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_xlsx(t: Table, path: str) -> None:
    """One sheet in one file on any file system, streamed from the rows in order."""
    spark = t.df.sparkSession
    with tempfile.TemporaryDirectory() as folder:
        local = f"{folder}/sheet.xlsx"
        _write_sheet(t, local)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, here, at)


def _write_sheet(t: Table, path: str) -> None:
    kinds = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in kinds.items():
            z.writestr(name, body)
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            put = lambda s: out.write(s.encode())
            put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>')
            rows = t.ordered().select(*[m.id for m in t.metas]).toLocalIterator(prefetchPartitions=True)
            for i, row in enumerate([t.names, *[]], 1):
                put(f'<row r="{i}">' + "".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(row)) + "</row>")
            for i, row in enumerate(rows, 2):
                put(f'<row r="{i}">' + "".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(row)) + "</row>")
            put("</sheetData></worksheet>")
