"""Tables from files, each through Spark's own readers, so any file system that Spark knows will do."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .landing import folder, land


def fetched(spark: SparkSession, url: str) -> str:
    """A copy of what http(s) serves there, in the folder that all executors share, streamed and never held whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder(spark, "fetched"))
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.net.URI(url).toURL().openStream(), path.getFileSystem(conf).create(path), conf, True)
    return path.toString()


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", schema: str | None = None) -> DataFrame:
    """A header line, and types from a schema or, at the cost of another pass, from the data. path: of any file system
    that Spark knows, or http(s)."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
    path = fetched(spark, path) if path.lower().startswith(("http://", "https://")) else path
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _shared(book: zipfile.ZipFile) -> list[str]:
    """The table of texts that cells refer to."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, e in ElementTree.iterparse(stream):
            if e.tag == f"{MAIN}si":
                out.append("".join(t.text or "" for t in e.iter(f"{MAIN}t")))
                e.clear()
    return out


def sheet_rows(data: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """The rows of one sheet of an xlsx workbook, as text, one after the other: no more of the sheet is held than a row."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = [(s.get("name"), s.get(LINK)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    link = names[sheet][1] if isinstance(sheet, int) else dict(names)[sheet]
    target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}[link]
    shared = _shared(book)
    with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag == f"{MAIN}row":
                yield _cells(row, shared)
                row.clear()


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    cells: list[str | None] = []
    for c in row.iter(f"{MAIN}c"):
        at = 0
        for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
            at = 26 * at + ord(letter) - 64
        cells += [None] * ((at or len(cells) + 1) - len(cells))
        v, kind = c.find(f"{MAIN}v"), c.get("t")
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
        else:
            value = None if v is None else v.text
            value = shared[int(value)] if kind == "s" and value is not None else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
        cells[(at or len(cells)) - 1] = value
    return cells


def workbook(names: list[str], rows: Iterator[tuple], sheet: str = "sheet") -> bytes:
    """A workbook of one sheet."""

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    links = LINK[1:].split("}")[0]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{links}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{links}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            for r in itertools.chain([tuple(names)], rows):
                out.write(f"<row>{''.join(map(cell, r))}</row>".encode())
            out.write(b"</sheetData></worksheet>")
    return data.getvalue()


def to_excel(df: DataFrame, sheet: str = "sheet") -> DataFrame:
    """content: a workbook for each partition of a table, made by its task; repartition for more or fewer. Values that
    aren't numbers or flags go in as text."""
    names = df.columns

    def run(batches):
        import pyarrow as pa

        rows = (tuple(r.values()) for batch in batches for r in batch.to_pylist())
        first = next(rows, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([workbook(names, itertools.chain([first], rows), sheet)], pa.binary())], ["content"])

    return df.mapInArrow(run, "content binary")


def excel_tables(books: DataFrame, sheet: int | str = 0, header: int = 0) -> DataFrame:
    """One sheet of each workbook (a column content), with types from its text: all numbers, then all true or false, else
    text. `header`: the row that names the columns, the same in all workbooks. Each workbook is read once, in a task of
    its own, and its rows land as a table; names and types are found there."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                rows = enumerate(itertools.islice(sheet_rows(data.as_py(), sheet), header, None))
                while some := list(itertools.islice(rows, 5_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([r for _, r in some], pa.list_(pa.string()))], ["place", "cells"])

    rows = land(books.select("content").mapInArrow(run, "place long, cells array<string>"), "sheets")
    names = rows.where("place = 0").agg(F.first("cells")).first()[0]
    if names is None:
        raise ValueError(f"no workbook has a row {header} in sheet {sheet}")
    text = rows.where("place > 0").select(*(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(names))))
    found = text.agg(*(x for c in text.columns for x in (F.count(c), F.count(F.col(c).try_cast("double")), F.count_if(F.col(c).isin("true", "false"))))).first()
    kinds = ["double" if found[3 * i] and found[3 * i] == found[3 * i + 1] else "boolean" if found[3 * i] and found[3 * i] == found[3 * i + 2] else "string" for i in range(len(names))]
    return text.select(*(F.col(f"c{i}").cast(k).alias(str(n)) for i, (n, k) in enumerate(zip(names, kinds))))


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0, header: int = 0) -> DataFrame:
    """excel_tables() of the workbooks at a path."""
    return excel_tables(spark.read.format("binaryFile").load(path), sheet, header)
