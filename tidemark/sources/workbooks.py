"""Spreadsheet workbooks (.xlsx) as tables: files are dealt out to tasks, which read the sheets' XML out of the zip."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_COLUMN = re.compile(r"[A-Z]+")


def _text(node) -> str:
    """The text of a string item: its own, or that of its runs; readings beside characters are left out."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def _place(reference: str | None, after: int) -> int:
    """The column's number, from 0, of a cell such as BC7; of a cell without a reference, the one after the last."""
    m = _COLUMN.match(reference or "")
    if not m:
        return after
    n = 0
    for c in m[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells as text) of each row that holds anything. Raises zipfile.BadZipFile, KeyError or ElementTree.ParseError."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, strings = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{_MAIN}si":
                        strings.append(_text(node))
                        node.clear()
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                number = 0
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    number = int(row.get("r") or number + 1)
                    cells: dict[int, str | None] = {}
                    for c in row.iter(f"{_MAIN}c"):
                        kind, value, inline = c.get("t"), c.findtext(f"{_MAIN}v"), c.find(f"{_MAIN}is")
                        if kind == "s" and value is not None:
                            value = strings[int(value)]
                        elif kind == "inlineStr" and inline is not None:
                            value = _text(inline)
                        elif kind == "b" and value is not None:
                            value = "true" if value == "1" else "false"
                        cells[_place(c.get("r"), max(cells, default=-1) + 1)] = value
                    if any(v not in (None, "") for v in cells.values()):
                        yield sheet.get("name"), number, [cells.get(k) for k in range(max(cells) + 1)]
                    row.clear()


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, cells (array<string>), error: the rows of all workbooks at a path (a file, a folder or a pattern).

    A file that cannot be read is one row with its error; rows of its that were read before stay. Empty rows are left out."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                try:
                    for sheet, number, cells in sheet_rows(content):
                        rows.append((name, sheet, number, cells, None))
                        if len(rows) >= 1000:
                            yield batch(rows)
                            rows = []
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "sheet", "row", "cells", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, sheet string, row int, cells array<string>, error string")


def workbook_table(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None, header: bool = True) -> DataFrame:
    """The columns, as strings, of one sheet (None: of any) of the workbooks at a path, with `file` and `row`.

    With a header the columns are those that its first row names, without it they are taken in order. A damaged file raises its error."""
    rows = workbook_rows(spark, path)
    rows = rows.where(F.col("sheet").isNull() | (F.col("sheet") == sheet)) if sheet else rows
    failed = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "error")).cast("string")).otherwise(F.col("sheet"))
    rows = rows.withColumn("sheet", failed).where("sheet is not null")
    if not header:
        return rows.select("file", "row", *[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(columns)])
    names = rows.groupBy("file", "sheet").agg(F.min_by("cells", "row").alias("_names"), F.min("row").alias("_top"))
    found = rows.join(names, ["file", "sheet"]).where(F.col("row") > F.col("_top"))
    place = lambda c: F.array_position(F.transform("_names", lambda x: F.coalesce(F.trim(F.regexp_replace(x, "^﻿", "")), F.lit(""))), F.lit(c))
    return found.select("file", "row", *[F.when(place(c) > 0, F.get("cells", (place(c) - 1).cast("int"))).alias(c) for c in columns])


def workbook_words(spark: SparkSession, sheets: dict[str, tuple[str, str | None, bool]]) -> DataFrame:
    """(word, category) of lexicon workbooks: category -> (path, sheet or None, whether its first row is a header). The first column counts; blank words are left out."""
    out = None
    for category, (path, sheet, header) in sheets.items():
        rows = workbook_table(spark, path, ["word"], sheet, header=False)
        first = rows.groupBy("file").agg(F.min("row").alias("_top"))
        rows = rows.join(first, "file").where(F.col("row") > F.col("_top")) if header else rows
        one = rows.select(F.trim("word").alias("word"), F.lit(category).alias("category")).where("word <> ''")
        out = one if out is None else out.unionByName(one)
    return out
