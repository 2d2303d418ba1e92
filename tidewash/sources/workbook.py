"""Workbooks (.xlsx): sheet names, and the rows of one sheet per workbook.

A workbook is at most MAX_BYTES by admission, so it is the unit of work: Spark
packs the files into tasks of at most spark.sql.files.maxPartitionBytes, and a
small reader inside the task streams the rows of one sheet. Types are inferred
afterwards by the same pass as for CSV.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewash.sources.listing import MAX_BYTES
from tidewash.sources.tables import header_names, infer_types

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BATCH_ROWS = 5_000
DEFAULT_SHEET = "Default"
# Number formats of the file format that show a date or a time.
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """The workbooks below ``path``; one beyond the size of admission is an error, as it is on upload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    large = files.filter(F.col("length") > MAX_BYTES).select("path").limit(1).collect()
    if large:
        raise ValueError(f"{large[0]['path']} has more than {MAX_BYTES} bytes")
    return files.select("path", "content")


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """One row per workbook and sheet, sheets in workbook order."""
    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    names = [name for name, _ in _sheet_parts(book)]
                yield pd.DataFrame({"path": file, "sheet_idx": range(len(names)), "sheet_name": names})

    return workbook_files(spark, path).mapInPandas(sheets, "path string, sheet_idx int, sheet_name string")


def read_cells(spark: SparkSession, path: str, sheet: str | None = DEFAULT_SHEET) -> DataFrame:
    """(path, sheet, row_no, cells) of the named sheet, or of the first one."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    yield from _row_batches(book, file, sheet)

    return workbook_files(spark, path).mapInPandas(rows, "path string, sheet string, row_no int, cells array<string>")


def read_workbook(spark: SparkSession, path: str, sheet: str | None = DEFAULT_SHEET) -> DataFrame:
    """The rows of one sheet as a typed table; the first row holds the names.

    Several workbooks below ``path`` must share their header row.
    """
    cells = read_cells(spark, path, sheet)
    headers = cells.filter("row_no = 0").select("cells").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError("the workbooks have no common header row")
    width = cells.agg(F.max(F.size("cells"))).first()[0]
    names = header_names([*headers[0]["cells"], *[None] * (width - len(headers[0]["cells"]))])
    raw = cells.filter("row_no > 0").select(*[_cell(i).alias(n) for i, n in enumerate(names)])
    return infer_types(raw)


def _cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


# -- reading one workbook ---------------------------------------------------------

def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part of the archive) in workbook order."""
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {link.get("Id"): link.get("Target") for link in links}
    sheets = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), place(target[s.get(REL_ID)])) for s in sheets]


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    items = ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in items]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ET.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt")
        if any(letter in f.get("formatCode", "").lower() for letter in ("y", "d", "h", "s"))
    }
    formats = styles.find(f"{MAIN}cellXfs")
    used = [] if formats is None else list(formats)
    return {i for i, x in enumerate(used) if int(x.get("numFmtId", 0)) in DATE_FORMAT_IDS | custom}


def _row_batches(book: zipfile.ZipFile, file: str, sheet: str | None) -> Iterator[pd.DataFrame]:
    parts = _sheet_parts(book)
    name, part = parts[0] if sheet in (None, DEFAULT_SHEET) else next(p for p in parts if p[0] == sheet)
    texts, dates = _shared_texts(book), _date_styles(book)
    numbers, cells = [], []
    frame = lambda: pd.DataFrame({"path": file, "sheet": name, "row_no": numbers, "cells": cells})
    with book.open(part) as stream:
        for _, row in ET.iterparse(stream):
            if row.tag != f"{MAIN}row":
                continue
            numbers.append(int(row.get("r", len(numbers) + 1)) - 1)
            cells.append(_row_cells(row, texts, dates))
            row.clear()
            if len(cells) == BATCH_ROWS:
                yield frame()
                numbers, cells = [], []
    if cells:
        yield frame()


def _row_cells(row: ET.Element, texts: list[str], dates: set[int]) -> list[str | None]:
    out: list[str | None] = []
    for cell in row.iter(f"{MAIN}c"):
        at = _column_number(cell.get("r"), len(out))
        out.extend([None] * (at - len(out)))
        out.append(_cell_text(cell, texts, dates))
    return out


def _column_number(reference: str | None, default: int) -> int:
    if not reference:
        return default
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _cell_text(cell: ET.Element, texts: list[str], dates: set[int]) -> str | None:
    kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None:
        return None
    if kind == "s":
        return texts[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind is None and int(cell.get("s", 0)) in dates:
        stamp = datetime(1899, 12, 30) + timedelta(days=float(value))
        return str(stamp.replace(microsecond=0) if stamp.microsecond < 500_000 else stamp.replace(microsecond=0) + timedelta(seconds=1))
    return None if kind == "e" else value
