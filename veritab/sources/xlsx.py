"""Workbooks: sheets with their row counts, and a sheet as a DataFrame.

A workbook is a ZIP of XML parts, read with the standard library as a stream, so a sheet's cells never stand in memory at once.  Files are
bounded by the size gate, hence the driver reads them and writes each sheet as one CSV part for Spark.
"""

from __future__ import annotations

import csv
import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 50, 57}


def _parts(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names and the parts that hold them, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): "xl/" + links[s.get(LINK)].removeprefix("/xl/").removeprefix("xl/") for s in sheets}


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        out = []
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{MAIN}si":
                out.append("".join(t.text or "" for t in e.iter(f"{MAIN}t")))
                e.clear()
        return out


def _dated(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    cells = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(cell, shared: list[str], dated: set[int]) -> str:
    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind is None and int(cell.get("s", 0)) in dated:
        at = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(v.text))
        return at.date().isoformat() if at.time() == dt.time() else at.isoformat(" ", "seconds")
    return v.text


def rows(path: str, sheet: str) -> Iterator[list[str]]:
    """The rows of a sheet as texts, empty cells as empty texts."""
    with zipfile.ZipFile(path) as book:
        shared, dated = _shared(book), _dated(book)
        with book.open(_parts(book)[sheet]) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{MAIN}row":
                    continue
                out: list[str] = []
                for k, cell in enumerate(e.iter(f"{MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    out += [""] * (at + 1 - len(out))
                    out[at] = _text(cell, shared, dated)
                yield out
                e.clear()


def sheets(path: str) -> dict[str, int]:
    """Each sheet's number of rows, the header included."""
    with zipfile.ZipFile(path) as book:
        names = list(_parts(book))
    return {n: sum(1 for _ in rows(path, n)) for n in names}


def choose(counts: dict[str, int], answered: str | None = None) -> str:
    """The only sheet, else the one that was named, else the largest (the first among equals)."""
    if len(counts) == 1 or answered not in counts:
        return max(counts, key=counts.get)
    return answered


def extract(path: str, sheet: str, folder: str) -> str:
    """The sheet as a CSV under a name that is safe for files; its path."""
    name = re.sub(r"[^\w.-]+", "_", sheet).strip("._") or "sheet"
    out = Path(folder) / f"{name}.csv"
    with out.open("w", newline="", encoding="utf-8") as f:
        writer, width = csv.writer(f), None
        for row in rows(path, sheet):
            width = len(row) if width is None else width
            writer.writerow([*row[:width], *[""] * (width - len(row))])
    return str(out)
