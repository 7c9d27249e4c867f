"""Sheets of workbooks in the Office Open XML format, read from the packed file with the standard library alone."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any, BinaryIO
from xml.etree import ElementTree

#: Namespaces, and the numbers of the built-in formats of dates and times (fixed values of the format).
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column(reference: str) -> int:
    """The number of a cell's column from its letters, from 0."""
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, without its phonetic hints."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))


class Workbook:
    def __init__(self, file: BinaryIO) -> None:
        self.zip = zipfile.ZipFile(file)
        book = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {s.get("name"): self._path(links[s.get(LINK)]) for s in book.iter(f"{MAIN}sheet")}
        base = book.find(f"{MAIN}workbookPr")
        # days count from here; the older system takes 1900 for a leap year
        self.origin = datetime(1904, 1, 1) if base is not None and base.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.strings = [_text(si) for si in self._xml("xl/sharedStrings.xml").findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._date_styles() if "xl/styles.xml" in self.zip.namelist() else set()

    def _xml(self, name: str) -> ElementTree.Element:
        with self.zip.open(name) as f:
            return ElementTree.parse(f).getroot()

    @staticmethod
    def _path(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _date_styles(self) -> set[int]:
        root = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in root.iter(f"{MAIN}numFmt")}
        cells = root.find(f"{MAIN}cellXfs")
        ids = [int(x.get("numFmtId") or 0) for x in cells] if cells is not None else []
        return {i for i, n in enumerate(ids) if n in DATE_FORMATS or re.search("[ymdhs]", own.get(n, ""), re.I)}

    def _value(self, cell: ElementTree.Element) -> Any:
        kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return _text(cell.find(f"{MAIN}is"))
        if v is None or v.text is None or kind == "e":
            return None
        match kind:
            case "s":
                return self.strings[int(v.text)]
            case "b":
                return v.text == "1"
            case "str":
                return v.text
            case "d":
                return datetime.fromisoformat(v.text)
        number = float(v.text)
        if int(cell.get("s") or 0) in self.dates:
            return self.origin + timedelta(microseconds=round(number * 86_400e6))
        return int(number) if number.is_integer() and not re.search("[.eE]", v.text) else number

    def rows(self, sheet: str | int = 0) -> Iterator[list[Any]]:
        path = self.sheets[sheet] if isinstance(sheet, str) else list(self.sheets.values())[sheet]
        done = 0
        with self.zip.open(path) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                at = int(node.get("r") or done + 1)
                for _ in range(at - done - 1):
                    yield []
                out: list[Any] = []
                for c in node.findall(f"{MAIN}c"):
                    i = _column(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (i + 1 - len(out))
                    out[i] = self._value(c)
                done = at
                node.clear()
                yield out


def sheet_rows(file: BinaryIO, sheet: str | int = 0) -> list[list[Any]]:
    return list(Workbook(file).rows(sheet))
