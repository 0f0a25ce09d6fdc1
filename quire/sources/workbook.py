"""The rows of a workbook's first sheet, from the XML of an .xlsx file.

A workbook is a zip of XML parts: the workbook names its sheets, relations name their parts, texts are either in the cell or shared by number.  The sheet is read as a
stream and forgotten row by row; only the shared texts are held.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from posixpath import join, normpath
from xml.etree.ElementTree import Element, iterparse, parse

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WHOLE = re.compile(r"-?\d+\.0+")


def column_number(reference: str) -> int:
    """The column of a cell from 0: A1 is 0, AB7 is 27."""
    number = 0
    for c in reference:
        if not c.isalpha():
            break
        number = number * 26 + ord(c.upper()) - 64
    return number - 1


def _text(node: Element) -> str:
    """All runs of a text, without how it is pronounced."""
    return "".join(t.text or "" for run in node if run.tag != f"{_MAIN}rPh" for t in ([run] if run.tag == f"{_MAIN}t" else run.iter(f"{_MAIN}t")))


def _value(cell: Element, shared: list[str]) -> str | None:
    """A cell as text: whole numbers without a fraction, truth as TRUE or FALSE, nothing for an error."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return _text(inline) if inline is not None else None
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "TRUE" if value.text == "1" else "FALSE"
    return value.text.split(".")[0] if kind == "n" and _WHOLE.fullmatch(value.text) else value.text


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = parse(book.open("xl/workbook.xml")).getroot().find(f"{_MAIN}sheets/{_MAIN}sheet")
    for relation in parse(book.open("xl/_rels/workbook.xml.rels")).getroot():
        if relation.get("Id") == sheet.get(_RELATION):
            target = relation.get("Target")
            return target.lstrip("/") if target.startswith("/") else normpath(join("xl", target))
    raise ValueError("the workbook doesn't say where its first sheet is")


def sheet_rows(content: bytes, width: int) -> Iterator[tuple]:
    """(row from 1, the first `width` cells as text or None) of each row that the sheet has."""
    with zipfile.ZipFile(BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, node in iterparse(book.open("xl/sharedStrings.xml")):
                if node.tag == f"{_MAIN}si":
                    shared.append(_text(node))
                    node.clear()
        number = 0
        for _, node in iterparse(book.open(_first_sheet(book))):
            if node.tag != f"{_MAIN}row":
                continue
            number = int(node.get("r", number + 1))
            cells: list[str | None] = [None] * width
            at = -1
            for cell in node.iter(f"{_MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else at + 1  # without a reference it is the next
                if at < width:
                    cells[at] = _value(cell, shared)
            node.clear()
            yield number, *cells
