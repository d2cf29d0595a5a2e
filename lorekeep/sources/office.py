"""Office files without a library: sheets and paragraphs are XML in a zip archive."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(reference: str) -> int:
    """The number of a cell's column, from 0: ``C7`` is 2."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """Name and rows of every sheet of a workbook; cells are text, missing ones are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/{targets[sheet.get(LINK)]}")).iter(f"{MAIN}row"):
                cells: list[str] = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    value = c.find(f"{MAIN}v")
                    if c.get("t") == "s" and value is not None:
                        cells.append(shared[int(value.text)])
                    elif c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                    else:
                        cells.append(value.text or "" if value is not None else "")
                rows.append(cells)
            out.append((sheet.get("name", ""), rows))
    return out


def workbook_text(content: bytes) -> str:
    """Each sheet with rows under its name: the first row is a table's header, others are brought to its width; a lone row is one line."""
    parts = []
    for name, rows in sheets(content):
        rows = [r for r in rows if any(r)]
        if not rows:
            continue
        width = len(rows[0])
        if len(rows) == 1:
            body = " | ".join(rows[0])
        else:
            lines = [rows[0], ["---"] * width, *[(r + [""] * width)[:width] for r in rows[1:]]]
            body = "\n".join("| " + " | ".join(line) + " |" for line in lines)
        parts.append(f"## {name}\n\n{body}\n")
    return "\n\n".join(parts)


def document_text(content: bytes) -> str:
    """The paragraphs of a text document, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORDS}t")) for p in body.iter(f"{WORDS}p"))


#: What needs no model: workbooks and text documents.
EXTRACTORS = {"xlsx": workbook_text, "docx": document_text}
