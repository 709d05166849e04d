"""Pages of Office Open XML files by the standard library: a document, a workbook or a presentation is a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as Et

# Namespaces of the parts.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_PART = 1 << 28


def _part(z: zipfile.ZipFile, name: str) -> Et.Element:
    if z.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} exceeds {MAX_PART} bytes")
    raw = z.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError(f"{name} declares entities")
    return Et.fromstring(raw)


def _paragraph(p: Et.Element, run: str, tab: str, line: tuple[str, ...]) -> str:
    return "".join(e.text or "" if e.tag == run else "\t" if e.tag == tab else "\n" if e.tag in line else "" for e in p.iter())


def parse_docx(path: str, raw: bytes) -> list[str]:
    """One page: the paragraphs that aren't blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = _part(z, "word/document.xml")
    lines = (_paragraph(p, W + "t", W + "tab", (W + "br", W + "cr")) for p in body.iter(W + "p"))
    return ["\n".join(s for s in lines if s.strip())]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def parse_xlsx(path: str, raw: bytes) -> list[str]:
    """A page for each sheet, in the workbook's order: its name, and its rows with tabs between cells; blank rows go."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in i.iter(S + "t")) for i in _part(z, "xl/sharedStrings.xml").iter(S + "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in _part(z, "xl/_rels/workbook.xml.rels")}
        pages = []
        for sheet in _part(z, "xl/workbook.xml").iter(S + "sheet"):
            target = targets[sheet.get(R + "id")].lstrip("/")
            lines = []
            for row in _part(z, target if target.startswith("xl/") else f"xl/{target}").iter(S + "row"):
                cells: list[str] = []
                for c in row.iter(S + "c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    v = c.find(S + "v")
                    value = "".join(t.text or "" for t in c.iter(S + "t")) if c.get("t") == "inlineStr" else v.text or "" if v is not None else ""
                    value = shared[int(value)] if c.get("t") == "s" and value else {"1": "TRUE", "0": "FALSE"}.get(value, value) if c.get("t") == "b" else value
                    cells += [""] * (at - len(cells)) + [value]
                if any(x.strip() for x in cells):
                    lines.append("\t".join(cells))
            pages.append("\n".join([f"[Sheet: {sheet.get('name')}]", *lines]))
    return pages


def parse_pptx(path: str, raw: bytes) -> list[str]:
    """A page for each slide, by number: its paragraphs that aren't blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        pages = []
        for _, name in slides:
            lines = (_paragraph(p, A + "t", A + "tab", (A + "br",)) for p in _part(z, name).iter(A + "p"))
            pages.append("\n".join(s for s in lines if s.strip()))
    return pages


PARSERS = {"docx": parse_docx, "xlsx": parse_xlsx, "pptx": parse_pptx}
