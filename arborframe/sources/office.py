"""DOCX, PPTX and XLSX files as pages and rows, from their XML; files come from Spark's binaryFile reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from posixpath import dirname, join, normpath
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Elements of a text document on a page without a break.
ELEMENTS_PER_PAGE = 4

#: Name spaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
LINKS = "{http://schemas.openxmlformats.org/package/2006/relationships}"

PAGES = "path string, page int, markdown string, error string"
ROWS = "path string, sheet string, row_index int, cells array<string>, error string"


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a table, the first one its header; short rows are padded and bars escaped."""
    width = max((len(r) for r in rows), default=0)
    lines = ["| " + " | ".join(" ".join(c.split()).replace("|", "\\|") for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if width else ""


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id to the name of the part that it leads to."""
    root = _part(z, f"{dirname(part)}/_rels/{part.rsplit('/', 1)[-1]}.rels")
    place = lambda t: t.lstrip("/") if t.startswith("/") else normpath(join(dirname(part), t))
    return {} if root is None else {x.get("Id", ""): place(x.get("Target", "")) for x in root.iter(LINKS + "Relationship")}


def docx_pages(data: bytes) -> list[str]:
    """Paragraphs and tables in order; a page ends at an explicit break, and after four elements."""
    pages: list[list[str]] = [[]]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml").find(W + "body")
    for x in body if body is not None else ():
        if x.tag == W + "tbl":
            cell = lambda c: " ".join("".join(t.text or "" for t in p.iter(W + "t")) for p in c.iter(W + "p"))
            block, ends = table_markdown([[cell(c) for c in row.iter(W + "tc")] for row in x.iter(W + "tr")]), False
        elif x.tag == W + "p":
            text = "".join("\t" if t.tag == W + "tab" else t.text or "" for t in x.iter() if t.tag in (W + "t", W + "tab")).strip()
            style = x.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"heading\s?([1-9])|title", style.get(W + "val", "").lower()) if style is not None else None
            block = "#" * min(6, int(level[1] or 1)) + " " + text if level and text else text
            ends = any(b.get(W + "type") == "page" for b in x.iter(W + "br")) or x.find(f"{W}pPr/{W}sectPr") is not None
        else:
            continue
        if block:
            if len(pages[-1]) >= ELEMENTS_PER_PAGE:
                pages.append([])
            pages[-1].append(block)
        if ends and pages[-1]:
            pages.append([])
    if len(pages) > 1 and not pages[-1]:
        pages.pop()
    return ["\n\n".join(p) for p in pages]


def pptx_pages(data: bytes) -> list[str]:
    """A page per slide, in the order of the presentation; titles become headings, groups are flattened."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        links = _targets(z, "ppt/presentation.xml")
        order = [links.get(x.get(R + "id", "")) for x in _part(z, "ppt/presentation.xml").iter(P + "sldId")]
        return ["\n\n".join(_shapes(_part(z, name))) for name in order if name]


def _shapes(slide: ET.Element | None) -> Iterator[str]:
    for x in slide.iter() if slide is not None else ():
        if x.tag == P + "sp":
            kind = x.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            title = kind is not None and kind.get("type") in ("title", "ctrTitle")
            lines = ["".join(t.text or "" for t in p.iter(A + "t")).strip() for p in x.iter(A + "p")]
            text = (" " if title else "\n").join(t for t in lines if t)
            if text:
                yield "# " * title + text
        elif x.tag == A + "tbl":
            yield table_markdown([["".join(t.text or "" for t in c.iter(A + "t")) for c in row.iter(A + "tc")] for row in x.iter(A + "tr")])


def xlsx_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of every sheet, with the values that the file holds; empty rows are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _part(z, "xl/sharedStrings.xml")
        texts = ["".join(t.text or "" for t in x.iter(S + "t")) for x in shared.iter(S + "si")] if shared is not None else []
        links = _targets(z, "xl/workbook.xml")
        for sheet in _part(z, "xl/workbook.xml").iter(S + "sheet"):
            with z.open(links[sheet.get(R + "id", "")]) as stream:
                n = 0
                for _, x in ET.iterparse(stream):
                    if x.tag != S + "row":
                        continue
                    cells = _cells(x, texts)
                    if any(cells):
                        yield sheet.get("name", ""), n, cells
                    n += 1
                    x.clear()


def _cells(row: ET.Element, texts: list[str]) -> list[str]:
    out: list[str] = []
    for c in row.iter(S + "c"):
        at = re.match("[A-Z]+", c.get("r", ""))
        column = 0
        for letter in at[0] if at else "":
            column = column * 26 + ord(letter) - 64
        out += [""] * ((column or len(out) + 1) - len(out))
        value = c.find(S + "v")
        raw = value.text or "" if value is not None else ""
        kind = c.get("t")
        if kind == "s" and raw:
            raw = texts[int(raw)]
        elif kind == "inlineStr":
            raw = "".join(t.text or "" for t in c.iter(S + "t"))
        elif kind == "b":
            raw = {"1": "True", "0": "False"}.get(raw, raw)
        out[-1] = raw.strip()
    return out


def _files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(folder)
    return files.select("path", "content")


def read_pages(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """path, page, markdown of the files below a folder; one that cannot be read is a row with its error."""
    convert = {"docx": docx_pages, "pptx": pptx_pages}[extension]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                try:
                    got = [(k, text, None) for k, text in enumerate(convert(data.as_py()))]
                except Exception as e:  # the policy for broken files is the caller's
                    got = [(None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_pydict({"path": [path.as_py()] * len(got), "page": pa.array([g[0] for g in got], pa.int32()), "markdown": pa.array([g[1] for g in got], pa.string()), "error": pa.array([g[2] for g in got], pa.string())})

    return _files(spark, folder, extension).mapInArrow(pages, PAGES)


def read_xlsx(spark: SparkSession, folder: str, batch: int = 500) -> DataFrame:
    """path, sheet, row_index, cells of every sheet below a folder, in batches of so many rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                part: list[tuple] = []
                try:
                    for sheet, n, cells in xlsx_rows(data.as_py()):
                        part.append((sheet, n, cells, None))
                        if len(part) == batch:
                            yield _batch(path.as_py(), part)
                            part = []
                except Exception as e:  # the rows before it stay
                    part.append((None, None, None, f"{type(e).__name__}: {e}"))
                if part:
                    yield _batch(path.as_py(), part)

    return _files(spark, folder, "xlsx").mapInArrow(rows, ROWS)


def _batch(path: str, part: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
    columns = {n: pa.array([p[i] for p in part], k) for i, (n, k) in enumerate(zip(("sheet", "row_index", "cells", "error"), kinds, strict=True))}
    return pa.RecordBatch.from_pydict({"path": [path] * len(part)} | columns)
