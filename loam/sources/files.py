"""Uploaded files to text parts: one part for each sheet of a workbook, one for any other file."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content types read as workbooks.
SHEET_TYPES = (
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel.sheet.macroEnabled.12",
)
PARTS = "document_id string, document_name string, content_type string, file_size_bytes long, part_idx int, sheet_name string, text string, error string"


class Rejected(ValueError):
    """An upload that breaks the limits."""


def upload(spark: SparkSession, path: str, most: int = 5) -> DataFrame:
    """Files under a path as (document_id, document_name, content, file_size_bytes, modified); 1 to `most` of them."""
    files = spark.read.format("binaryFile").load(path)
    n = files.select("path").limit(most + 1).count()
    if not 1 <= n <= most:
        raise Rejected(f"1 to {most} files are taken at a time")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.md5(F.concat_ws(":", F.col("path"), F.col("modificationTime").cast("string")).cast("binary")).alias("document_id"), name.alias("document_name"), F.lit(None).cast("string").alias("content_type"), "content", F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified"))


def parse(files: DataFrame) -> DataFrame:
    """One row for each part; a file that cannot be read gives one row with its error and null text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                base = (r.document_id, r.document_name, r.content_type, r.file_size_bytes)
                try:
                    rows += [(*base, i, sheet, text, None) for i, (text, sheet) in enumerate(parts(bytes(r.content), r.document_name or "", r.content_type or ""))]
                except Exception as e:
                    rows.append((*base, 0, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    return files.select("document_id", "document_name", "content_type", "content", "file_size_bytes").mapInPandas(run, PARTS)


def parts(content: bytes, name: str, kind: str) -> list[tuple[str, str | None]]:
    if kind in SHEET_TYPES or name.endswith((".xlsx", ".xls")):
        try:
            return [(f"# {sheet}\n\n{markdown(rows)}", sheet) for sheet, rows in workbook(content) if len(rows) > 1]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            pass  # not a workbook after all: read as text
    if name.lower().endswith(".docx"):
        return [("\n\n".join(docx_paragraphs(content)), None)]
    text = content.decode("utf-8", errors="strict" if not kind.startswith("text/") else "replace")
    if "html" in kind or name.lower().endswith((".html", ".htm")):
        text = html_text(text)
    return [(text, None)]


def markdown(rows: list[list[str]]) -> str:
    """A Markdown table; the first row is the head."""
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join((*(x.replace("|", "\\|").replace("\n", " ") for x in r), *[""] * (width - len(r)))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) if rows and width else ""


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def workbook(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet name, rows of cell texts) of an OOXML workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            out.append((sheet.get("name"), [sheet_row(row, shared) for row in root.iterfind("m:sheetData/m:row", _NS)]))
        return out


def sheet_row(row: ElementTree.Element, shared: list[str]) -> list[str]:
    cells: list[str] = []
    for c in row.iterfind("m:c", _NS):
        letters = re.match("[A-Z]+", c.get("r") or "")
        at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
        cells += [""] * (at - len(cells))
        value = c.findtext("m:v", "", _NS)
        if c.get("t") == "s":
            value = shared[int(value)]
        elif c.get("t") == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
        cells.append(value)
    return cells


def docx_paragraphs(content: bytes) -> list[str]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return [t for p in root.iter(f"{w}p") if (t := "".join(x.text or "" for x in p.iter(f"{w}t")))]


class _Text(HTMLParser):
    """Visible text by blocks; tables as Markdown."""

    SKIP, BLOCK = {"script", "style", "head", "noscript"}, {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ul", "ol", "tr", "table", "nav"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.rows, self.cell = [], 0, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in self.SKIP
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            self.out.append("\n" + markdown([r for r in self.rows if r]) + "\n")
            self.rows = None
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.cell if self.cell is not None else self.out).append(data)


def html_text(page: str) -> str:
    p = _Text()
    p.feed(page)
    p.close()
    return "\n\n".join(x for x in (html.unescape(" ".join(y.split()) if "|" not in y else y.strip()) for y in "".join(p.out).split("\n")) if x)
