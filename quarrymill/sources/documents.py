"""Tender documents as sections: text, Markdown, Word files; a parser that fails gives a section that says so."""

from __future__ import annotations

import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "path string, ord int, title string, content string, section_type string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_HEADING = re.compile(r"#{1,6}\s+(.*?)\s*#*\s*$")

Section = tuple[str, str, str]


def parse_text(name: str, data: bytes) -> list[Section]:
    """Markdown is cut at headings outside fenced code; any other text is one section."""
    text = data.decode("utf-8", "replace")
    if not name.lower().endswith((".md", ".markdown")):
        return [(name, text, "text")]
    out: list[tuple[str, list[str]]] = [("", [])]
    fence = None
    for line in text.split("\n"):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if mark and fence is None:
            fence = mark[1]
        elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
            fence = None
        heading = None if fence or mark else _HEADING.match(line)
        if heading:
            out.append((heading[1], []))
        else:
            out[-1][1].append(line)
    made = [(title, "\n".join(lines).strip(), "text") for title, lines in out]
    return [s for s in made if s[0] or s[1]]


def markdown_grid(grid: list[list[str]]) -> str:
    if not grid:
        return ""
    row = lambda r: "| " + " | ".join(c.strip().replace("|", "\\|").replace("\n", " ") for c in r) + " |"
    return "\n".join([row(grid[0]), "|" + " --- |" * len(grid[0]), *map(row, grid[1:])])


def parse_docx(name: str, data: bytes) -> list[Section]:
    """Paragraphs under their heading, tables as Markdown, in the order of the document."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out: list[Section] = []
    title, lines, tables = "", [], 0

    def close() -> None:
        if title or any(lines):
            out.append((title, "\n".join(lines).strip(), "text"))

    for e in body:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and (style.get(f"{_W}val") or "").lower().startswith(("heading", "title")) and text(e).strip():
                close()
                title, lines = text(e).strip(), []
            elif text(e).strip():
                lines.append(text(e).strip())
        elif e.tag == f"{_W}tbl":
            tables += 1
            out.append((f"Table {tables}", markdown_grid([["\n".join(filter(None, map(text, c.iter(f"{_W}p")))) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]), "table"))
    close()
    return out


#: Parsers by suffix. Formats that need further libraries (PDF, spreadsheets) are added here by the user.
PARSERS: dict[str, Callable[[str, bytes], list[Section]]] = {".txt": parse_text, ".md": parse_text, ".markdown": parse_text, ".docx": parse_docx}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def parse(files: DataFrame, parsers: dict[str, Callable[[str, bytes], list[Section]]] | None = None) -> DataFrame:
    """Sections of files (path, content). A suffix without a parser, or a parser that fails, gives a section of type error."""
    by_suffix = parsers or PARSERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                name = os.path.basename(path)
                parser = by_suffix.get(os.path.splitext(name)[1].lower())
                try:
                    found = parser(name, content) if parser else [(name, "Unsupported file type", "error")]
                except Exception as e:  # noqa: BLE001 - a document that can't be read is a row, not a failed job
                    found = [(name, f"{type(e).__name__}: {e}"[:500], "error")]
                out += [(path, i, *s) for i, s in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "ord", "title", "content", "section_type"])

    return files.select("path", "content").mapInPandas(run, SECTIONS)


def unzip(path: str, into: str, suffixes: tuple[str, ...] = (".pdf", ".docx", ".xlsx", ".txt", ".md")) -> list[str]:
    """Documents of an archive, flat; a name that is taken gets a number."""
    out = []
    with zipfile.ZipFile(path) as z:
        for member in z.namelist():
            base, suffix = os.path.splitext(os.path.basename(member))
            if member.endswith("/") or suffix.lower() not in suffixes:
                continue
            target, n = os.path.join(into, base + suffix), 1
            while os.path.exists(target):
                target, n = os.path.join(into, f"{base}_{n}{suffix}"), n + 1
            with open(target, "wb") as f:
                f.write(z.read(member))
            out.append(target)
    return out


# Names of documents that hold no content, and those of them that count if they are large.
TRIFLES = [
    r"bid\s*form", r"price\s*sheet", r"signature\s*page", r"cover\s*page", r"payment\s*form", r"submittal\s*form", r"draft", r"old", r"previous", r"superseded",
]
PRICE_LISTS = [r"clin\s*pricing\s*list", r"pricing\s*list\s*only"]


def relevant(files: DataFrame, least: int = 50_000, large: int = 500_000) -> DataFrame:
    """Documents of a known kind that are large enough and not named as trifles; price lists only if they are large.
    If nothing is left, the largest PDF."""
    name, size = F.lower(F.element_at(F.split("path", "/"), -1)), F.col("length")

    def named(patterns: list[str]) -> Column:
        return name.rlike("|".join(patterns))

    known = F.element_at(F.split(name, r"\."), -1).isin("pdf", "docx", "doc")
    good = files.where(known & (size >= least) & ~named(TRIFLES) & (~named(PRICE_LISTS) | (size > large)))
    if good.isEmpty():
        return files.orderBy(name.endswith(".pdf").desc(), F.desc("length")).limit(1)
    return good


def type_histogram(classified: DataFrame) -> DataFrame:
    return classified.groupBy("doc_type").agg(F.count("*").alias("n"))


def read_run(spark: SparkSession, root: str, name: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A table of a stored run as it is now, some of its columns, some of its rows; both reach the scan."""
    from .store import Store

    df = Store(spark, root).read(name)
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit else df
