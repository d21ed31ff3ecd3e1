"""Readers of filings, Markdown, chunks, reports and web pages."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.sources.markup import ERRORS, parsed

FILING = "corp_code string, corp_name string, stock_code string, rcept_no string, rcept_dt string, report_nm string"
METADATA = (
    "corp_name string, document_name string, rcept_dt string, doc_type string, data_category string, fiscal_year int, keywords array<string>, token_count int, merged_count int, "
    "split_index int, total_splits int, chunk_size int, prev_context string, next_context string, oversized_split boolean, oversized_index int, oversized_total int"
)
CHUNK = f"chunk_id string, doc_id string, chunk_type string, section_path string, natural_text string, structured_data map<string,string>, metadata struct<{METADATA.replace(' ', ':').replace(',:', ', ')}>"


def filing_lists(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all filing lists (JSON objects with a ``list``), with their file and place."""
    schema = f"total_count int, download_date string, list array<struct<{FILING.replace(' string', ':string')}>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    return raw.select("file", F.posexplode("list").alias("seq", "f")).select("file", "seq", "f.*")


def latest_dated(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows of the file with the largest ``YYYYMMDD.json`` name."""
    dated = df.withColumn("_day", F.regexp_extract(file, r"^(\d{8})\.json$", 1)).where("_day <> ''")
    last = dated.agg(F.max("_day").alias("_day"))
    return dated.join(F.broadcast(last), "_day").drop("_day")


def filing_windows(spark: SparkSession, end: str, kinds: list[str], *, windows: int = 4, days: int = 90) -> DataFrame:
    """(kind, start, end) of back-to-back date windows for each report kind."""
    frame = spark.range(windows).select(F.date_sub(F.to_date(F.lit(end)), (F.col("id") * days).cast("int")).alias("end"))
    return frame.select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), F.date_sub("end", days - 1).alias("start"), "end")


def unzip(archives: DataFrame) -> DataFrame:
    """(path, name, content) of the files in ``binaryFile`` rows of ZIP archives; broken archives give a null name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    rows = [(path, None, None)]
                yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return archives.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def jsonl_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all ``*_chunks.jsonl`` files; broken lines are left out."""
    return spark.read.schema(CHUNK).option("mode", "DROPMALFORMED").json(path, pathGlobFilter="*_chunks.jsonl")


def csv_reports(spark: SparkSession, path: str) -> DataFrame:
    """Quoted multi-line CSV with a header, all columns text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def rows_as_documents(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One ``column: value`` line per column of each row."""
    return df.select("*", F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns or df.columns]).alias("document"))


def listed_names(spark: SparkSession, path: str, header: str = "종목명") -> DataFrame:
    """First column of tab- or blank-aligned lines, without header, byte-order mark and empty lines."""
    name = F.trim(F.regexp_extract(F.replace("value", F.lit("﻿"), F.lit("")), r"^(.*?)(?:\t|\s{2,}|$)", 1))
    return spark.read.text(path).select(name.alias("name")).where((F.col("name") != "") & (F.col("name") != header))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set (JSON array); ``company_name`` may be text or a list and becomes a list."""
    schema = "query_id string, query string, query_type string, company_name string, expected_keywords array<string>, expected_docs array<string>, ground_truth_answer string, ground_truth_sections array<string>, difficulty string, requires_multi_doc boolean, requires_calculation boolean"
    c = F.col("company_name")
    listed = F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c))
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("company_name", listed)


def markdown_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, front, body) of whole Markdown files; ``front`` maps the keys of the ``---`` block."""
    return front_matter(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def front_matter(df: DataFrame, text: str = "value") -> DataFrame:
    """Splits a leading ``---`` block of ``key: value`` lines from the body."""
    block = r"(?s)^---\n(.*?)\n---\n?"
    lines = F.filter(F.split(F.regexp_extract(text, block, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return df.withColumn("front", F.map_from_entries(pairs)).withColumn("body", F.regexp_replace(text, block, "")).drop(text)


def lines(df: DataFrame, text: str = "body") -> DataFrame:
    """One row per line with its number from 0."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


class _Tables(HTMLParser):
    """Rows of cells of the tables of a page, merged cells spread over their span."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th", "te", "tu") and self.tables and self.tables[-1]:
            a = dict(attrs)
            self.cell, self.span = [], tuple(int(a.get(k) or 1) if str(a.get(k) or 1).isdigit() else 1 for k in ("rowspan", "colspan"))

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "te", "tu") and self.cell is not None:
            self.tables[-1][-1].append((" ".join("".join(self.cell).split()), *self.span))
            self.cell = None


def spread(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """A grid in which each merged cell's text fills all its places."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for text, down, across in row:
            while c in grid[r]:
                c += 1
            for i in range(r, min(r + max(1, down), len(rows))):
                for j in range(c, c + max(1, across)):
                    grid[i].setdefault(j, text)
            c += max(1, across)
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(j, "") for j in range(width)] for g in grid]


def page_tables(html: str) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(html or "")
    return [spread(t) for t in parser.tables if t]


def html_tables(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells) of the tables in pages, merged cells spread."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t, r, cells) for k, h in zip(pdf[key], pdf[html], strict=True) for t, table in enumerate(page_tables(h)) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=[key, "table_no", "row_no", "cells"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, table_no int, row_no int, cells array<string>")


def page_facts(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """title, language and number of links of each page, without parsing."""
    return pages.withColumns(
        {
            "title": F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
            "html_lang": F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang=["']?([a-zA-Z-]+)""", 1)),
            "n_links": F.regexp_count(html, F.lit(r"(?i)<a\s")),
        }
    )


def xml_markdown(xml: str) -> tuple[str, list[tuple[str, int, str]]]:
    """A filing's XML as Markdown (sections as headings, paragraphs, tables), and (kind, place, near text) of what was wrong with it.

    Table groups of layout tables (no border, or inside LIBRARY) become lines.
    A file that is not well-formed is recovered: see :mod:`brinework.sources.markup`.
    Text outside paragraphs, titles and tables is left out, but for a file without any of them.
    """
    root, errors = parsed(xml)
    out: list[str] = []

    def text(e: ET.Element) -> str:
        return " ".join("".join(e.itertext()).split())

    def visit(e: ET.Element, depth: int, layout: bool) -> None:
        tag = e.tag.upper()
        if tag == "TITLE":
            out.append(f"{'#' * max(1, depth)} {text(e)}")
        elif tag == "P":
            if body := text(e):
                out.append(body)
        elif tag == "TABLE":
            trs = [tr for tr in e.iter() if tr.tag.upper() == "TR"]
            grid = spread([[(text(c).replace("|", "\\|"), number(c, "ROWSPAN"), number(c, "COLSPAN")) for c in tr if c.tag.upper() in ("TD", "TH", "TE", "TU")] for tr in trs])
            if layout or e.get("BORDER") == "0":
                out.extend(line for row in grid if (line := " ".join(dict.fromkeys(c for c in row if c))))
            elif grid:
                marks = ["---"] * len(grid[0])
                out.append("\n".join("| " + " | ".join(row) + " |" for row in [grid[0], marks, *grid[1:]]))
        else:
            inner = depth + tag.startswith("SECTION-")
            for child in e:
                visit(child, inner, layout or tag == "LIBRARY")

    def number(cell: ET.Element, name: str) -> int:
        value = cell.get(name) or "1"
        return int(value) if value.isdigit() else 1

    visit(root, 0, False)
    body = "\n\n".join(out) or text(root)
    return body, [(e.what, e.at, xml[e.at : e.at + 40]) for e in errors]


def filing_documents(files: DataFrame, filings: DataFrame, *, name: str = "name", xml: str = "xml") -> DataFrame:
    """XML files as Markdown with the facts of their filing (by the receipt number before ``_``); unlisted files keep nulls.

    ``errors`` lists what was wrong with a file (empty for a well-formed one); its
    text is recovered.  Only a null file has a null body.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [xml_markdown(x) if isinstance(x, str) else (None, []) for x in pdf[xml]]
            errors = [[dict(zip(("kind", "at", "what"), e, strict=True)) for e in found] for _, found in read]
            yield pd.DataFrame({"name": pdf[name], "rcept_no": [n.split("_")[0].split(".")[0] for n in pdf[name]], "body": [b for b, _ in read], "errors": errors})

    from brinework.operators.dedupe import keep_latest

    texts = files.select(name, xml).mapInPandas(run, f"name string, rcept_no string, body string, errors {ERRORS}")
    facts = keep_latest(filings.withColumn("_seq", F.col("seq")), ["rcept_no"], ["_seq"]).drop("_seq", "seq", "file")
    return texts.join(facts, "rcept_no", "left")


def dated_after(c: str | Column, day: str = "2025-01-01", form: str = "yyyy.MM.dd") -> Column:
    """Whether a text date lies on or after the day; unreadable dates don't."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.to_date(F.try_to_timestamp(col, F.lit(form))) >= F.to_date(F.lit(day)), F.lit(False))
