"""File scans: inventories, containers, text, tables, office formats, HTML and JSON lines.

Binary formats are parsed a file at a time in ``mapInPandas`` over Spark's binaryFile source, with the standard library
only. PDF text, OCR and legacy office files need outside programs: ``scan_with`` takes the parser as an argument.
"""
from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from textquarry.functions.text import trimmed
from textquarry.session import bounded_batches

SUFFIXES = ("pdf", "docx", "doc", "xlsx", "txt", "md", "html", "htm")
BLOCKS = "path string, block_seq int, source_kind string, style string, text string, warnings array<string>"


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with its suffix, whether it is selected, and why not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    reason = F.when(name.startswith("~$"), "lock file").when(name.startswith("."), "hidden").when(~suffix.isin(*SUFFIXES), "unsupported suffix").otherwise("")
    return files.withColumn("name", name).withColumn("suffix", suffix).withColumn("reason", reason).withColumn("selected", F.col("reason") == "")


def container(content: Column, suffix: Column) -> Column:
    """The parser by magic bytes, by suffix where they say nothing."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "D0CF11E0A1B11AE1", "doc").when(head.startswith("504B"), F.when(suffix == "xlsx", "xlsx").otherwise("docx")).when(head.startswith("25504446"), "pdf").otherwise(suffix)


def binary_files(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    glob = "*.{" + ",".join(suffixes) + "}" if suffixes else "*"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")


def scan_with(files: DataFrame, parser: Callable[[bytes], list[tuple[str, str, str]]]) -> DataFrame:
    """Blocks (kind, style, text) of each file by ``parser``; a file that fails gives one block with a warning."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, k, *b, []) for k, b in enumerate(parser(bytes(content)))]
                except Exception as e:  # noqa: BLE001 one file's failure is its own
                    rows.append((path, 0, "failed", "", "", [f"{type(e).__name__}: {e}"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.mapInPandas(each, BLOCKS)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        out.append((x.text or "") if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "\n" if x.tag == _W + "br" else "")
    return "".join(out).strip()


def parse_docx(content: bytes) -> list[tuple[str, str, str]]:
    """Paragraphs with their style and tables as Markdown, in order; tables of one column become paragraphs."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(_W + "body")
    out: list[tuple[str, str, str]] = []

    def walk(parent: ET.Element) -> None:
        for x in parent:
            if x.tag == _W + "p":
                style = x.find(f"{_W}pPr/{_W}pStyle")
                if text := _text(x):
                    out.append(("paragraph", style.get(_W + "val", "") if style is not None else "", text))
            elif x.tag == _W + "tbl":
                rows = [[" ".join(t for p in c.iter(_W + "p") if (t := _text(p))) for c in r.findall(_W + "tc")] for r in x.findall(_W + "tr")]
                if max(map(len, rows), default=0) <= 1:
                    out.extend(("paragraph", "", c) for r in rows for c in r if c)
                else:
                    out.append(("table", "", markdown(rows)))
            else:
                walk(x)

    walk(body)
    return out


def markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def parse_xlsx(content: bytes) -> list[tuple[str, str, str]]:
    """A heading block a sheet, then its rows without empty ones and trailing blanks."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")]
    names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n[14:])[0]))
    out = []
    for name, part in zip(names, sheets, strict=False):
        out.append(("sheet", "", name))
        for row in ET.fromstring(z.read(part)).iter(_S + "row"):
            cells: list[str] = []
            for c in row.iter(_S + "c"):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                value = c.find(_S + "v")
                inline = "".join(t.text or "" for t in c.iter(_S + "t"))
                text = inline or ("" if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text or "")
                cells += [""] * (at - 1 - len(cells)) + [text]
            while cells and not cells[-1].strip():
                cells.pop()
            if cells:
                out.append(("row", "", "\t".join(cells)))
    return out


class _Texts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_texts(source: str | None) -> list[str]:
    """Every non-blank text node, script and style included."""
    parser = _Texts()
    parser.feed(source or "")
    parser.close()
    return parser.parts


@F.pandas_udf(StringType())
def _text_nodes(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: "\n".join(html_texts(s)))


def html_text_nodes(c) -> Column:
    """The text nodes of a page, a line each. Batches are bounded by bytes, as a page is as long as it likes."""
    bounded_batches(SparkSession.getActiveSession())
    return _text_nodes(c)


def text_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs of text files (path, content), split at blank lines and before Markdown headings."""
    from textquarry.operators.structure import paragraphs

    return files.select("path", F.posexplode(paragraphs(F.col("content").cast("string"))).alias("block_seq", "text"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line is an error if ``strict``, else it is left out."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def embedded_json(c: Column, element_id: str, schema: str) -> Column:
    """The JSON in the script element of that id."""
    return F.from_json(F.regexp_extract(c, rf'(?s)<script[^>]*id="{re.escape(element_id)}"[^>]*>(.*?)</script>', 1), schema)


def markdown_rows(lines: DataFrame, least: int = 2) -> DataFrame:
    """(path, line_no, section, cells) of table rows with ``least`` cells or more; section: the last ## heading."""
    order = Window.partitionBy("path").orderBy("line_no")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), trimmed)
    section = F.last(F.when(F.col("line").rlike(r"^##\s"), F.trim(F.regexp_replace("line", r"^#+\s*", ""))), ignorenulls=True).over(order)
    rows = lines.withColumn("section", section).withColumn("cells", cells)
    return rows.where(F.trim("line").startswith("|") & ~F.trim("line").rlike(r"^\|(?:\s*:?-{2,}:?\s*\|)+$") & (F.size("cells") >= least)).select("path", "line_no", "section", "cells")


def question_bank(lines: DataFrame) -> DataFrame:
    """Questions (section, qid, question, answer, reference) from labelled lines in order."""
    order = Window.partitionBy("path").orderBy("line_no")
    fill = lambda c, p: F.last(F.nullif(F.regexp_extract("line", p, 1), F.lit("")), ignorenulls=True).over(order)
    rows = lines.withColumn("section", fill("section", r"^##\s+(.*)$")).withColumn("qid", fill("qid", r"^(?:###\s*)?(Q\d+)\b"))
    pick = lambda p: F.max(F.nullif(F.regexp_extract("line", p, 1), F.lit("")))
    return rows.where("qid is not null").groupBy("path", "qid").agg(F.min("section").alias("section"), pick(r"^(?:Question|问题)\s*[:：]\s*(.*)$").alias("question"), pick(r"^(?:Answer|答案)\s*[:：]\s*(.*)$").alias("answer"), pick(r"^(?:Reference|依据)\s*[:：]\s*(.*)$").alias("reference"))


def checked_vectors(vectors: DataFrame, dimension: int, vec_col: str = "embedding") -> DataFrame:
    """``vectors``; a row of another size is an error when it is read."""
    size = F.size(vec_col)
    return vectors.where(F.when(size == dimension, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("vector of size "), size.cast("string"))).cast("boolean")))
