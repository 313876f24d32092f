"""Files as rows: format detection, text in several encodings, OOXML members."""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes by document type, first bytes, and the member that an OOXML container must hold.
SUFFIXES = {
    "pdf": ("pdf",), "doc": ("doc",), "docx": ("docx", "docm"), "ppt": ("ppt",), "pptx": ("pptx", "pptm"), "xls": ("xls",), "xlsx": ("xlsx", "xlsm"),
    "txt": ("txt",), "md": ("md",), "html": ("html", "htm"), "image": ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"),
}
PDF_HEAD, OLE_HEAD = "255044462D", "D0CF11E0A1B11AE1"
OOXML_MEMBER = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of every file below a folder; content is read only where it is used.

    Spark's reader has no rows for files of zero length."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def format_of(path: Column) -> Column:
    """The document type of a path's suffix; null if it is none of them."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for kind, names in SUFFIXES.items():
        out = out.when(suffix.isin(*names), kind)
    return out


def detect(files: DataFrame) -> DataFrame:
    """Adds document_type, and problem where the suffix is unknown or contradicts the content (null otherwise).

    First bytes are compared in place; only OOXML containers are opened. Null content counts as empty."""
    kind, head = F.col("document_type"), F.hex(F.substring("content", 1, 8))

    @F.pandas_udf("boolean")
    def has_member(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([_member(OOXML_MEMBER.get(k), c) for k, c in zip(kinds, contents, strict=True)], dtype=bool)

    problem = (
        F.when(kind.isNull(), "unsupported suffix")
        .when((kind == "pdf") & ~F.coalesce(head.startswith(PDF_HEAD), F.lit(False)), "not a PDF")
        .when(kind.isin("doc", "ppt", "xls") & ~F.coalesce(head.startswith(OLE_HEAD), F.lit(False)), "not a legacy Office container")
    )
    typed = files.withColumn("document_type", format_of(F.col("path"))).withColumn("problem", problem)
    opened = F.when(kind.isin(*OOXML_MEMBER), F.col("content"))
    return typed.withColumn("problem", F.when(kind.isin(*OOXML_MEMBER) & ~has_member(kind, opened), "not an OOXML container").otherwise(F.col("problem")))


def _member(name: str | None, content: bytes | None) -> bool:
    if name is None or content is None:
        return False
    try:
        return name in zipfile.ZipFile(io.BytesIO(content)).namelist()
    except zipfile.BadZipFile:
        return False


def decode(content: bytes) -> str:
    """UTF-8 with or without a mark, else UTF-16, else GB 18030, else UTF-8 with replacements."""
    for name in ("utf-8-sig", "utf-16", "gb18030"):
        try:
            return codecs.decode(content, name)
        except UnicodeDecodeError:
            pass
    return codecs.decode(content, "utf-8", "replace")


def texts(files: DataFrame) -> DataFrame:
    """path, text of text files. Null content gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if c is None else decode(c) for c in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def office_blocks(files: DataFrame) -> DataFrame:
    """path, container, ordinal, row, column, text of the OOXML files among files.

    Word: non-empty paragraphs. Slides: one row per non-empty paragraph, the slide's name as container.
    Sheets: one row per cell with a value, shared strings resolved, the member's name as container.
    Broken containers give no rows; ``detect`` names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, *r) for r in _blocks(zipfile.ZipFile(io.BytesIO(content or b"")))]
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                yield pa.RecordBatch.from_pylist([dict(zip(_OFFICE.names, r, strict=True)) for r in rows], schema=_OFFICE)

    return files.where(format_of(F.col("path")).isin(*OOXML_MEMBER)).select("path", "content").mapInArrow(run, "path string, container string, ordinal int, row int, column int, text string")


_OFFICE = pa.schema([("path", pa.string()), ("container", pa.string()), ("ordinal", pa.int32()), ("row", pa.int32()), ("column", pa.int32()), ("text", pa.string())])


def _blocks(archive: zipfile.ZipFile) -> Iterator[tuple]:
    names = sorted(archive.namelist(), key=lambda n: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", n)])
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.findall(".//{*}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(".//{*}si")]
    at = 0
    for name in names:
        stem = posixpath.splitext(posixpath.basename(name))[0]
        if name == "word/document.xml" or re.fullmatch(r"ppt/slides/slide\d+\.xml", name):
            for p in ElementTree.fromstring(archive.read(name)).findall(".//{*}p"):
                text = "".join(t.text or "" for t in p.findall(".//{*}t"))
                if text.strip():
                    yield stem, at, None, None, text
                    at += 1
        elif re.fullmatch(r"xl/worksheets/sheet\d+\.xml", name):
            for c in ElementTree.fromstring(archive.read(name)).findall(".//{*}c"):
                value = c.find("{*}v")
                text = "".join(t.text or "" for t in c.findall(".//{*}t")) if value is None else value.text or ""
                if value is not None and c.get("t") == "s":
                    text = shared[int(text)]
                place = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                if text and place:
                    column = 0
                    for letter in place[1]:
                        column = column * 26 + ord(letter) - 64
                    yield stem, at, int(place[2]), column, text
                    at += 1


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines table; a row that is no object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
