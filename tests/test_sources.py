"""Files, snapshots and streams, on small folders of their own."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import files, snapshots
from quarrystone.streaming import ingest


def container(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


WORD = {"word/document.xml": '<d xmlns:w="u"><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:t>Two</w:t></w:p></d>'}
SHEET = {
    "xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": '<s xmlns="u"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></s>',
    "xl/worksheets/sheet1.xml": '<s xmlns="u"><row><c r="A1" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c><c r="B2"><v>7</v></c><c r="C2"/></row></s>',
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    content = {
        "a.txt": "eins\nzwei\n\ndrei".encode(), "b.TXT": "﻿mark".encode(), "c.md": "wide".encode("utf-16"), "d.txt": "汉字。".encode("gb18030") + b"!", "e.pdf": b"%PDF-1.7", "f.pdf": b"no",
        "g.docx": container(WORD), "h.xlsx": container(SHEET), "i.docx": container(SHEET), "j.pptx": b"broken", "k.doc": bytes.fromhex("D0CF11E0A1B11AE100"), "l.xls": b"x", "m.exe": b"x",
    }
    for name, data in content.items():
        (d / name).write_bytes(data)
    return str(d)


def names(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def test_detect(spark, folder):
    got = {k: (r.document_type, r.problem) for k, r in names(files.detect(files.read_files(spark, folder)).drop("content").collect()).items()}
    bad = "not an OOXML container"
    assert got == {
        "a.txt": ("txt", None), "b.TXT": ("txt", None), "c.md": ("md", None), "d.txt": ("txt", None), "e.pdf": ("pdf", None), "f.pdf": ("pdf", "not a PDF"), "g.docx": ("docx", None), "h.xlsx": ("xlsx", None),
        "i.docx": ("docx", bad), "j.pptx": ("pptx", bad), "k.doc": ("doc", None), "l.xls": ("xls", "not a legacy Office container"), "m.exe": (None, "unsupported suffix"),
    }


def test_texts(spark, folder):
    got = names(files.texts(files.read_files(spark, folder).where(files.format_of(F.col("path")).isin("txt", "md"))).collect())
    assert {k: r.text for k, r in got.items()} == {"a.txt": "eins\nzwei\n\ndrei", "b.TXT": "mark", "c.md": "wide", "d.txt": "汉字。!"}
    assert files.decode(b"\xff\xff\xff") == "�" * 3


def test_office_blocks(spark, folder):
    got = sorted((r.path[-6:], r.container, r.ordinal, r.row, r.column, r.text) for r in files.office_blocks(files.read_files(spark, folder)).collect())
    sheet = lambda name: [(name, "sheet1", 0, 1, 1, "name"), (name, "sheet1", 1, 2, 28, "ab"), (name, "sheet1", 2, 2, 2, "7")]
    assert got == [("g.docx", "document", 0, None, None, "One line"), ("g.docx", "document", 1, None, None, "Two"), *sheet("h.xlsx"), *sheet("i.docx")]


def test_json_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.json_rows(spark, str(tmp_path / "x.jsonl"), "a long").orderBy("a").collect()] == [1, 2]
    (tmp_path / "y.jsonl").write_text("[1\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_rows(spark, str(tmp_path / "y.jsonl"), "a long").collect()


def test_snapshots(spark, tmp_path):
    schema = "record_id string, document_id string, modality string, previous_record_id string, next_record_id string"
    good = spark.createDataFrame([("a", "d", "text", None, "b"), ("b", "d", "text", "a", None), ("c", "d", "table", None, None)], schema)
    root = str(tmp_path)
    first = snapshots.publish(good, root, {"model": "m"})
    manifest, records = snapshots.load(spark, root)
    assert manifest == {"schema_version": "2.0", "build_id": first, "counts": {"text": 2, "table": 1}, "model": "m"} and records.count() == 3
    with pytest.raises(ValueError, match="not valid"):
        snapshots.publish(good.where("record_id <> 'b'"), root)
    assert snapshots.load(spark, root)[0]["build_id"] == first and [p.name for p in (tmp_path / "snapshots").iterdir()] == [first]
    second = snapshots.publish(good.where("modality = 'table'"), root)
    assert snapshots.load(spark, root)[0]["build_id"] == second


def test_ingest_folder(spark, folder, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        ingest.ingest_folder(spark, folder, target, checkpoint).awaitTermination()
    got = [(r.id[-5:], r.line_start, r.body) for r in spark.read.parquet(target).orderBy("id", "line_start").collect()]
    assert got == [("a.txt", 1, "eins\nzwei"), ("a.txt", 4, "drei"), ("b.TXT", 1, "mark"), ("/c.md", 1, "wide"), ("d.txt", 1, "汉字。!")]


def test_windowed_counts(spark):
    at = datetime.datetime(2024, 1, 1, 10, 30)
    events = spark.createDataFrame([(at, "x", 1.0), (at, "x", None), (None, "x", 3.0)], "ts timestamp, event_type string, value double")
    got = ingest.windowed_counts(events).collect()
    assert [(r.event_type, r.n, r.total) for r in got] == [("x", 2, 1.0)]
