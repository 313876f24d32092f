"""Blocks to records of bounded size: texts packed under their titles, tables in bands of columns and rows.

Blocks are put in order, titled and split by Spark's own operators; what goes into a record depends on what the one before took,
so the pieces of one document are packed in one call, one after another. Documents are dealt over all tasks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.answers import bounded_text, collapsed, container_key, content_text, heading_level, normal_table, table_text  # noqa: F401
from quarrystone.functions.text import content_hash
from quarrystone.operators.structure import split_long, title_paths


@dataclass(frozen=True)
class Sizes:
    """Characters of a record that are aimed at, at most, and repeated; rows and columns of a table record."""

    target: int = 256
    most: int = 384
    overlap: int = 48
    rows: int = 20
    columns: int = 12


def text_pieces(blocks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """blocks: document_id, block_id, reading_order, text, level, label, sheet, slide, page -> the same with titles, container, at and piece: blank
    blocks go, headings open titles, long texts are split."""
    t = blocks.where(F.col("text").rlike(r"\S")).withColumn("text", collapsed(F.col("text"))).withColumn("level", heading_level(F.col("text"), F.col("level"), F.col("label"), clean=True))
    titled = title_paths(t.withColumnsRenamed({"document_id": "id", "reading_order": "ordinal", "text": "title"}), levels=9)
    titled = titled.withColumnsRenamed({"id": "document_id", "ordinal": "reading_order", "title": "text", "path": "titles"}).withColumn("container", container_key(F.col("sheet"), F.col("slide"), F.col("page")))
    return titled.select("document_id", "block_id", "reading_order", "titles", "container", F.posexplode(split_long(F.col("text"), sizes.most, sizes.overlap)).alias("at", "piece"))


def packed(pieces: list[dict], sizes: Sizes) -> Iterator[tuple[list[str], list[str], str, str]]:
    """Records of a document's pieces in order: block ids, titles, repeated text, body. Title and container changes end a record and its repetition."""
    for (titles, _), section in groupby(pieces, key=lambda p: (tuple(p["titles"]), p["container"])):
        repeated, open_ = "", []

        def length(*more: str) -> int:
            return len("\n".join([*titles, repeated, *(p["piece"] for p in open_), *more]).strip())

        def close() -> tuple:
            body = "\n".join(p["piece"] for p in open_)
            return list(dict.fromkeys(p["block_id"] for p in open_)), list(titles), repeated, body

        for p in section:
            if open_ and length(p["piece"]) > sizes.target:
                yield (done := close())
                repeated, open_ = done[3][-sizes.overlap :] if sizes.overlap else "", []
            open_.append(p)
            if length() >= sizes.most:
                yield (done := close())
                repeated, open_ = done[3][-sizes.overlap :] if sizes.overlap else "", []
        if open_:
            yield close()


def text_records(blocks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """document_id, ordinal, record_id, previous_record_id, next_record_id, block_ids, titles, overlap, body, embedding_text, content_hash.

    A document's records are made in one call, which also names them and links them, so that they are not shuffled again. Empty and null texts give no record; a document without any has none."""
    order = F.array_sort(F.collect_list(F.struct("reading_order", "at", "block_id", "titles", "container", "piece")))
    rows = text_pieces(blocks, sizes).groupBy("document_id").agg(order.alias("pieces"))
    kind = rows.schema["document_id"].dataType.simpleString()
    names = ["document_id", "ordinal", "record_id", "previous_record_id", "next_record_id", "block_ids", "titles", "overlap", "body", "content_hash"]
    strings = pa.list_(pa.string())
    schema = [pa.int32(), pa.string(), pa.string(), pa.string(), strings, strings, pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                lists, own, columns = b.column("pieces"), [], [[] for _ in schema]
                flat = lists.flatten()
                parts = zip(*(flat.field(n).to_pylist() for n in ("titles", "container", "piece", "block_id")), strict=True)
                pieces = [{"titles": t, "container": c, "piece": p, "block_id": i} for t, c, p, i in parts]
                edges = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
                for k, name in enumerate(b.column("name").to_pylist()):
                    found = list(packed(pieces[edges[k] : edges[k + 1]], sizes))
                    hashes = [record_hash(overlap, body, titles) for _, titles, overlap, body in found]
                    ids = [_sha256("\0".join([*([] if name is None else [name]), "text", "\0".join(x for x in f[0] if x is not None), str(n), h])) for n, (f, h) in enumerate(zip(found, hashes, strict=True))]
                    rows = [range(len(found)), ids, [None, *ids][: len(ids)], [*ids[1:], None][: len(ids)], *(zip(*found, strict=True) if found else [()] * 4), hashes]
                    own += [k] * len(found)
                    for column, more in zip(columns, rows, strict=True):
                        column += more
                yield pa.RecordBatch.from_arrays([b.column("document_id").take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, schema, strict=True))], names=names)

    rows = rows.select("document_id", F.col("document_id").cast("string").alias("name"), "pieces")
    out = rows.mapInArrow(run, f"document_id {kind}, ordinal int, record_id string, previous_record_id string, next_record_id string, block_ids array<string>, titles array<string>, overlap string, body string, content_hash string")
    return out.withColumn("embedding_text", bounded_text(F.col("titles"), F.col("overlap"), F.col("body"), sizes.most))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: How to_json writes the characters that cannot stand for themselves.
_ESCAPED = {chr(k): f"\\u{k:04X}" for k in range(32)} | {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_SPECIAL = re.compile(r'["\\\x00-\x1f]')


def record_hash(overlap: str, body: str, titles: list[str]) -> str:
    """SHA-256 of the record as to_json writes it: overlap_text, text, title_path."""
    said = lambda x: '"' + _SPECIAL.sub(lambda m: _ESCAPED[m[0]], x) + '"'
    return _sha256(f'{{"overlap_text":{said(overlap)},"text":{said(body)},"title_path":[{",".join(map(said, titles))}]}}')


def _text(title: str, headers: list[str], rows: list[list[str]], place: str) -> str:
    lines = [f"Table: {title}"] if title else []
    lines += ["Columns: " + " | ".join(headers), *("Row: " + " | ".join(r) for r in rows)]
    return "\n".join([*lines, f"Source: {place}"] if place else lines)


def _column_groups(n: int, sizes: Sizes) -> list[list[int]]:
    wide = sizes.columns - 1
    return [list(range(n))] if n <= sizes.columns else [[0, *range(k, min(k + wide, n))] for k in range(1, n, wide)]


def _halves(columns: list[int]) -> list[list[int]]:
    half = 1 + max((len(columns) - 1) // 2, 1)
    return [columns[:half], [columns[0], *columns[half:]]]


def bands(title: str, headers: list[str], rows: list[list[str]], place: str, sizes: Sizes) -> Iterator[tuple[list[int], int, list[list[str]]]]:
    """Column numbers, first row and rows of a table's records: the first column stands in every band, bands whose single rows
    are too long are halved, rows are added while they fit."""
    n = len(headers)
    groups = _column_groups(n, sizes)
    while groups:
        columns = groups.pop(0)
        cut = lambda r: [r[k] for k in columns]
        fits = lambda rs: len(_text(title, cut(headers), [cut(r) for r in rs], place)) <= sizes.most
        if len(columns) > 2 and not all(fits([r]) for r in rows):
            groups[:0] = _halves(columns)
            continue
        start = 0
        while start < max(len(rows), 1):
            stop = start + 1
            while stop < len(rows) and stop - start < sizes.rows and fits(rows[start : stop + 1]):
                stop += 1
            yield columns, start, [cut(r) for r in rows[start:stop]]
            start = stop


def table_records(tables: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """tables: document_id, block_id, reading_order, matrix (array of rows of cells, null if there is none), raw, native, title, place
    -> document_id, block_id, ordinal, title, columns, headers, rows, row_start, row_end, embedding_text.

    Tables without a matrix have one record with the raw text under the header raw_content. A band whose text is longer than a
    record keeps its rows whole; its embedding text is cut into several records (segment) that repeat the header."""
    t = normal_table(F.col("matrix"), F.coalesce("native", F.lit(False)))
    rows = tables.withColumn("t", t).select(
        "document_id", "block_id", "reading_order", collapsed(F.coalesce(F.nullif("title", F.lit("")), F.col("t.title"), F.lit(""))).alias("title"), F.coalesce("place", F.lit("")).alias("place"),
        F.coalesce("t.headers", F.array(F.lit("raw_content"))).alias("headers"), F.coalesce("t.rows", F.array(F.array(collapsed(F.coalesce("raw", F.lit("")))))).alias("rows"),
    )
    kind = rows.schema["document_id"].dataType.simpleString()
    strings = pa.list_(pa.string())
    schema = pa.schema([("block_id", pa.string()), ("reading_order", pa.int64()), ("at", pa.int32()), ("title", pa.string()), ("place", pa.string()), ("columns", pa.list_(pa.int32())), ("headers", strings), ("rows", pa.list_(strings)), ("row_start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = {n: b.column(n)[k].as_py() for n in b.schema.names}
                made = []
                for at, (columns, start, own) in enumerate(bands(x["title"], x["headers"], x["rows"], x["place"], sizes)):
                    made.append({"block_id": x["block_id"], "reading_order": x["reading_order"], "at": at, "title": x["title"], "place": x["place"], "columns": columns, "headers": [x["headers"][c] for c in columns], "rows": own, "row_start": start})
                part = pa.RecordBatch.from_pylist(made, schema)
                own = pa.array([x["document_id"]] * len(made), b.schema.field("document_id").type)
                yield pa.RecordBatch.from_arrays([own, *part.columns], names=["document_id", *schema.names])

    out = rows.mapInArrow(run, f"document_id {kind}, block_id string, reading_order long, at int, title string, place string, columns array<int>, headers array<string>, rows array<array<string>>, row_start int")
    return _numbered(_segments(out, sizes), ["reading_order", "block_id", "at"]).drop("at", "reading_order")


def _segments(records: DataFrame, sizes: Sizes) -> DataFrame:
    """records: title, headers, rows, place, row_start and more -> row_end, segment and embedding_text as well; place goes."""
    whole = table_text(F.col("title"), F.col("headers"), F.col("rows"), F.col("place"))
    head = table_text(F.col("title"), F.col("headers"), F.filter("rows", lambda _: F.lit(False)), F.col("place"))
    head = F.when(F.length(head) > sizes.most - 3, F.substring(head, 1, sizes.most // 2)).otherwise(head)
    out = records.withColumn("whole", whole).withColumn("head", head)
    # what does not fit beside the header is cut into windows of what does
    body, room = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("Row: "), F.array_join(r, " | "))), "\n"), sizes.most - F.length("head") - 1
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.greatest(room - F.least(F.lit(sizes.overlap), room - 1), F.lit(1))), lambda k: F.concat(F.col("head"), F.lit("\n"), F.substring(body, k + 1, room)))
    pieces = F.when(F.length("whole") <= sizes.most, F.array("whole")).otherwise(windows)
    kept = [c for c in records.columns if c not in ("place", "row_start")]
    return out.select(*kept, "row_start", (F.col("row_start") + F.size("rows") - 1).alias("row_end"), F.posexplode(pieces).alias("segment", "embedding_text"))


def _numbered(segments: DataFrame, order: list[str]) -> DataFrame:
    from pyspark.sql import Window

    return segments.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy(*order, "segment")) - 1)


def table_row_records(rows: DataFrame, headers: list[str], title: str = "", place: str = "", sizes: Sizes = Sizes(), derived: dict[str, Column] | None = None) -> DataFrame:
    """rows: document_id, cells (as many as headers; null: empty) -> document_id, ordinal, headers, row_start, row_end, segment and the derived
    columns, which can name title, columns, headers, rows and embedding_text (its default).

    As table_records() of one table a document, without native names, whose matrix has the headers and then the rows in the order of their cells. The headers
    are two at least and not blank. A table is never held as a whole: its rows come sorted, after one row that has the length of its longest row in
    every band of columns that can be tried, and the rows of open records are kept. The numbers are dealt last, over the derived columns only."""
    n, todo, tried = len(headers), _column_groups(len(headers), sizes), []
    while todo:
        columns = todo.pop()
        tried.append(columns)
        todo += _halves(columns) if len(columns) > 2 else []
    long = lambda columns: F.max(sum((F.length(F.col("cells")[c]) for c in columns[1:]), F.length(F.col("cells")[columns[0]])))
    clean = rows.select("document_id", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("cells"))
    first = clean.groupBy("document_id").agg(F.array(*map(long, tried)).alias("longest")).select("document_id", F.lit(0).alias("kind"), F.lit(None).cast("array<string>").alias("cells"), "longest")
    both = clean.select("document_id", F.lit(1).alias("kind"), "cells", F.lit(None).cast("array<int>").alias("longest")).unionByName(first)
    placed = both.repartition("document_id").sortWithinPartitions("document_id", "kind", "cells")
    heads = [len(_text(title, [headers[c] for c in columns], [], place)) for columns in tried]
    extra = lambda columns: 3 * (len(columns) - 1) + len("Row: ") + 1

    def groups_of(longest: list[int]) -> list[list[int]]:
        left, out = _column_groups(n, sizes), []
        while left:
            columns = left.pop(0)
            k = tried.index(columns)
            if len(columns) > 2 and heads[k] + extra(columns) + longest[k] > sizes.most:
                left[:0] = _halves(columns)
            else:
                out.append(columns)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for b in batches:
            ids, kinds = b.column(0), b.column(1).to_numpy()
            starts = np.flatnonzero(kinds == 0).tolist()
            for at, stop in zip([0, *starts], [*starts, b.num_rows], strict=True):
                if at < stop and kinds[at] == 0:
                    open_ = _OpenTable(ids.slice(at, 1), groups_of(b.column(3)[at].as_py()), [headers, title, place], sizes)
                    at += 1
                if stop > at:
                    yield from open_.add(b.column(2).slice(at, stop - at))
                if stop < b.num_rows and open_ is not None:
                    yield from open_.close()
                    open_ = None
        if open_ is not None:
            yield from open_.close()

    kind = rows.schema["document_id"].dataType.simpleString()
    out = placed.mapInArrow(run, f"document_id {kind}, band int, at int, columns array<int>, headers array<string>, rows array<array<string>>, row_start int")
    cut = _segments(out.withColumn("title", F.lit(title)).withColumn("place", F.lit(place)), sizes)
    derived = {"embedding_text": F.col("embedding_text")} if derived is None else derived
    slim = cut.select("document_id", "band", "at", "headers", "row_start", "row_end", "segment", *[c.alias(k) for k, c in derived.items()])
    return _numbered(slim, ["band", "at"]).drop("band", "at")


class _OpenTable:
    """A table whose rows come in pieces: the rows of records that are not full, and where those records begin, by band of columns."""

    def __init__(self, document: pa.Array, groups: list[list[int]], said: list, sizes: Sizes):
        self.document, self.groups, self.sizes, self.names = document, groups, sizes, said[0]
        self.head = [len(_text(said[1], [said[0][c] for c in g], [], said[2])) for g in groups]
        self.held, self.base, self.blank, self.any = None, 0, None, False
        self.open = [(0, h, 0) for h in self.head]  # first row, length, records before

    def add(self, cells: pa.Array) -> Iterator[pa.RecordBatch]:
        """Blank rows wait for one that is not: those at the end are no rows."""
        cells = cells if self.blank is None else pa.concat_arrays([self.blank, cells])
        wide = len(self.names)
        filled = np.flatnonzero(pc.not_equal(pc.utf8_trim(cells.flatten(), " "), "").to_numpy(zero_copy_only=False).reshape(-1, wide).any(1))
        n = int(filled[-1]) + 1 if len(filled) else 0
        self.blank = cells.slice(n) if n < len(cells) else None
        if n:
            yield from self._rows(cells.slice(0, n))

    def _rows(self, cells: pa.Array) -> Iterator[pa.RecordBatch]:
        old = 0 if self.held is None else len(self.held)
        rows = cells if self.held is None else pa.concat_arrays([self.held, cells])
        flat, wide = rows.flatten(), len(self.names)
        lengths = pc.utf8_length(flat).to_numpy().reshape(-1, wide)
        for g, columns in enumerate(self.groups):
            start, length, done = self.open[g]
            starts, own = [], lengths[old:, columns].sum(1) + 3 * (len(columns) - 1) + len("Row: ") + 1
            for k, more in enumerate(own.tolist(), self.base + old):
                if k > start and (k - start >= self.sizes.rows or length + more > self.sizes.most):
                    starts.append(start)
                    start, length = k, self.head[g]
                length += more
            if starts:
                yield self._batch(g, done, np.array([*starts, start]), flat)
            self.open[g] = (start, length, done + len(starts))
        first = min(s for s, _, _ in self.open)
        self.held, self.base, self.any = rows.slice(first - self.base), first, True

    def close(self) -> Iterator[pa.RecordBatch]:
        flat, end = (pa.array([], pa.string()), 0) if self.held is None else (self.held.flatten(), self.base + len(self.held))
        for g, (start, _, done) in enumerate(self.open):
            yield self._batch(g, done, np.array([start, end]), flat)

    def _batch(self, g: int, done: int, edges: np.ndarray, flat: pa.Array) -> pa.RecordBatch:
        columns, count = self.groups[g], len(edges) - 1
        rows = np.arange(edges[0], edges[-1]) - self.base
        cells = flat.take(pa.array((rows[:, None] * len(self.names) + np.array(columns)).ravel(), pa.int64()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(columns), pa.int32()), cells)
        own = {
            "document_id": self.document.take(pa.array(np.zeros(count, np.int64))), "band": pa.array(np.full(count, g, np.int32)), "at": pa.array(np.arange(done, done + count, dtype=np.int32)), "columns": pa.array([columns] * count, pa.list_(pa.int32())),
            "headers": pa.array([[self.names[c] for c in columns]] * count, pa.list_(pa.string())), "rows": pa.ListArray.from_arrays(pa.array(edges - edges[0], pa.int32()), lists), "row_start": pa.array(edges[:-1].astype(np.int32)),
        }
        return pa.RecordBatch.from_arrays(list(own.values()), names=list(own))


def visual_records(visuals: DataFrame) -> DataFrame:
    """visuals: document_id, block_id, ordinal, sha256, context, visual_type, coarse_only -> one record each, with its id and hash; coarse ones are no evidence for a model."""
    context = F.coalesce("context", F.lit(""))
    digest = F.sha2(F.to_json(F.struct(context.alias("context"), "sha256", "visual_type")), 256)
    rows = visuals.withColumn("content_hash", digest).withColumn("embedding_text", context).withColumn("llm_eligible", ~F.coalesce("coarse_only", F.lit(False)))
    return rows.withColumn("record_id", content_hash(F.col("document_id").cast("string"), F.lit("visual"), F.col("block_id"), F.col("ordinal").cast("string"), F.col("content_hash")))


def canonical_hash(value) -> str:
    """SHA-256 of a value as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
