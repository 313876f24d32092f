"""Exact dedup by Grace hashing: recursive partitioning to spill files and open-addressing tables.

Equal texts are found by complete content; hashes only choose buckets and slots. Two levels keep a
huge group of copies off any single task: every input partition first folds its own copies, so the
shuffle gets one row per distinct text and partition, and those rows are folded again by content
hash. Where the distinct contents of a task exceed its budget, the table is split over spill files in
the shared folder by the next bits of the hash, and each file is folded in turn.

Null texts count as empty and are equal to empty ones. The row with the largest doc_id stays, a null
doc_id being smaller than any; of rows that tie (same doc_id and text), exactly one is kept. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import file_system, id_text, in_slices, shared_path, stored

BUDGET = 64 << 20
FAN_BITS = 4
SMALLEST = -(1 << 63)


class OpenTable:
    """Open addressing with linear probing; compares complete contents. Holds what was folded for each."""

    def __init__(self, fold: Callable):
        self.fold, self.slots, self.mask = fold, [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list = []
        self.size = 0

    def put(self, h: int, content: bytes, value) -> None:
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                self.values[k] = self.fold(self.values[k], value)
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.size += len(content) + 200
        if 2 * len(self.hashes) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k

    def rows(self) -> Iterator[tuple]:
        return zip(self.hashes, self.contents, self.values, strict=True)


def _unpickled(fs, path: str) -> Iterator[tuple]:
    with fs.open_input_stream(path, buffer_size=1 << 20) as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace_fold(rows: Iterable[tuple], fold: Callable, folder: str, budget: int = BUDGET, level: int = 0) -> Iterator[tuple]:
    """rows: (hash, content, value); yields (hash, content, folded value) once per distinct content."""
    rows, table = iter(rows), OpenTable(fold)
    for row in rows:
        table.put(*row)
        if table.size > budget and level * FAN_BITS < 64 - FAN_BITS and len(table.hashes) > 1:
            break
    else:
        yield from table.rows()
        return
    fs, at = file_system(folder)
    here = f"{at}/{level}-{uuid.uuid4().hex}"
    fs.create_dir(here, recursive=True)
    shift = 64 - FAN_BITS * (level + 1)
    outs = [fs.open_output_stream(f"{here}/{k}", buffer_size=1 << 18) for k in range(1 << FAN_BITS)]
    try:
        for source in (table.rows(), rows):
            for row in source:
                pickle.dump(row, outs[row[0] >> shift & ((1 << FAN_BITS) - 1)], protocol=5)
        del table
        for o in outs:
            o.close()
        for k in range(1 << FAN_BITS):
            yield from grace_fold(_unpickled(fs, f"{here}/{k}"), fold, folder, budget, level + 1)
    finally:
        fs.delete_dir(here)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size_of: Callable = lambda r: 100) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += size_of(r)
        if size > 4 << 20 or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def exact_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spill = shared_path(docs.sparkSession, "grace")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36

        def rows() -> Iterator[tuple]:
            n = base
            for b in in_slices(batches):
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    t = t.encode("utf-8", "surrogatepass")
                    yield xxhash.xxh3_64_intdigest(t), t, [(n, i)]
                    n += 1

        def fold(a: list, b: list) -> list:
            a.extend(b)
            return a

        def out() -> Iterator[tuple]:
            for h, t, members in grace_fold(rows(), fold, spill, budget):
                sha = hashlib.sha256(t).hexdigest()
                lead = max(members, key=lambda m: (SMALLEST if m[1] is None else m[1], -m[0]))
                for m in members:
                    first = m is lead
                    yield m[1], lead[0], first, sha, *((h - (1 << 63), t, lead[1], len(members)) if first else (None, None, None, None))

        yield from _batches(
            out(),
            pa.schema([("doc_id", pa.int64()), ("local", pa.int64()), ("lead", pa.bool_()), ("sha", pa.string()), ("hash", pa.int64()), ("content", pa.binary()), ("top_id", pa.int64()), ("n", pa.int64())]),
            lambda r: 100 + len(r[5] or b""),
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in in_slices(batches):
                for h, t, top, n, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield h + (1 << 63), t, ([own], (SMALLEST if top is None else top, -own), top, n)

        def fold(a: tuple, b: tuple) -> tuple:
            a[0].extend(b[0])
            best = max(a, b, key=lambda x: x[1])
            return a[0], best[1], best[2], a[3] + b[3]

        def out() -> Iterator[tuple]:
            for _, _, (members, key, top, n) in grace_fold(rows(), fold, spill, budget):
                for m in members:
                    yield m, -key[1], top, n

        yield from _batches(out(), pa.schema([("local", pa.int64()), ("winner", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())]))

    rows = stored(
        id_text(docs).mapInArrow(local, "doc_id long, local long, lead boolean, sha string, hash long, content binary, top_id long, n long"),
        "exact",
    )
    leads = rows.where("lead").select("hash", "content", "top_id", "n", "local").repartition("hash")
    merged = leads.mapInArrow(merge, "local long, winner long, keep_id long, group_size long")
    return rows.select("doc_id", "local", "lead", "sha").join(merged, "local").select(
        "doc_id", "keep_id", "group_size", (F.col("lead") & (F.col("local") == F.col("winner"))).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op3_exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return exact_groups(docs)


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
