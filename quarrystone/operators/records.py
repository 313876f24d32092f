"""Blocks and records: paragraphs, chunks, table segments, links, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import content_hash


def paragraphs(docs: DataFrame) -> DataFrame:
    """docs: id, text. Runs of lines without a blank one: id, line_start, line_end (from 1), reading_order, body."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("blank", F.trim("line") == "")
    own = Window.partitionBy("id").orderBy("n")
    runs = lines.withColumn("run", F.sum(F.col("blank").cast("int")).over(own)).where("NOT blank")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    out = runs.groupBy("id", "run").agg((F.min("n") + 1).alias("line_start"), (F.max("n") + 1).alias("line_end"), body.alias("body"))
    return out.withColumn("reading_order", F.row_number().over(Window.partitionBy("id").orderBy("run")) - 1).drop("run")


def windows(docs: DataFrame, size: int = 384, overlap: int = 48) -> DataFrame:
    """Overlapping windows of a text, with record ids and links to the neighbours, without a shuffle.

    A text is cut once into steps, in time linear in its length; a window is its step and the beginning of what follows."""
    step = size - overlap
    more = -(-overlap // step)
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    window = lambda steps: F.transform(steps, lambda c, k: F.concat(c, F.substring(F.array_join(F.slice(steps, k + 2, F.lit(more)), ""), 1, overlap)))
    # bound: a column would be cut anew for every window
    bodies = F.get(F.transform(F.array(cut), window), F.lit(0))
    rows = docs.where(F.length("text") > 0).select("id", F.length("text").alias("n"), F.posexplode(bodies).alias("ordinal", "body"))
    rows = rows.select("id", "ordinal", "body", F.floor((F.col("n") - 1) / step).cast("int").alias("last"))
    key = lambda k: content_hash(F.col("id").cast("string"), F.lit("text"), k.cast("string"))
    o = F.col("ordinal")
    return rows.select(
        "id", "ordinal", "body", key(o).alias("record_id"), F.when(o > 0, key(o - 1)).alias("previous_record_id"), F.when(o < F.col("last"), key(o + 1)).alias("next_record_id")
    )


def table_segments(rows: DataFrame, group: str, order: str, columns: list[str], size: int = 20) -> DataFrame:
    """Row batches of a table, each with its header: group, segment, n_rows, body."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    line = F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns])
    cut = rows.select(group, (at / size).cast("int").alias("segment"), at.alias("at"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    head = "Columns: " + " | ".join(columns) + "\n"
    return cut.groupBy(group, "segment").agg(F.count("*").alias("n_rows"), F.concat(F.lit(head), body).alias("body"))


def snapshot_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """key, digest of two states: key, status unchanged, changed, added or removed."""
    a, b = now.select("key", F.col("digest").alias("d1")), before.select("key", F.col("digest").alias("d2"))
    status = F.when(F.col("d2").isNull(), "added").when(F.col("d1").isNull(), "removed").when(F.col("d1") == F.col("d2"), "unchanged").otherwise("changed")
    return a.join(b, "key", "full_outer").select("key", status.alias("status"))


def interleave(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Round robin over groups: the round and place of every row."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(order)))
