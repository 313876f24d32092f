"""Summaries of documents, pages, turns and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_windows(turns: DataFrame, back: int = 1, ahead: int = 2) -> DataFrame:
    """turns: id, turn, text -> id, turn, previous, next, body: the turns around each, joined by lines."""
    own = Window.partitionBy("id").orderBy("turn")
    return turns.select("id", "turn", F.lag("turn").over(own).alias("previous"), F.lead("turn").over(own).alias("next"), F.array_join(F.collect_list("text").over(own.rowsBetween(-back, ahead)), "\n").alias("body"))


def nearest_marked(rows: DataFrame, marked: Column) -> DataFrame:
    """rows: id, turn. Of each row the nearest marked turns before and after it, at any distance."""
    own = Window.partitionBy("id").orderBy("turn")
    turn = F.when(marked, F.col("turn"))
    before = F.last(turn, True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).withColumn("after", F.first(turn, True).over(own.rowsBetween(1, Window.unboundedFollowing)))


def representatives(records: DataFrame) -> DataFrame:
    """records: id, text -> sha256, id (the least of equal texts), n."""
    return records.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def document_counts(documents: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """Documents, those of at least so many characters, and distinct texts of every group."""
    return documents.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.length("text") >= least).alias("n_long"), F.countDistinct(F.md5("text")).alias("n_texts"))


def ocr_routes(pages: DataFrame, by: str, least: int = 20) -> DataFrame:
    """pages: by, text -> by, full, chars, pages, scan: a document is a scan if under half of its pages have ``least`` characters, or they have fewer on average."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    g = pages.groupBy(by).agg(F.sum((n >= least).cast("int")).alias("full"), F.sum(n).alias("chars"), F.count("*").alias("pages"))
    return g.withColumn("scan", (F.col("full") * 2 < F.col("pages")) | (F.col("chars") < least * F.col("pages")))


def timing_stats(rows: DataFrame, by: str, share: float = 0.95) -> DataFrame:
    """rows: by, value -> by, n, mean, median, p: the value of nearest rank (the smallest with at least that share of rows at or below it).

    Counts of equal values are added up, so repeated values cost one row; nulls are left out."""
    counts = rows.where("value IS NOT NULL").groupBy(by, "value").agg(F.count("*").alias("c"))
    own = Window.partitionBy(by)
    run = counts.withColumn("upto", F.sum("c").over(own.orderBy("value"))).withColumn("n", F.sum("c").over(own))
    rank = F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("value"))).alias("p")
    half = F.min(F.when(F.col("upto") >= F.ceil(F.col("n") / 2), F.col("value"))), F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("value")))
    return run.groupBy(by).agg(F.max("n").alias("n"), (F.sum(F.col("value") * F.col("c")) / F.max("n")).alias("mean"), ((half[0] + half[1]) / 2).alias("median"), rank)
