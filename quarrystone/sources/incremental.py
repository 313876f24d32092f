"""Incremental builds: which sources are new, which records stay, and whether a snapshot holds together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.1"


def source_entries(files: DataFrame, before: DataFrame) -> DataFrame:
    """files: path, size, modified, content; before: path, size, modified, sha256 -> path, size, modified, sha256.

    Content is hashed only where size or time changed."""
    old = before.select("path", F.col("size").alias("_size"), F.col("modified").alias("_time"), F.col("sha256").alias("_sha"))
    same = F.col("_sha").isNotNull() & (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_time"))
    return files.join(old, "path", "left").select("path", "size", "modified", F.when(same, F.col("_sha")).otherwise(F.sha2("content", 256)).alias("sha256"))


def source_diff(now: DataFrame, before: DataFrame, cached: DataFrame) -> DataFrame:
    """now, before: path, sha256; cached: path, document_id, schema_version -> path, status reused, changed, added or removed.

    A source is reused if its digest is as before and a cached document of this version and path has it."""
    a, b = now.select("path", F.col("sha256").alias("a")), before.select("path", F.col("sha256").alias("b"))
    held = cached.where(F.col("schema_version") == SCHEMA_VERSION).select("path", F.col("document_id").alias("a"), F.lit(True).alias("held")).distinct()
    both = a.join(b, "path", "full_outer").join(held, ["path", "a"], "left")
    status = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when((F.col("a") == F.col("b")) & F.col("held"), "reused").otherwise("changed")
    return both.select("path", status.alias("status"))


def is_current(now: DataFrame, before: DataFrame) -> DataFrame:
    """One row, current: whether both hold the same paths, sizes and times."""
    key = ["path", "size", "modified"]
    a, b = now.select(*key).distinct(), before.select(*key).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("current"))


def merged_records(old: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """old, new: document_id, path, record_id, ordinal; sources: path, position, status. Records of reused sources and all new ones, with index_position
    in the order of sources, then as they were. Positions come from counts by source, so no row is ordered across sources."""
    from pyspark.sql import Window

    kept = old.join(sources.where("status = 'reused'").select("path"), "path", "left_semi")
    rows = kept.unionByName(new).join(sources.select("path", "position"), "path")
    counts = rows.groupBy("path", "position").agg(F.count("*").alias("n"))
    # one row a source
    start = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("path", "start")
    own = F.row_number().over(Window.partitionBy("path").orderBy("ordinal", "record_id")) - 1
    return rows.withColumn("_n", own).join(start, "path").withColumn("index_position", F.col("start") + F.col("_n")).drop("_n", "start")


def compatible(manifest: Column, schema_version: str, model: str, dimension: int, chunking: str) -> Column:
    """Whether a manifest (struct) is a base for an increment: same schema, model, dimension and chunking."""
    return (manifest["schema_version"] == schema_version) & (manifest["model"] == model) & (manifest["dimension"] == dimension) & (manifest["chunking"] == chunking)


def snapshot_problems(records: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """records: record_id, document_id, modality, blocks, source_path, previous_record_id, next_record_id; vectors: record_id, vector
    -> problem, n: how many rows break each rule. An empty result is a valid snapshot."""
    trace = records.where(F.coalesce(F.trim("document_id"), F.lit("")).eqNullSafe("") | (F.size("blocks") < 1) | F.coalesce(F.trim("source_path"), F.lit("")).eqNullSafe("") | F.col("record_id").isNull())
    untraceable = trace.select(F.lit("untraceable record").alias("problem"))
    repeated = records.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id").alias("problem"))
    ends = records.where("modality = 'text'").select(F.explode(F.array("previous_record_id", "next_record_id")).alias("to")).where("to IS NOT NULL")
    dangling = ends.join(records.where("modality = 'text'").select(F.col("record_id").alias("to")), "to", "left_anti").select(F.lit("dangling link").alias("problem"))
    lone = records.join(vectors, "record_id", "left_anti").select(F.lit("no vector").alias("problem")).unionByName(vectors.join(records, "record_id", "left_anti").select(F.lit("no record").alias("problem")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = F.when(F.size("vector") != dimension, "wrong dimension").when(F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | (norm == 0), "zero or not finite").when(F.abs(norm - 1) > 1e-5, "not of unit length")
    shape = vectors.select(bad.alias("problem")).where("problem IS NOT NULL")
    every = untraceable.unionByName(repeated).unionByName(dangling).unionByName(lone).unionByName(shape)
    return every.groupBy("problem").agg(F.count("*").alias("n"))


def unsafe_path(path: Column) -> Column:
    """Whether a relative path is absolute, names a drive or leaves its folder."""
    return F.coalesce(path.rlike(r"^[/\\]|^[A-Za-z]:") | F.array_contains(F.split(path, r"[/\\]"), ".."), F.lit(True))


def ground_truth(rows: DataFrame, overrides: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """rows: id, modality, locator, page; overrides: id, label, modality, page -> id, label, modality, page of the expected evidence: a row's own
    unless overrides name some."""
    to = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    own = rows.join(overrides.select("id"), "id", "left_anti").select("id", F.coalesce("locator", "modality").alias("label"), F.try_element_at(to, F.col("modality")).alias("modality"), "page")
    return own.unionByName(overrides.join(rows.select("id"), "id", "left_semi").select("id", "label", "modality", "page"))


def expected_ranks(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """expected: id, modality, page, record_ids; hits: id, rank, modality, page, record_id -> expected with the best rank of a hit of its modality, its page
    if it names one, and one of its records if it names any."""
    e = expected.withColumn("_e", F.monotonically_increasing_id()) if "evidence" not in expected.columns else expected.withColumn("_e", F.col("evidence"))
    h = hits.select("id", "rank", F.col("modality").alias("_m"), F.col("page").alias("_p"), "record_id")
    fits = (F.col("modality") == F.col("_m")) & (F.col("page").isNull() | F.col("page").eqNullSafe(F.col("_p"))) & (F.col("record_ids").isNull() | (F.size("record_ids") == 0) | F.array_contains("record_ids", F.col("record_id")))
    best = e.join(h, "id").where(fits).groupBy("_e").agg(F.min("rank").alias("rank"))
    return e.join(best, "_e", "left").drop("_e")


def modality_recall(ranked: DataFrame, k: int) -> DataFrame:
    """ranked: modality, rank -> modality, n, recall at k."""
    return ranked.groupBy("modality").agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias("recall"))


def acceptance(blocks: DataFrame) -> DataFrame:
    """blocks: document_id, kind, embedded -> per document counts by kind, visuals embedded, texts and tables sent to the image embedder by mistake, passed."""
    kind = lambda k, more=True: F.count_if((F.col("kind") == k) & more)
    out = blocks.groupBy("document_id").agg(kind("text").alias("texts"), kind("table").alias("tables"), kind("visual").alias("visuals"), kind("visual", F.col("embedded")).alias("embedded"), F.count_if((F.col("kind") != "visual") & F.col("embedded")).alias("misrouted"))
    return out.withColumn("passed", (F.col("visuals") == F.col("embedded")) & (F.col("misrouted") == 0))


def build_report(records: DataFrame, sources: DataFrame) -> DataFrame:
    """records: modality, document_id; sources: status -> name, n: records by modality, documents, sources by status."""
    by = records.groupBy(F.concat(F.lit("records "), "modality").alias("name")).agg(F.count("*").alias("n"))
    documents = records.agg(F.countDistinct("document_id").alias("n")).select(F.lit("documents").alias("name"), "n")
    return by.unionByName(documents).unionByName(sources.groupBy(F.concat(F.lit("sources "), "status").alias("name")).agg(F.count("*").alias("n")))
