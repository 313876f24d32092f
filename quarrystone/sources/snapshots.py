"""Immutable snapshots of records: staged, validated, then published by one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "2.0"


def problems(records: DataFrame) -> DataFrame:
    """record_id, problem of records (record_id, document_id, previous_record_id, next_record_id) that break the contract."""
    repeated = records.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1 OR record_id IS NULL").select("record_id", F.lit("repeated or null id").alias("problem"))
    ends = records.select("record_id", F.explode(F.array("previous_record_id", "next_record_id")).alias("to")).where("to IS NOT NULL")
    dangling = ends.join(records.select(F.col("record_id").alias("to")), "to", "left_anti").select("record_id", F.lit("dangling link").alias("problem"))
    return repeated.unionByName(dangling)


def publish(records: DataFrame, root: str, extra: dict | None = None) -> str:
    """Writes a snapshot partitioned by modality and returns its id. CURRENT moves only after validation;
    a snapshot that fails is deleted and the former one stays published."""
    spark, name = records.sparkSession, uuid.uuid4().hex
    path = f"{root}/snapshots/{name}"
    try:
        records.write.partitionBy("modality").parquet(f"{path}/records")
        written = spark.read.schema(records.schema).parquet(f"{path}/records")
        broken = problems(written).limit(5).collect()
        if broken:
            raise ValueError(f"snapshot is not valid: {[(r.record_id, r.problem) for r in broken]}")
        counts = {r.modality: r["count"] for r in written.groupBy("modality").count().collect()}  # one row a modality
        _put(spark, f"{path}/manifest.json", json.dumps({"schema_version": SCHEMA_VERSION, "build_id": name, "counts": counts, **(extra or {})}, sort_keys=True))
        _put(spark, f"{root}/CURRENT", name)
    except BaseException:
        _fs(spark, path).delete(_path(spark, path), True)
        raise
    return name


def load(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """Manifest and records of the published snapshot; another schema version or other counts are an error."""
    path = f"{root}/snapshots/{_get(spark, f'{root}/CURRENT')}"
    manifest = json.loads(_get(spark, f"{path}/manifest.json"))
    if manifest["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {manifest['schema_version']}: rebuild the snapshot")
    records = spark.read.parquet(f"{path}/records")
    counts = {r.modality: r["count"] for r in records.groupBy("modality").count().collect()}
    if counts != manifest["counts"]:
        raise ValueError(f"counts {counts} differ from the manifest's {manifest['counts']}")
    return manifest, records


def _path(spark, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark, path):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target, then renames over it."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    beside = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = _fs(spark, path).create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(beside, _path(spark, path), options)


def _get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value.strip()
