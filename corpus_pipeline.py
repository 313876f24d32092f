"""The training-data pipeline: five operators one after another over a documents table.

Each stage takes what its predecessor kept, and its decisions take effect: rejected documents go,
recurring lines leave the texts, one document of each near-duplicate group stays, the mixture repeats
or leaves out documents, and the last stage encodes and decodes. All but the last keep the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import bpe_lexicon, budget_mix, lang_rank, line_templates, lsh_forest
from quarrystone.llm.common import documents, shared_path
from quarrystone.llm.queries import word_bpe


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter."""
    pred = lang_rank.language(lang_rank.learn_folds(docs))(F.col("text").cast("string"))
    return docs.where(pred["lang_pred"] != lang_rank.NONE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of recurring templates out of the texts."""
    return line_templates.drop_recurring(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of every near-duplicate group (similarity 0.8 of five-word shingles)."""
    gone = lsh_forest.near_groups(docs, percent=80).where("NOT kept").select(F.struct(F.col("doc_id")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone.doc_id"), "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their targets."""
    return budget_mix.apply_mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of ids and decoded text of every row."""
    return bpe_lexicon.op6_bpe(spark, docs, word_bpe())


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("source mix", mix_stage),
    ("BPE", bpe_stage),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
