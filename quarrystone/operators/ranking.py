"""Candidates of several modalities to final hits: filters, ranks, fusion, greedy dedup, rerank, variants in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.answers import query_focus
from quarrystone.functions.text import lexical_tokens, normalized, page_sized
from quarrystone.operators.retrieval import EXACT_WEIGHT, KEYWORD_WEIGHT, MIN_RAW, RRF_K, VECTOR_WEIGHT

MODALITIES = ("text", "table", "visual")
OVERLAP = 0.8


def filtered(records: DataFrame, document_ids=None, document_types=None, source_paths=None) -> DataFrame:
    """The records of the given ids, types (in any case) and paths; None leaves a field free. Reaches the scan as pushed filters."""
    for column, values, fold in (("document_id", document_ids, False), ("document_type", document_types, True), ("source_path", source_paths, False)):
        if values is not None:
            c = F.lower(F.col(column)) if fold else F.col(column)
            records = records.where(c.isin([v.lower() if fold else v for v in values]))
    return records


def final_evidence(modality: Column, document_type: Column, llm_eligible: Column, coarse_only: Column, box: Column) -> Column:
    """Whether a record may be final evidence: visuals may not if they are marked so, or fill a PDF page."""
    marked = F.coalesce(~llm_eligible, F.lit(False)) | F.coalesce(coarse_only, F.lit(False))
    page = (F.lower(document_type) == "pdf") & (F.size(box) == 4) & page_sized(box)
    return (modality != "visual") | ~(marked | F.coalesce(page, F.lit(False)))


def keyword_ranks(scores: DataFrame, k: int) -> DataFrame:
    """scores: query_id, modality, position, score, exact. The k best of a query and modality: exact matches first, then by score and position."""
    own = Window.partitionBy("query_id", "modality").orderBy(F.desc("exact"), F.desc(F.round("score", 9)), "position")
    return scores.where("exact OR score > 0").withColumn("keyword_rank", F.row_number().over(own)).where(F.col("keyword_rank") <= k)


def vector_ranks(scores: DataFrame, k: int) -> DataFrame:
    """scores: query_id, modality, position, raw of eligible records. The k best of a query and modality, ties by position."""
    own = Window.partitionBy("query_id", "modality").orderBy(F.desc(F.round("raw", 9)), "position")
    return scores.withColumn("vector_rank", F.row_number().over(own)).where(F.col("vector_rank") <= k)


def fuse_modalities(candidates: DataFrame, weights: dict[str, float] | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """candidates: query_id, modality, id, raw, vector_rank (0: none), keyword_rank, exact; keyword-only ones have a raw score as well.

    Adds fusion and place (from 1): by fusion, raw score, order of modalities and id. A candidate passes with its modality's
    least raw score or a keyword rank."""
    of = lambda values, other: F.coalesce(*[F.when(F.col("modality") == m, F.lit(float(v))) for m, v in (values or {}).items()], F.lit(other))
    vector = F.when(F.col("vector_rank") > 0, VECTOR_WEIGHT * of(weights, 1.0) / (RRF_K + F.col("vector_rank"))).otherwise(0.0)
    keyword = F.coalesce(KEYWORD_WEIGHT / (RRF_K + F.col("keyword_rank")), F.lit(0.0))
    exact = F.when(F.coalesce("exact", F.lit(False)), EXACT_WEIGHT / (RRF_K + 1)).otherwise(0.0)
    kept = candidates.where((F.col("raw") >= of(least, MIN_RAW)) | F.col("keyword_rank").isNotNull()).withColumn("fusion", vector + keyword + exact)
    order = F.array_position(F.array(*map(F.lit, MODALITIES)), F.col("modality"))
    own = Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion", 9)), F.desc(F.round("raw", 6)), order, "id")
    return kept.withColumn("place", F.row_number().over(own))


def greedy_distinct(ranked: DataFrame, k: int) -> DataFrame:
    """ranked: query_id, place, id, modality, document_id, content_hash, blocks. The first k of a query that repeat none taken before:
    its id, or in the same modality and document its hash, or for texts OVERLAP of the smaller set of blocks. Adds rank.

    What was taken decides, so a query's candidates, which retrieval bounds, are folded in order."""
    fields = ["place", "id", "modality", "document_id", "content_hash", "blocks"]
    queue = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("queue"))

    def same(x: Column, y: Column) -> Column:
        scope = (x["modality"] == y["modality"]) & x["document_id"].eqNullSafe(y["document_id"])
        both = F.size(F.array_intersect(x["blocks"], y["blocks"]))
        least = F.least(F.size(F.array_distinct(x["blocks"])), F.size(F.array_distinct(y["blocks"])))
        blocks = (x["modality"] == "text") & (least > 0) & (both >= OVERLAP * least)
        hashes = (F.coalesce(x["content_hash"], F.lit("")) != "") & (x["content_hash"] == y["content_hash"])
        return F.coalesce(x["id"] == y["id"], F.lit(False)) | (scope & (F.coalesce(hashes, F.lit(False)) | F.coalesce(blocks, F.lit(False))))

    none = F.filter("queue", lambda _: F.lit(False))
    taken = F.aggregate("queue", none, lambda acc, x: F.when((F.size(acc) >= k) | F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.array_append(acc, x)))
    out = queue.select("query_id", F.posexplode(taken).alias("at", "x")).select("query_id", F.col("x.id").alias("id"), F.col("x.modality").alias("modality"), (F.col("at") + 1).alias("rank"))
    return ranked.join(out, ["query_id", "id", "modality"])


def text_rerank(hits: DataFrame, queries: DataFrame, k: int, weight: float = 0.35) -> DataFrame:
    """hits: query_id, id, modality, place, fusion, raw, vector_rank, keyword_rank, exact, body; queries: query_id, text.

    Texts gain up to weight / 61 by how well they answer the question: token coverage, the question and its focus inside, exact
    match, keyword rank. The k best stay; the two texts of best raw score among vector hits come in front if they are not
    among them, in place of the last. Adds fusion and rank anew."""
    q = queries.select("query_id", normalized(F.col("text")).alias("question"), query_focus(F.col("text")).alias("focus"), F.array_distinct(lexical_tokens(F.col("text"))).alias("wanted"))
    both = hits.join(q, "query_id").withColumn("own", normalized(F.col("body"))).withColumn("tokens", F.array_distinct(lexical_tokens(F.col("body"))))
    share = F.when(F.size("wanted") > 0, F.size(F.array_intersect("wanted", "tokens")) / F.size("wanted")).otherwise(0.0)
    gain = lambda when, by: F.when(F.coalesce(when, F.lit(False)), by).otherwise(0.0)
    score = 0.45 * share + gain(F.contains("own", "question"), 0.35) + gain((F.col("focus") != "") & F.contains("own", "focus"), 0.35) + gain(F.col("exact"), 0.20) + F.coalesce(0.10 / F.col("keyword_rank"), F.lit(0.0))
    scored = F.when((F.col("modality") == "text") & (F.col("own") != "") & (F.col("question") != ""), F.least(score, F.lit(1.0))).otherwise(0.0)
    new = both.withColumn("fusion", F.col("fusion") + weight * scored / (RRF_K + 1)).drop("own", "tokens", "question", "focus", "wanted")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion", 9)), "place")))
    text = (F.col("modality") == "text") & (F.col("vector_rank") > 0)
    anchor = F.when(text, F.row_number().over(Window.partitionBy("query_id", text).orderBy(F.desc(F.round("raw", 9)), "vector_rank")))
    new = new.withColumn("_a", F.when(anchor <= 2, anchor)).withColumn("_missing", F.col("_a").isNotNull() & (F.col("_n") > k))
    own = Window.partitionBy("query_id")
    new = new.withColumn("_m", F.least(F.sum(F.col("_missing").cast("int")).over(own), F.count("*").over(own), F.lit(k)))
    front = F.when(F.col("_missing"), F.row_number().over(Window.partitionBy("query_id", "_missing").orderBy("_a")))
    new = new.withColumn("rank", F.coalesce(F.when(front <= F.col("_m"), front), F.when(F.col("_n") <= k - F.col("_m"), F.col("_n") + F.col("_m"))))
    return new.where("rank IS NOT NULL").drop("_n", "_a", "_m", "_missing")


def interleave_variants(rankings: DataFrame, merged: DataFrame, k: int, candidate_k: int = 30) -> DataFrame:
    """rankings: query_id, variant (from 0), rank, id, key; merged: query_id, rank, id, key -> query_id, id, rank of the k hits.

    The variants' hits take turns by rank, each variant down to a bound, so that no part of a question is left out; what is
    then free is filled from the merged ranking. Of hits with equal keys (identity of content) the first stays."""
    n = rankings.groupBy("query_id").agg(F.countDistinct("variant").alias("n"))
    coarse = max(k, min(candidate_k, 3 * k))
    bound = F.least(F.lit(coarse), F.greatest(F.lit(2), F.ceil(F.lit(k) / F.col("n")) + 2))
    turns = rankings.join(n, "query_id").where(F.col("rank") <= bound).select("query_id", "id", "key", F.lit(0).alias("pass"), "rank", "variant")
    rest = merged.where(F.col("rank") <= coarse).select("query_id", "id", "key", F.lit(1).alias("pass"), "rank", F.lit(0).alias("variant"))
    order = F.struct("pass", "rank", "variant", "id")
    first = turns.unionByName(rest).groupBy("query_id", "key").agg(F.min(order).alias("o"))
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o")))
    return placed.where(F.col("rank") <= k).select("query_id", F.col("o.id").alias("id"), "rank")
