"""Evidence of hits: neighbours and blocks of the same page, normalised items, selection by coverage, claims."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.answers import is_compound  # noqa: F401  (part of this module's surface)
from quarrystone.functions.text import compact, normalized

# Words that cover nothing.
STOP = ("a", "an", "and", "are", "at", "be", "can", "for", "from", "how", "in", "is", "of", "or", "the", "to", "what", "when", "which", "with", "共同", "多少", "如何", "是什么", "有哪些", "怎么", "怎样", "范围")
# Orders of roles and modalities.
ROLES = ("core", "neighbor", "related")
SELECTION_ROLES, SELECTION_MODALITIES = ("core", "related", "neighbor"), ("table", "text", "visual")


def _order(c: Column, values: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, values)), c)
    return F.when(at == 0, F.lit(10)).otherwise(at).cast("int")


def neighbours(anchors: DataFrame, records: DataFrame, back: int = 1, ahead: int = 2) -> DataFrame:
    """anchors: query_id, record_id; records: record_id, document_id, previous_record_id, next_record_id
    -> query_id, anchor_id, record_id, relation, hop (negative before the anchor) along the links.

    A chain ends at a missing record, another document or a record it has been at. One shuffled join a hop."""
    own = records.select(F.col("record_id").alias("r"), F.col("document_id").alias("d"), F.col("previous_record_id").alias("p"), F.col("next_record_id").alias("n"))
    out = None
    for link, relation, hops, sign in (("p", "previous_context", back, -1), ("n", "next_context", ahead, 1)):
        now = anchors.join(own, F.col("record_id") == F.col("r")).select("query_id", F.col("record_id").alias("anchor_id"), F.col("d").alias("document"), F.array("r").alias("seen"), F.col(link).alias("to"))
        for hop in range(1, hops + 1):
            now = now.join(own, (F.col("to") == F.col("r")) & (F.col("d") == F.col("document"))).where(~F.array_contains("seen", F.col("r")))
            now = now.select("query_id", "anchor_id", "document", F.array_append("seen", F.col("r")).alias("seen"), F.col(link).alias("to"), F.col("r").alias("record_id"))
            step = now.select("query_id", "anchor_id", "record_id", F.lit(relation).alias("relation"), F.lit(sign * hop).alias("hop"))
            out = step if out is None else out.unionByName(step)
    return out


def neighbours_by_position(anchors: DataFrame, records: DataFrame, offsets: tuple[int, ...] = (-1, 1, 2)) -> DataFrame:
    """anchors: query_id, record_id; records: record_id, document_id, position. Records at the offsets in the anchor's document."""
    own = records.select("record_id", "document_id", "position")
    at = anchors.join(own, "record_id").select("query_id", F.col("record_id").alias("anchor_id"), "document_id", F.explode(F.array(*map(F.lit, offsets))).alias("hop"), "position")
    return at.select("query_id", "anchor_id", "document_id", "hop", (F.col("position") + F.col("hop")).alias("position")).join(own, ["document_id", "position"]).select("query_id", "anchor_id", "record_id", "hop")


def text_anchors(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """candidates: query_id, id, document_id, page, question; texts: record_id, document_id, page, position, body
    -> query_id, id, anchor_id: the text of the same page, one that holds the question first, then the first."""
    both = candidates.join(texts, ["document_id", "page"])
    order = F.struct((~F.contains(normalized(F.col("body")), normalized(F.col("question")))).alias("without"), "position", "record_id")
    return both.groupBy("query_id", "id").agg(F.min(order).getField("record_id").alias("anchor_id"))


def page_excerpts(tables: DataFrame, texts: DataFrame, most: int = 3, chars: int = 1_800) -> DataFrame:
    """tables: id, document_id, page; texts: record_id, document_id, page, top, body -> id, excerpts: the beginnings of the topmost texts of the page."""
    own = Window.partitionBy("id").orderBy(F.coalesce("top", F.lit(float("inf"))), "record_id")
    top = tables.join(texts, ["document_id", "page"]).withColumn("place", F.row_number().over(own)).where((F.col("place") <= most) & (F.trim("body") != ""))
    line = F.concat(F.lit("同页文本记录 "), F.col("record_id").cast("string"), F.lit("：\n"), F.substring("body", 1, chars))
    return top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("excerpts"))


def related_records(hits: DataFrame, records: DataFrame, most: int = 8, per_container: int = 2, per_modality: int = 1) -> DataFrame:
    """hits: query_id, id, document_id, container, box; records (tables and visuals): record_id, document_id, container, modality, box, relevance
    -> query_id, id, record_id, rank: records of a hit's container by relevance, then by the distance of box centres; bounded in all, per container and per modality."""
    centre = lambda b: (F.array((F.col(b)[0] + F.col(b)[2]) / 2, (F.col(b)[1] + F.col(b)[3]) / 2))
    far = F.abs(centre("box")[0] - centre("other")[0]) + F.abs(centre("box")[1] - centre("other")[1])
    both = hits.join(records.withColumnRenamed("box", "other"), ["document_id", "container"]).where("record_id <> id")
    one = both.groupBy("query_id", "id", "container", "record_id", "modality").agg(F.max("relevance").alias("relevance"), F.min(F.coalesce(far, F.lit(float("inf")))).alias("far"))
    order = [F.desc("relevance"), F.round("far", 9), F.when(F.col("modality") == "table", 0).otherwise(1), "record_id"]
    kept = one.withColumn("m", F.row_number().over(Window.partitionBy("query_id", "id", "container", "modality").orderBy(*order))).where(F.col("m") <= per_modality)
    kept = kept.withColumn("c", F.row_number().over(Window.partitionBy("query_id", "id", "container").orderBy(*order))).where(F.col("c") <= per_container)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("container", "c"))).where(F.col("rank") <= most).select("query_id", "id", "record_id", "rank")


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks: query_id, record_id, modality, page, slide, sheet, top, left. Adds place: by pages, slides, sheets, then top, left, modality and id; unknown places last."""
    kind = F.when(F.col("page").isNotNull(), 0).when(F.col("slide").isNotNull(), 1).when(F.col("sheet").isNotNull(), 2).otherwise(3)
    last = F.lit(float("inf"))
    number = F.coalesce("page", "slide")
    order = [kind, number, "sheet", F.coalesce("top", last), F.coalesce("left", last), _order(F.col("modality"), ("text", "table", "visual")), "record_id"]
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def normalised_evidence(blocks: DataFrame) -> DataFrame:
    """blocks: query_id, rank (of the hit), block (place in the hit), record_id, document_id, modality, role, body, has_asset, concrete, focused
    -> the best block of every record of a query with evidence_id: list items first, then by role, focus, rank, modality and block.

    Blocks of unknown modality, without id, or with neither text nor asset go; unknown roles count as related."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("related")
    kept = blocks.withColumn("role", role).where(F.col("modality").isin("text", "table", "visual") & (F.coalesce(F.trim("record_id"), F.lit("")) != "") & ((F.coalesce("body", F.lit("")) != "") | F.coalesce("has_asset", F.lit(False))))
    order = [F.when(F.col("concrete"), 0).otherwise(1), _order(F.col("role"), ROLES), F.when(F.col("focused"), 0).otherwise(1), "rank", _order(F.col("modality"), ("text", "table", "visual")), "block", "record_id"]
    best = kept.withColumn("_b", F.row_number().over(Window.partitionBy("query_id", "document_id", "modality", "record_id").orderBy(*order))).where("_b = 1").drop("_b")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return best.withColumn("place", n).withColumn("evidence_id", F.format_string("E%03d", n))


def selection_cap(evidence: DataFrame, most: int = 48) -> DataFrame:
    """evidence: query_id, rank, role, modality, evidence_id. The hits take turns, each with its best item left; the first ``most`` stay, in that order (place)."""
    own = Window.partitionBy("query_id", "rank").orderBy(_order(F.col("role"), SELECTION_ROLES), _order(F.col("modality"), SELECTION_MODALITIES), "evidence_id")
    turn = evidence.withColumn("_t", F.row_number().over(own))
    return turn.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_t", "rank"))).where(F.col("place") <= most).drop("_t")


def coverage_tokens(text: Column) -> Column:
    """Distinct Latin words, short Han runs and bigrams of Han runs, of two characters at least, without stop words."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]+(?:[-./][a-z0-9]+)*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit("[㐀-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    every = F.concat(latin, F.filter(runs, lambda r: F.length(r) <= 4), pairs)
    return F.array_distinct(F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(*STOP)))


def token_weight(token: Column) -> Column:
    """3 for words with a digit or a hyphen, 1.8 for Han, 1.5 for long words, else 1."""
    return F.when(token.rlike(r"\d|-"), 3.0).when(token.rlike("[㐀-鿿]"), 1.8).when(F.length(token) >= 5, 1.5).otherwise(1.0)


def coverage_decisions(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """queries: query_id, question; evidence: query_id, evidence_id, body -> per item matched (tokens), weight, relevant, support, score."""
    q = queries.select("query_id", coverage_tokens(F.col("question")).alias("wanted"))
    both = evidence.join(q, "query_id").withColumn("matched", F.array_sort(F.array_intersect("wanted", coverage_tokens(F.col("body"))))).drop("wanted")
    total = F.aggregate("matched", F.lit(0.0), lambda s, t: s + token_weight(t))
    strong = (F.round(total, 6) >= 3.0) | F.exists("matched", lambda t: t.rlike(r"\d|-"))
    return both.withColumn("weight", total).withColumn("relevant", strong).withColumn("support", F.when(strong, "direct").otherwise("none")).withColumn("score", F.least(F.lit(1.0), total / 8))


def coverage_order(items: DataFrame) -> DataFrame:
    """items: query_id, evidence_id, document_id, modality, rank, matched -> query_id, evidence_id, place.

    Greedy: at each step the item of greatest 2 * weight of tokens not covered + weight + 0.75 for a new document + 0.35 for a
    table; ties by rank, then by input order of evidence_id. Each choice depends on the former, so a query's items, which the
    retrieval bounds, are ordered in one call; queries are dealt over all tasks."""
    rows = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "document_id", "modality", "rank", "matched", F.transform("matched", token_weight).alias("weights")))).alias("items"))
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, places = [], [], []
            for query, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                left = [(dict(zip(x["matched"], x["weights"], strict=True)), x) for x in own]
                covered, documents, place = set(), set(), 0
                while left:

                    def worth(entry):
                        found, x = entry
                        new = sum(v for t, v in found.items() if t not in covered)
                        return round(2 * new + sum(found.values()) + 0.75 * (x["document_id"] not in documents) + 0.35 * (x["modality"] == "table"), 6), -x["rank"]

                    best = max(range(len(left)), key=lambda k: worth(left[k]))
                    found, x = left.pop(best)
                    covered |= set(found)
                    documents.add(x["document_id"])
                    place += 1
                    ids.append(query), names.append(x["evidence_id"]), places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(names, pa.string()), pa.array(places, pa.int32())], names=["query_id", "evidence_id", "place"])

    return rows.mapInArrow(run, f"query_id {kind}, evidence_id string, place int")


def decided(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every evidence item with its decision, in evidence order; support none where there is none."""
    both = evidence.join(decisions.select("query_id", "evidence_id", "support", "score"), ["query_id", "evidence_id"], "left")
    return both.withColumn("support", F.coalesce("support", F.lit("none"))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def verbatim(quote: Column, body: Column, context: Column) -> Column:
    """Whether a quote of at least four significant characters stands in the body or the context, white space and case aside."""
    inside = lambda c: F.coalesce(F.contains(normalized(c), normalized(quote)), F.lit(False))
    return (F.length(compact(quote)) >= 4) & (inside(body) | inside(context))
