"""Evidence of an answer: query variants, their merge, budget, numbering and claim checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import compact, normalized

# Words that relate several subjects to one predicate, and what separates the subjects.
RELATIONS = "分别|共同|同时|各自"
SUBJECTS = r"\s*(?:、|和|与|以及|及|,|，)\s*"


def query_variants(query: Column, most: int = 6, chars: int = 1000) -> Column:
    """The query and its parts, each of which can be searched alone; only queries with Han characters are split."""
    strip = lambda c: F.regexp_replace(c, "^[ ，,]+|[ ，,]+$", "")
    parts = lambda c, by: F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.trim(query)
    clean = F.regexp_replace(whole, "[？?。.!！ ]+$", "")
    both = f"(?s)^(.*?)(?:{RELATIONS})(.*)$"
    subjects = parts(strip(F.regexp_extract(clean, both, 1)), SUBJECTS)
    after = strip(F.regexp_extract(clean, both, 2))
    predicate = F.coalesce(F.try_element_at(parts(after, "[；;]"), F.lit(-1)), after)
    several = clean.rlike(RELATIONS) & (F.size(subjects) > 1) & (F.size(subjects) <= most)
    of_subjects = F.when(several, F.transform(subjects, lambda x: F.substring(F.concat(x, predicate), 1, chars))).otherwise(F.array().cast("array<string>"))
    clauses = F.transform(F.filter(parts(clean, "[；;]"), lambda x: x != clean), lambda x: F.substring(x, 1, chars))
    seen = F.aggregate(
        F.concat(F.array(whole), of_subjects, clauses), F.array().cast("array<string>"),
        lambda out, x: F.when(F.exists(out, lambda y: normalized(y) == normalized(x)), out).otherwise(F.array_append(out, x)),
    )
    return F.when(whole == "", F.array().cast("array<string>")).when(~whole.rlike("[\\u3400-\\u9fff]"), F.array(F.substring(whole, 1, chars))).otherwise(F.slice(seen, 1, most))


def merge_variants(hits: DataFrame) -> DataFrame:
    """hits of several variants: query_id, id, vector_rank (0: none), raw, keyword_rank, keyword_score, exact -> one row per query and record."""
    return hits.groupBy("query_id", "id").agg(
        F.coalesce(F.min(F.when(F.col("vector_rank") > 0, F.col("vector_rank"))), F.lit(0)).alias("vector_rank"), F.max("raw").alias("raw"),
        F.min("keyword_rank").alias("keyword_rank"), F.max("keyword_score").alias("keyword_score"), F.bool_or("exact").alias("exact"),
    )


def within_budget(items: DataFrame, most: int = 10, chars: int = 16_000, per_document: int = 8, per_container: int = 4, item_chars: int = 4_000) -> DataFrame:
    """items: query_id, id, rank, document, container, chars -> query_id, id, place, evidence_id of those that fit.

    Documents take turns in the order of their best ranks; an item is passed over if its document or container
    is full or its cost exceeds what is left. What was taken decides, so the turns of a query are folded in
    order; its items are at most the retrieval's candidates."""
    in_document = Window.partitionBy("query_id", "document").orderBy("rank")
    turn = items.withColumn("turn", F.row_number().over(in_document)).withColumn("first", F.min("rank").over(Window.partitionBy("query_id", "document")))
    cost = F.least(F.col("chars").cast("long"), F.lit(item_chars).cast("long")).alias("cost")
    queue = turn.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "first", "rank", "id", "document", "container", cost))).alias("queue"))
    kind = dict(items.dtypes)
    taken = F.array().cast(f"array<struct<id:{kind['id']},document:{kind['document']},container:{kind['container']}>>")

    def step(state, x):
        t = state["taken"]
        full = (F.size(F.filter(t, lambda y: y["document"].eqNullSafe(x["document"]))) >= per_document) | (
            F.size(F.filter(t, lambda y: y["document"].eqNullSafe(x["document"]) & y["container"].eqNullSafe(x["container"]))) >= per_container
        )
        fits = (F.size(t) < most) & ~full & (state["used"] + x["cost"] <= chars)
        more = F.array_append(t, F.struct(x["id"].alias("id"), x["document"].alias("document"), x["container"].alias("container")))
        return F.struct(F.when(fits, more).otherwise(t).alias("taken"), F.when(fits, state["used"] + x["cost"]).otherwise(state["used"]).alias("used"))

    chosen = F.aggregate("queue", F.struct(taken.alias("taken"), F.lit(0).cast("long").alias("used")), step, lambda s: s["taken"])
    out = queue.select("query_id", F.posexplode(chosen).alias("at", "x"))
    place = F.col("at") + 1
    return out.select("query_id", F.col("x.id").alias("id"), place.alias("place"), F.format_string("E%03d", place).alias("evidence_id"))


def claim_problems(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims: answer_id, claim, evidence_ids, quotes (map: evidence id -> quote);
    evidence: answer_id, evidence_id, content, context, support -> answer_id, claim, problem, evidence_id.

    Unknown ids, ids without a quote, quotes of other ids, quotes of fewer than four significant characters
    or that are not in their evidence, and claims without evidence of support direct or conflict."""
    quotes = F.coalesce("quotes", F.create_map().cast("map<string,string>"))
    ids = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    base = claims.select("answer_id", "claim", F.array_distinct(ids).alias("ids"), quotes.alias("quotes"))
    each = lambda name, which: base.select("answer_id", "claim", F.lit(name).alias("problem"), F.explode(which).alias("evidence_id"))
    known = evidence.select("answer_id", "evidence_id")
    cited = each("unknown evidence", F.col("ids"))
    unknown = cited.join(known, ["answer_id", "evidence_id"], "left_anti")
    missing = each("no quote", F.array_except("ids", F.map_keys("quotes")))
    extra = each("quote of other evidence", F.array_except(F.map_keys("quotes"), "ids"))
    said = base.select("answer_id", "claim", F.explode("quotes").alias("evidence_id", "quote")).join(evidence, ["answer_id", "evidence_id"])
    inside = F.contains(normalized(F.col("content")), normalized(F.col("quote"))) | F.contains(normalized(F.col("context")), normalized(F.col("quote")))
    short = F.length(compact(F.col("quote"))) < 4
    wrong = said.withColumn("problem", F.when(short, "quote too short").when(~F.coalesce(inside, F.lit(False)), "quote not in the evidence")).where("problem IS NOT NULL")
    direct = cited.join(evidence.where(F.col("support").isin("direct", "conflict")), ["answer_id", "evidence_id"], "left_semi").select("answer_id", "claim").distinct()
    bare = base.join(direct, ["answer_id", "claim"], "left_anti").select("answer_id", "claim", F.lit("no direct support").alias("problem"), F.lit(None).cast("string").alias("evidence_id"))
    columns = ["answer_id", "claim", "problem", "evidence_id"]
    out = unknown.select(columns)
    for more in (missing, extra, wrong.select(columns), bare):
        out = out.unionByName(more)
    return out
