"""Registered queries of ranking and evidence selection, and their SQL.

Records are vectors or documents; modality, document, page and blocks are derived from their ids alike in query and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import inner
from quarrystone.operators import ranking as K
from quarrystone.operators import records as R
from quarrystone.operators import retrieval as Q
from quarrystone.operators import selection as S
from quarrystone.plans.registry import _BM25, _EXACT, _IP, _items, _ranked, _read, _records, _vectors

_pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (1 + c % len(values)).cast("int"))
_modality = lambda c: _pick(K.MODALITIES, c)


def _keyword(s, d, k):
    """Scores of documents and whether they hold the whole item: what can be among the k best of an item and modality."""
    records = _records(s, d).withColumn("modality", _modality(F.col("id")))
    return Q.bm25_best(records, _items(s, d), k, "modality", phrases=True, exact_first=True).withColumn("position", F.col("id"))


def keyword_ranks(s: SparkSession, d: str) -> DataFrame:
    return K.keyword_ranks(_keyword(s, d, 8), 8).select("query_id", "modality", "id", "exact", "keyword_rank")


def _pairs(s, d, records, k):
    """All records against every hundredth one: raw scores, those that can be among the k best of a query and modality."""
    q = _vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return Q.inner_products(records, q, k, "modality").withColumn("position", F.col("id"))


def vector_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    v = _read(s, d, "embeddings").select(i.alias("id"), F.col("embedding").alias("vector"), i.alias("position"), F.concat(F.lit("d"), (i % 7).cast("string")).alias("document_id"), _pick(("PDF", "docx", "xlsx"), i % 11).alias("document_type"), _modality(i).alias("modality"))
    box = F.array(F.lit(0.0), F.lit(0.01), F.lit(1.0), F.when(i % 2 == 0, 0.99).otherwise(0.5))
    kept = K.filtered(v, document_ids=["d0", "d1", "d2", "d4", "d5"], document_types=["pdf", "DOCX"]).withColumn("vec_id", F.col("id"))
    kept = kept.where(K.final_evidence(F.col("modality"), F.col("document_type"), i % 13 != 0, F.when(i % 17 == 0, True), box)).drop("vec_id")
    return K.vector_ranks(_pairs(s, d, kept, 5), 5).select("query_id", "modality", "id", "vector_rank", F.round("raw", 5).alias("raw"))


def _candidates(s, d):
    """Vector and keyword hits of a query's record, keyword-only ones with their raw scores."""
    v, items = _vectors(s, d).select("id", "vector"), _items(s, d)
    q = items.join(v, F.col("query_id") == F.col("id")).select("query_id", "vector")
    raw = Q.inner_products(v.withColumn("modality", _modality(F.col("id"))), q, 10, "modality").withColumn("position", F.col("id"))
    near = K.vector_ranks(raw, 10).select("query_id", "id", "raw", "vector_rank")
    words = K.keyword_ranks(_keyword(s, d, 10), 10).select("query_id", "id", "keyword_rank", "exact")
    both = near.join(words, ["query_id", "id"], "full_outer").join(q.withColumnRenamed("vector", "asked"), "query_id")
    both = Q.with_records(both, v, items, 20 * len(K.MODALITIES)).withColumn("raw", F.coalesce("raw", inner(F.col("vector"), F.col("asked"))))
    return both.select("query_id", "id", "raw", F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), "keyword_rank", F.coalesce("exact", F.lit(False)).alias("exact"), _modality(F.col("id")).alias("modality"))


def _fused(s, d):
    return K.fuse_modalities(_candidates(s, d), weights={"table": 1.5}, least={"visual": 0.2})


def hybrid_by_modality(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d).where("place <= 12").select("query_id", "id", "modality", "place", F.round("fusion", 7).alias("fusion"))


def dedup_block_overlap(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    hits = _fused(s, d).where("place <= 20").select("query_id", "id", "modality", "place", (i % 3).alias("document_id"), F.when(i % 4 != 0, (i % 9).cast("string")).alias("content_hash"), F.sequence(F.floor(i / 3) % 6, F.floor(i / 3) % 6 + 4).alias("blocks"))
    return K.greedy_distinct(hits, 6).select("query_id", "id", "rank")


def text_rerank(s: SparkSession, d: str) -> DataFrame:
    hits = Q.with_records(_fused(s, d).where("place <= 20"), _records(s, d).withColumnRenamed("text", "body"), _items(s, d), 20)
    return K.text_rerank(hits, _items(s, d), 6).select("query_id", "id", "rank", F.round("fusion", 7).alias("fusion"))


def variant_interleave(s: SparkSession, d: str) -> DataFrame:
    """Three variants of every hundredth vector as query: itself and its two successors; equal residues count as equal contents."""
    v = _vectors(s, d)
    q = v.where("id % 100 < 3").select(F.col("id").alias("query_id"), "vector")
    raw = Q.inner_products(v, q, 30)
    ranked = Q.ranked(raw, 30, "raw").select((F.col("query_id") - F.col("query_id") % 100).alias("query_id"), (F.col("query_id") % 100).alias("variant"), "id", "rank", "raw", (F.col("id") % 150).alias("key"))
    best = ranked.groupBy("query_id", "id", "key").agg(F.max("raw").alias("raw"))
    return K.interleave_variants(ranked, Q.ranked(best, 30, "raw"), 10)


def _blocks(s, d):
    """The lines of a query's hits as blocks, each seen by two hits."""
    hits = _ranked(s, d, 6).select("query_id", "id", "rank")
    i = F.col("id") + F.col("block")
    blocks = hits.withColumn("block", F.explode(F.array(F.lit(0), F.lit(1))))
    return blocks.select(
        "query_id", "rank", "block", F.concat(F.lit("r"), (i % 5).cast("string")).alias("record_id"), (i % 2).alias("document_id"), _pick(("text", "table", "visual", "sound"), i).alias("modality"),
        _pick(("core", "neighbor", "related", "other"), i).alias("role"), F.when(i % 6 != 0, F.lit("b")).alias("body"), (i % 12 == 0).alias("has_asset"), (i % 3 == 0).alias("concrete"), (i % 5 == 0).alias("focused"),
    )


def evidence_normalize(s: SparkSession, d: str) -> DataFrame:
    return S.normalised_evidence(_blocks(s, d)).select("query_id", "document_id", "modality", "record_id", "rank", "role", "evidence_id")


def selection_cap(s: SparkSession, d: str) -> DataFrame:
    return S.selection_cap(S.normalised_evidence(_blocks(s, d)), 4).select("query_id", "evidence_id", "place")


def _covered(s, d):
    hits = Q.with_records(_ranked(s, d, 8), _records(s, d), _items(s, d), 8)
    items = hits.select("query_id", F.format_string("E%03d", "rank").alias("evidence_id"), "rank", F.col("text").alias("body"), (F.col("id") % 3).cast("string").alias("document_id"), _modality(F.col("id")).alias("modality"))
    return S.coverage_decisions(_items(s, d).withColumnRenamed("text", "question"), items)


def coverage_score(s: SparkSession, d: str) -> DataFrame:
    c = _covered(s, d)
    every = S.decided(c.select("query_id", "evidence_id"), c.where("relevant"))
    return c.drop("score", "support").join(every, ["query_id", "evidence_id"]).select("query_id", "evidence_id", F.size("matched").alias("n"), F.round("weight", 4).alias("weight"), "support", F.round("score", 6).alias("score"))


def coverage_order(s: SparkSession, d: str) -> DataFrame:
    """No SQL: a brute-force version tests it."""
    return S.coverage_order(_covered(s, d).where("relevant").select("query_id", "evidence_id", "document_id", "modality", "rank", "matched"))


def _chain(s, d):
    """The chunk windows of the documents; every eleventh chunk is missing."""
    w = R.windows(_records(s, d)).where("NOT (ordinal = 3 AND id % 11 = 0)")
    return w.select("record_id", F.col("id").alias("document_id"), "previous_record_id", "next_record_id", "ordinal")


def neighbour_chain(s: SparkSession, d: str) -> DataFrame:
    c = _chain(s, d)
    a = c.where("ordinal % 4 = 2").select(F.col("document_id").alias("query_id"), "record_id")
    return S.neighbours(a, c).select("query_id", "anchor_id", "record_id", "relation", "hop")


def neighbour_offsets(s: SparkSession, d: str) -> DataFrame:
    r = _read(s, d, "documents").select(F.col("doc_id").alias("record_id"), F.floor(F.col("doc_id") / 7).alias("document_id"), F.col("doc_id").alias("position"))
    return S.neighbours_by_position(r.where("position % 5 = 0").select(F.col("record_id").alias("query_id"), "record_id"), r)


def _turns(s, d):
    """Turns of conversations as texts: three to a page."""
    return _read(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("record_id"), F.col("conv_id").alias("document_id"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("position"), F.when(F.col("turn") % 4 != 3, 1.0 / (1 + F.col("turn") % 3)).alias("top"), F.coalesce("text", F.lit("")).alias("body"), "role")


def text_anchor(s: SparkSession, d: str) -> DataFrame:
    t = _turns(s, d)
    c = t.where("position % 3 = 1").select(F.col("document_id").alias("query_id"), F.col("record_id").alias("id"), "document_id", "page", F.substring("body", 3, 8).alias("question"))
    return S.text_anchors(c, t.select("record_id", "document_id", "page", "position", "body"))


def page_excerpts(s: SparkSession, d: str) -> DataFrame:
    t = _turns(s, d)
    out = S.page_excerpts(t.where("position % 3 = 0").select(F.col("record_id").alias("id"), "document_id", "page"), t, 2, 50)
    return out.select("id", F.md5("excerpts").alias("excerpts_md5"))


def related_records(s: SparkSession, d: str) -> DataFrame:
    """Lines of an order: text lines and the tables and visuals of the same ship mode; relevance by quantity."""
    l = _read(s, d, "lineitem").withColumn("rid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    x, y = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    base = l.select("rid", F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("container"), F.array(x, y, x + 0.2, y + 0.1).alias("box"), _modality(F.col("l_linenumber")).alias("modality"), F.floor(F.col("l_quantity") / 20).alias("relevance")).dropDuplicates(["rid"])
    one = l.groupBy("rid").agg(F.count("*").alias("n")).where("n = 1").select("rid")
    base = base.join(one, "rid", "left_semi")
    hits = base.where("modality = 'text'").select(F.col("document_id").alias("query_id"), F.col("rid").alias("id"), "document_id", "container", "box")
    return S.related_records(hits, base.where("modality <> 'text'").withColumnRenamed("rid", "record_id"), 3, 2, 1)


def reading_order(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    b = _read(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("record_id"), _modality(n).alias("modality"), F.when(n % 3 == 0, n).alias("page"), F.when(n % 3 != 2, n).alias("slide"), F.when(n % 2 == 0, F.lit("S")).alias("sheet"), F.when(n % 4 != 0, F.col("l_discount").cast("double")).alias("top"), F.col("l_tax").cast("double").alias("left"))
    return S.reading_order(b).select("query_id", "record_id", "place")


def verbatim_quotes(s: SparkSession, d: str) -> DataFrame:
    t = _records(s, d)
    quote = F.concat(F.substring("text", 5, F.element_at(F.array(F.lit(3), F.lit(30), F.lit(60)), (1 + F.col("id") % 3).cast("int"))), F.when(F.col("id") % 4 == 0, F.lit("#zz")).otherwise(""))
    return t.select("id", S.verbatim(quote, F.substring("text", 1, 50), F.substring("text", 51, 60)).alias("verbatim"))


def _mod(c: str) -> str:
    return f"['text', 'table', 'visual'][({c}) % 3 + 1]"


_KW = f"""{_BM25}, {_EXACT}, kws AS (SELECT bm.query_id, bm.id, score, ex.id IS NOT NULL AS exact, {_mod("bm.id")} AS modality FROM bm LEFT JOIN ex ON ex.query_id = bm.query_id AND ex.id = bm.id),
kwr AS (SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY exact DESC, round(score, 9) DESC, id) AS keyword_rank FROM kws)"""
_CAND = f"""{_KW}, raw AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_IP} AS raw, {_mod("b.vec_id")} AS modality FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY round(raw, 9) DESC, id) AS vector_rank FROM raw) WHERE vector_rank <= 10),
kr AS (SELECT * FROM kwr WHERE keyword_rank <= 10),
cand AS (SELECT query_id, id, raw.raw, raw.modality, coalesce(vector_rank, 0) AS vector_rank, keyword_rank, coalesce(exact, false) AS exact FROM (SELECT query_id, id FROM vr UNION SELECT query_id, id FROM kr)
  JOIN raw USING (query_id, id) LEFT JOIN (SELECT query_id, id, vector_rank FROM vr) USING (query_id, id) LEFT JOIN (SELECT query_id, id, keyword_rank, exact FROM kr) USING (query_id, id)),
fused AS (SELECT *, CASE WHEN vector_rank > 0 THEN CASE WHEN modality = 'table' THEN 1.5 ELSE 1.0 END::DOUBLE / (60 + vector_rank) ELSE 0 END + coalesce(0.35::DOUBLE / (60 + keyword_rank), 0) + CASE WHEN exact THEN 0.75::DOUBLE / 61 ELSE 0 END AS fusion
  FROM cand WHERE raw >= CASE WHEN modality = 'visual' THEN 0.2 ELSE 0.4 END OR keyword_rank IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 9) DESC, round(raw, 6) DESC, list_position(['text', 'table', 'visual'], modality), id) AS place FROM fused)"""
_SAME = "(y.id = p.id OR (y.m = p.modality AND y.d = p.id % 3 AND ((p.id % 4 <> 0 AND y.h = p.id % 9) OR (p.modality = 'text' AND abs(y.b - p.id // 3 % 6) <= 1))))"
_BLK = f"""{_BM25}, bl AS (SELECT query_id, rank, b AS block, bmr.id + b AS i FROM bmr, (SELECT unnest([0, 1]) AS b) WHERE rank <= 6),
bk AS (SELECT *, 'r' || (i % 5) AS record_id, i % 2 AS document_id, ['text', 'table', 'visual', 'sound'][i % 4 + 1] AS modality, ['core', 'neighbor', 'related', 'related'][i % 4 + 1] AS role FROM bl WHERE i % 4 <> 3 AND (i % 6 <> 0 OR i % 12 = 0)),
ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, modality, record_id ORDER BY (i % 3 <> 0), list_position(['core', 'neighbor', 'related'], role), (i % 5 <> 0), rank, list_position(['text', 'table', 'visual'], modality), block, record_id) AS b1 FROM bk),
ev AS (SELECT *, printf('E%03d', row_number() OVER (PARTITION BY query_id ORDER BY (i % 3 <> 0), list_position(['core', 'neighbor', 'related'], role), (i % 5 <> 0), rank, list_position(['text', 'table', 'visual'], modality), block, record_id)) AS evidence_id FROM ok WHERE b1 = 1)"""
_STOP = "', '".join(S.STOP)
_TOK = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+(?:[-./][a-z0-9]+)*'), lambda t: length(t) > 1 AND NOT list_contains(['{_STOP}'], t)))"
_SQL = {
    "keyword_ranks": f"WITH {_KW} SELECT query_id, modality, id, exact, keyword_rank FROM kwr WHERE keyword_rank <= 8",
    "vector_topk_filtered": f"""SELECT query_id, modality, id, vector_rank, round(raw, 5) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY round(raw, 9) DESC, id) AS vector_rank
FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_mod("b.vec_id")} AS modality, {_IP} AS raw FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 7 IN (0, 1, 2, 4, 5) AND b.vec_id % 11 % 3 < 2
  AND NOT (b.vec_id % 3 = 2 AND (b.vec_id % 13 = 0 OR b.vec_id % 17 = 0 OR (b.vec_id % 11 % 3 = 0 AND b.vec_id % 2 = 0))))) WHERE vector_rank <= 5""",
    "hybrid_by_modality": f"WITH {_CAND} SELECT query_id, id, modality, place, round(fusion, 7) AS fusion FROM placed WHERE place <= 12",
    "dedup_block_overlap": f"""WITH RECURSIVE {_CAND}, p AS MATERIALIZED (SELECT query_id, id, modality, place FROM placed WHERE place <= 20),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS place, []::STRUCT(id BIGINT, m VARCHAR, d BIGINT, h BIGINT, b BIGINT)[] AS taken FROM p
  UNION ALL SELECT f.query_id, p.place, CASE WHEN len(taken) >= 6 OR len(list_filter(taken, lambda y: {_SAME})) > 0 THEN taken
    ELSE list_append(taken, struct_pack(id := p.id, m := p.modality, d := p.id % 3, h := CASE WHEN p.id % 4 <> 0 THEN p.id % 9 ELSE -1 END, b := p.id // 3 % 6)) END FROM f JOIN p ON p.query_id = f.query_id AND p.place = f.place + 1),
z AS (SELECT query_id, taken FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place DESC) = 1)
SELECT query_id, x.id AS id, r AS rank FROM (SELECT query_id, unnest(taken) AS x, unnest(range(1, len(taken) + 1)) AS r FROM z)""",
    "text_rerank": f"""WITH {_CAND}, toks AS (SELECT doc_id AS id, body, list_distinct(toks) AS toks FROM (SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', ' ', 'g')) AS body FROM documents) JOIN docs ON docs.id = doc_id),
qs AS (SELECT item_id AS query_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS question FROM benchmark), qt AS (SELECT query_id, question, list_distinct(regexp_extract_all(question, '[a-z0-9]+(?:[-_.:/][a-z0-9]+)*')) AS want FROM qs),
sc AS (SELECT p.*, fusion + CASE WHEN modality = 'text' AND body <> '' AND question <> '' THEN 0.35::DOUBLE * least(1.0, CASE WHEN len(want) > 0 THEN 0.45::DOUBLE * len(list_intersect(want, toks)) / len(want) ELSE 0 END + CASE WHEN contains(body, question) THEN 0.7 ELSE 0 END
   + CASE WHEN exact THEN 0.2 ELSE 0 END + coalesce(0.1::DOUBLE / keyword_rank, 0)) / 61 ELSE 0 END AS f2 FROM placed p JOIN toks USING (id) JOIN qt USING (query_id) WHERE place <= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f2, 9) DESC, place) AS n, CASE WHEN modality = 'text' AND vector_rank > 0 THEN row_number() OVER (PARTITION BY query_id, modality = 'text' AND vector_rank > 0 ORDER BY round(raw, 9) DESC, vector_rank) END AS a FROM sc),
m AS (SELECT *, coalesce(a <= 2, false) AND n > 6 AS missing FROM n), c AS (SELECT *, sum(CASE WHEN missing THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS m, row_number() OVER (PARTITION BY query_id, missing ORDER BY a) AS front FROM m)
SELECT query_id, id, (CASE WHEN missing THEN front ELSE n + m END)::INTEGER AS rank, round(f2, 7) AS fusion FROM c WHERE missing OR n <= 6 - m""",
    "variant_interleave": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY qv ORDER BY round(raw, 9) DESC, id) AS rank FROM (SELECT a.vec_id AS qv, b.vec_id AS id, {_IP} AS raw FROM embeddings a, embeddings b WHERE a.vec_id % 100 < 3)),
v AS (SELECT qv - qv % 100 AS query_id, qv % 100 AS variant, id, rank, raw FROM r WHERE rank <= 30), g AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(max(raw), 9) DESC, id) AS rank FROM v GROUP BY query_id, id),
e AS (SELECT query_id, id, 0 AS pass, rank, variant FROM v WHERE rank <= least(30, greatest(2, ceil(10.0 / 3) + 2)) UNION ALL SELECT query_id, id, 1, rank, 0 FROM g WHERE rank <= 30),
o AS (SELECT query_id, id, pass, rank AS turn, variant FROM e QUALIFY row_number() OVER (PARTITION BY query_id, id % 150 ORDER BY pass, rank, variant, id) = 1)
SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pass, turn, variant, id) AS rank FROM o) WHERE rank <= 10""",
    "evidence_normalize": f"WITH {_BLK} SELECT query_id, document_id, modality, record_id, rank, role, evidence_id FROM ev",
    "selection_cap": f"""WITH {_BLK}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY list_position(['core', 'related', 'neighbor'], role), list_position(['table', 'text', 'visual'], modality), evidence_id) AS t FROM ev)
SELECT * FROM (SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY t, rank) AS place FROM t) WHERE place <= 4""",
    "coverage_score": f"""WITH {_BM25}, c AS (SELECT query_id, printf('E%03d', rank) AS evidence_id, list_intersect({_TOK.format("b.text")}, {_TOK.format("coalesce(x.text, '')")}) AS m FROM bmr JOIN benchmark b ON item_id = query_id JOIN documents x ON x.doc_id = bmr.id WHERE rank <= 8),
w AS (SELECT *, coalesce(list_sum(list_transform(m, lambda t: CASE WHEN regexp_matches(t, '[0-9]|-') THEN 3.0 WHEN length(t) >= 5 THEN 1.5 ELSE 1.0 END)), 0)::DOUBLE AS w, len(list_filter(m, lambda t: regexp_matches(t, '[0-9]|-'))) > 0 AS id FROM c)
SELECT query_id, evidence_id, len(m)::INTEGER AS n, round(w, 4) AS weight, CASE WHEN w >= 3 OR id THEN 'direct' ELSE 'none' END AS support, CASE WHEN w >= 3 OR id THEN round(least(1, w / 8), 6) ELSE 0 END AS score FROM w""",
    "neighbour_chain": """WITH w AS (SELECT doc_id AS id, unnest(range(0, length(text), 336)) // 336 AS o FROM documents WHERE length(text) > 0), c AS (SELECT *, sha256(id || chr(0) || 'text' || chr(0) || o) AS r FROM w WHERE NOT (o = 3 AND id % 11 = 0)),
h AS (SELECT unnest([-1, 1, 2]) AS hop)
SELECT a.id AS query_id, a.r AS anchor_id, b.r AS record_id, CASE WHEN hop < 0 THEN 'previous_context' ELSE 'next_context' END AS relation, hop FROM c a, h JOIN c b ON b.id = a.id AND b.o = a.o + hop
WHERE a.o % 4 = 2 AND (hop < 2 OR EXISTS (SELECT 1 FROM c m WHERE m.id = a.id AND m.o = a.o + 1))""",
    "neighbour_offsets": "SELECT a.doc_id AS query_id, a.doc_id AS anchor_id, b.doc_id AS record_id, (b.doc_id - a.doc_id)::INTEGER AS hop FROM documents a JOIN documents b ON b.doc_id - a.doc_id IN (-1, 1, 2) AND a.doc_id // 7 = b.doc_id // 7 WHERE a.doc_id % 5 = 0",
    "text_anchor": f"""WITH t AS (SELECT conv_id * 100 + turn AS r, conv_id, turn // 3 AS page, turn, coalesce(text, '') AS text, {"trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', ' ', 'g'))"} AS body FROM conversations),
q AS (SELECT *, trim(regexp_replace(replace(lower(substring(text, 3, 8)), 'ß', 'ss'), '\\s+', ' ', 'g')) AS question FROM t WHERE turn % 3 = 1)
SELECT q.conv_id AS query_id, q.r AS id, (arg_min(t.r, CASE WHEN contains(t.body, q.question) THEN 0 ELSE 1000000 END + t.turn)) AS anchor_id FROM q JOIN t ON t.conv_id = q.conv_id AND t.page = q.page GROUP BY q.conv_id, q.r""",
    "page_excerpts": """WITH t AS (SELECT conv_id * 100 + turn AS r, conv_id, turn // 3 AS page, turn, coalesce(text, '') AS text, CASE WHEN turn % 4 <> 3 THEN 1.0::DOUBLE / (1 + turn % 3) ELSE 'infinity'::DOUBLE END AS top FROM conversations),
p AS (SELECT q.r AS id, t.r AS r, t.text, row_number() OVER (PARTITION BY q.r ORDER BY t.top, t.r) AS n FROM t q JOIN t ON t.conv_id = q.conv_id AND t.page = q.page WHERE q.turn % 3 = 0)
SELECT id, md5(string_agg('同页文本记录 ' || r || '：' || chr(10) || substring(text, 1, 50), chr(10) || chr(10) ORDER BY n)) AS excerpts_md5 FROM p WHERE n <= 2 AND trim(text) <> '' GROUP BY id""",
    "related_records": f"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS rid, l_orderkey AS o, l_returnflag AS c, l_discount AS x, l_tax AS y, {_mod("l_linenumber")} AS m, floor(l_quantity / 20) AS v FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey * 10 + l_linenumber) = 1),
j AS (SELECT a.o AS query_id, a.rid AS id, b.c, b.rid AS record_id, b.m, b.v, round(abs((a.x + a.x + 0.2::DOUBLE) / 2 - (b.x + b.x + 0.2::DOUBLE) / 2) + abs((a.y + a.y + 0.1::DOUBLE) / 2 - (b.y + b.y + 0.1::DOUBLE) / 2), 9) AS far FROM l a JOIN l b ON a.o = b.o AND a.c = b.c WHERE a.m = 'text' AND b.m <> 'text'),
k AS (SELECT *, row_number() OVER (PARTITION BY id, c, m ORDER BY v DESC, far, m <> 'table', record_id) AS n FROM j), p AS (SELECT *, row_number() OVER (PARTITION BY id, c ORDER BY v DESC, far, m <> 'table', record_id) AS q FROM k WHERE n <= 1)
SELECT * FROM (SELECT query_id, id, record_id, row_number() OVER (PARTITION BY id ORDER BY c, q) AS rank FROM p WHERE q <= 2) WHERE rank <= 3""",
    "reading_order": f"""SELECT l_orderkey AS query_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS record_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 <> 2 THEN 1 WHEN l_linenumber % 2 = 0 THEN 2 ELSE 3 END,
CASE WHEN l_linenumber % 3 <> 2 THEN l_linenumber END, CASE WHEN l_linenumber % 2 = 0 THEN 'S' END NULLS FIRST, CASE WHEN l_linenumber % 4 <> 0 THEN l_discount ELSE 'infinity'::DOUBLE END, l_tax, list_position(['text', 'table', 'visual'], {_mod("l_linenumber")}), concat_ws('-', l_partkey, l_suppkey, l_linenumber)) AS place FROM lineitem""",
    "verbatim_quotes": f"""WITH n AS (SELECT doc_id AS id, coalesce(text, '') AS text, substring(coalesce(text, ''), 5, [3, 30, 60][doc_id % 3 + 1]) || CASE WHEN doc_id % 4 = 0 THEN '#zz' ELSE '' END AS quote FROM documents),
z AS (SELECT id, {"trim(regexp_replace(replace(lower(quote), 'ß', 'ss'), '\\s+', ' ', 'g'))"} AS q, {"trim(regexp_replace(replace(lower(substring(text, 1, 50)), 'ß', 'ss'), '\\s+', ' ', 'g'))"} AS a, {"trim(regexp_replace(replace(lower(substring(text, 51, 60)), 'ß', 'ss'), '\\s+', ' ', 'g'))"} AS b, length(regexp_replace(lower(quote), '[^0-9a-z一-鿿]', '', 'g')) AS n FROM n)
SELECT id, n >= 4 AND (contains(a, q) OR contains(b, q)) AS verbatim FROM z""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (keyword_ranks, vector_topk_filtered, hybrid_by_modality, dedup_block_overlap, text_rerank, variant_interleave, evidence_normalize, selection_cap, coverage_score, coverage_order, neighbour_chain, neighbour_offsets, text_anchor, page_excerpts, related_records, reading_order, verbatim_quotes)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
