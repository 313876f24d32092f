"""Registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import compact, html_text, inner, lexical_tokens, normalized
from quarrystone.operators import records as R
from quarrystone.operators import retrieval as Q
from quarrystone.operators import summary as M

_NORM = "trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_TOKENS = f"regexp_extract_all({_NORM}, '[a-z0-9]+(?:[-_.:/][a-z0-9]+)*')"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(s, d):
    return _read(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _items(s, d):
    return _read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(s, d):
    return _read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def lexical(s, d):
    t = lexical_tokens(F.col("text"))
    return _records(s, d).select("id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.md5(normalized(F.col("text"))).alias("norm_md5"))


def _ranked(s, d, k):
    """The k best documents of every item by BM25."""
    return Q.ranked(Q.bm25_best(_records(s, d), _items(s, d), k), k)


def bm25_topk(s, d):
    return _ranked(s, d, 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def exact_phrase(s, d):
    return Q.exact_phrases(_records(s, d), _items(s, d))


def vector_topk(s, d):
    v = _vectors(s, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return Q.vector_topk(v, q, 10).select("query_id", "id", "vector_rank", F.round("raw", 5).alias("raw"))


def _fused(s, d, k):
    v, items = _vectors(s, d), _items(s, d)
    q = items.join(v, F.col("query_id") == F.col("id")).select("query_id", "vector")
    hits = Q.ranked(Q.bm25_best(_records(s, d), items, 30, phrases=True), 30, name="keyword_rank")
    return Q.fuse(Q.vector_topk(v, q, 30), hits, k)


def hybrid_fusion(s, d):
    return _fused(s, d, 10).select("query_id", "id", "rank", F.round("fusion", 7).alias("fusion"))


def distinct_hits(s, d):
    hits = Q.with_records(_ranked(s, d, 30), _records(s, d), _items(s, d), 30)
    return Q.distinct_hits(hits.withColumn("content_hash", F.sha2(normalized(F.col("text")), 256)).drop("text"), 10).select("query_id", "id", "rank")


def retrieval_metrics(s, d):
    return Q.metrics(exact_phrase(s, d), _ranked(s, d, 10))


def _turns(s, d):
    return _read(s, d, "conversations").withColumnRenamed("conv_id", "id")


def neighbour_window(s, d):
    return M.turn_windows(_turns(s, d)).withColumnRenamed("id", "conv_id")


def nearest_context(s, d):
    return M.nearest_marked(_turns(s, d), F.col("role") == "user").where("role <> 'user'").select(F.col("id").alias("conv_id"), "turn", "role", "before", "after")


def paragraphs(s, d):
    return R.paragraphs(_records(s, d)).select("id", "line_start", "line_end", "reading_order", F.md5("body").alias("body_md5"))


def page_text(s, d):
    t = html_text(F.col("html"))
    return _read(s, d, "pages").select("page_id", F.md5(t).alias("text_md5"), F.length(t).alias("n_chars"))


def chunk_windows(s, d):
    return R.windows(_records(s, d)).select("id", "ordinal", "record_id", "previous_record_id", "next_record_id", F.md5("body").alias("body_md5"))


def table_segments(s, d):
    out = R.table_segments(_read(s, d, "customer"), "c_nationkey", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])
    return out.select("c_nationkey", "segment", "n_rows", F.md5("body").alias("body_md5"))


def representatives(s, d):
    return M.representatives(_records(s, d))


def snapshot_changes(s, d):
    """The documents' texts now and in an earlier state, with some texts altered, missing or since gone."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    now = _read(s, d, "documents").where(i % 9 != 0).select(i.alias("key"), F.sha2(t, 256).alias("digest"))
    before = _read(s, d, "documents").where(i % 8 != 0).select(i.alias("key"), F.sha2(F.when(i % 5 == 0, F.concat(t, F.lit(" "))).otherwise(t), 256).alias("digest"))
    return R.snapshot_changes(now, before)


def document_counts(s, d):
    return M.document_counts(_read(s, d, "documents"), ["lang", "source"])


def ocr_routing(s, d):
    return M.ocr_routes(_read(s, d, "documents"), "source")


def latency_stats(s, d):
    r = lambda c: F.round(c, 5).alias(c)
    return M.timing_stats(_read(s, d, "events"), "event_type").select("event_type", "n", r("mean"), r("median"), F.round("p", 5).alias("p95"))


def vector_integrity(s, d):
    norm = F.sqrt(inner(F.col("vector"), F.col("vector")))
    v = _vectors(s, d).select("id", F.size("vector").alias("dim"), norm.alias("norm"))
    return v.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"), F.count_if(F.abs(F.col("norm") - 1) > 1e-3).alias("n_bad"))


def eligible_documents(s, d):
    gate = _read(s, d, "labels").where("toxic = 1").select("doc_id")
    return _read(s, d, "documents").where(F.col("lang").isin("en", "de")).join(gate, "doc_id", "left_anti").select("doc_id", "lang", "source")


def round_robin(s, d):
    return R.interleave(_read(s, d, "documents").select("doc_id", "source"), "source", "doc_id")


def quote_match(s, d):
    return _items(s, d).select("query_id", F.md5(compact(F.col("text"))).alias("compact_md5"), F.length(compact(F.col("text"))).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_fusion(spark, sf_dir)


_BM25 = f"""docs AS (SELECT doc_id AS id, {_TOKENS} AS toks FROM documents),
wanted AS (SELECT query_id, token, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
tf AS (SELECT id, len, token, count(*) AS tf FROM (SELECT id, len(toks) AS len, unnest(toks) AS token FROM docs) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
tot AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM docs),
bm AS (SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) * qf) AS score
  FROM wanted JOIN tf USING (token) JOIN df USING (token), tot GROUP BY query_id, id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm)"""
_EXACT = f"""ex AS (SELECT item_id AS query_id, doc_id AS id FROM (SELECT item_id, {_NORM} AS phrase FROM benchmark)
  JOIN (SELECT doc_id, {_NORM} AS body FROM documents) ON contains(body, phrase))"""
_IP = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_UNESCAPED = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<[^>]+>', chr(10), 'g')"
for _a, _b in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_a}', {_b})"
_DOCS = "(SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)"

_SQL: dict[str, str] = {
    "lexical_tokens": f"SELECT doc_id AS id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_distinct, md5({_NORM}) AS norm_md5 FROM documents",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, id, rank, round(score, 5) AS score FROM bmr WHERE rank <= 10",
    "exact_phrase": f"WITH {_EXACT} SELECT * FROM ex",
    "vector_topk": f"SELECT query_id, id, vector_rank, round(raw, 5) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS vector_rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_IP} AS raw FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE vector_rank <= 10",
    "hybrid_fusion": f"""WITH {_BM25}, {_EXACT}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS vector_rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_IP} AS raw FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b)) WHERE vector_rank <= 30),
kw AS (SELECT bmr.query_id, bmr.id, rank AS keyword_rank, ex.id IS NOT NULL AS exact FROM bmr LEFT JOIN ex ON ex.query_id = bmr.query_id AND ex.id = bmr.id WHERE rank <= 30),
f AS (SELECT coalesce(v.query_id, kw.query_id) AS query_id, coalesce(v.id, kw.id) AS id, raw,
  coalesce(1.0 / (60 + vector_rank), 0) + coalesce(0.35 / (60 + keyword_rank), 0) + CASE WHEN exact THEN 0.75 / 61 ELSE 0 END AS fusion
  FROM v FULL JOIN kw ON v.query_id = kw.query_id AND v.id = kw.id WHERE raw >= 0.4 OR keyword_rank IS NOT NULL)
SELECT query_id, id, rank, round(fusion, 7) AS fusion FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 9) DESC, round(coalesce(raw, -1), 6) DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "distinct_hits": f"""WITH {_BM25}, h AS (SELECT bmr.*, sha256(body) AS content_hash FROM bmr JOIN (SELECT doc_id, {_NORM} AS body FROM documents) ON doc_id = id WHERE rank <= 30),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS place FROM h)
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM one WHERE place = 1) WHERE rank <= 10""",
    "retrieval_metrics": f"""WITH {_BM25}, {_EXACT}, f AS (SELECT ex.query_id, rank, CASE WHEN rank <= 5 THEN 1 ELSE 0 END AS at5, CASE WHEN rank <= 10 THEN 1 ELSE 0 END AS at10
  FROM ex LEFT JOIN (SELECT * FROM bmr WHERE rank <= 10) b ON b.query_id = ex.query_id AND b.id = ex.id),
e AS (SELECT query_id, count(*) AS n, sum(at5) AS at5, sum(at10) AS at10, max(at10) AS any10, min(at10) AS all10, coalesce(1 / min(rank), 0) AS rr FROM f GROUP BY query_id)
SELECT count(*) AS n_queries, round(sum(at5) / sum(n), 6) AS recall_5, round(sum(at10) / sum(n), 6) AS recall_10, round(avg(any10), 6) AS any_10, round(avg(all10), 6) AS all_10, round(avg(rr), 6) AS mrr FROM e""",
    "neighbour_window": "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS body FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "nearest_context": """SELECT conv_id, turn, role, before, after FROM (SELECT *, max(u) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min(u) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT *, CASE WHEN role = 'user' THEN turn END AS u FROM conversations)) WHERE role <> 'user'""",
    "paragraphs": f"""WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM {_DOCS}),
r AS (SELECT *, sum(CASE WHEN trim(line, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS run FROM l),
p AS (SELECT id, run, min(n) + 1 AS line_start, max(n) + 1 AS line_end, string_agg(line, chr(10) ORDER BY n) AS body FROM r WHERE trim(line, ' ') <> '' GROUP BY id, run)
SELECT id, line_start, line_end, row_number() OVER (PARTITION BY id ORDER BY run) - 1 AS reading_order, md5(body) AS body_md5 FROM p""",
    "page_text": f"SELECT page_id, md5({_UNESCAPED}) AS text_md5, length({_UNESCAPED}) AS n_chars FROM pages",
    "chunk_windows": f"""WITH w AS (SELECT id, text, unnest(range(0, length(text), 336)) // 336 AS ordinal FROM {_DOCS} WHERE length(text) > 0)
SELECT id, ordinal, sha256(id || chr(0) || 'text' || chr(0) || ordinal) AS record_id, CASE WHEN ordinal > 0 THEN sha256(id || chr(0) || 'text' || chr(0) || (ordinal - 1)) END AS previous_record_id,
CASE WHEN ordinal < (length(text) - 1) // 336 THEN sha256(id || chr(0) || 'text' || chr(0) || (ordinal + 1)) END AS next_record_id, md5(substring(text, ordinal * 336 + 1, 384)) AS body_md5 FROM w""",
    "table_segments": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, c_custkey || ' | ' || c_name || ' | ' || c_mktsegment AS line FROM customer)
SELECT c_nationkey, place // 20 AS segment, count(*) AS n_rows, md5('Columns: c_custkey | c_name | c_mktsegment' || chr(10) || string_agg(line, chr(10) ORDER BY place)) AS body_md5 FROM c GROUP BY c_nationkey, place // 20""",
    "representatives": f"SELECT sha256(text) AS sha256, min(id) AS id, count(*) AS n FROM {_DOCS} GROUP BY text",
    "snapshot_changes": """WITH n AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE '' END AS t FROM documents WHERE doc_id % 8 <> 0)
SELECT coalesce(n.doc_id, b.doc_id) AS key, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.t = b.t THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL JOIN b ON n.doc_id = b.doc_id""",
    "document_counts": "SELECT lang, source, count(*) AS n, count_if(length(text) >= 20) AS n_long, count(DISTINCT text) AS n_texts FROM documents GROUP BY lang, source",
    "ocr_routing": r"""WITH g AS (SELECT source, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n FROM documents),
a AS (SELECT source, sum(CASE WHEN n >= 20 THEN 1 ELSE 0 END)::BIGINT AS "full", sum(n)::BIGINT AS chars, count(*) AS pages FROM g GROUP BY source) SELECT *, "full" * 2 < pages OR chars < 20 * pages AS scan FROM a""",
    "latency_stats": """SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median, round(list_sort(list(value))[CAST(ceil(count(*) * 0.95) AS BIGINT)], 5) AS p95
FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "vector_integrity": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count_if(abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3) AS n_bad FROM embeddings",
    "eligible_documents": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "round_robin": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents",
    "quote_match": "SELECT item_id AS query_id, md5(regexp_replace(lower(text), '[^0-9a-z一-鿿]', '', 'g')) AS compact_md5, length(regexp_replace(lower(text), '[^0-9a-z一-鿿]', '', 'g')) AS n FROM benchmark",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarrystone.plans import answers, extended, hits, layout

    return {name: globals()["lexical" if name == "lexical_tokens" else name] for name in _SQL} | extended.queries() | answers.queries() | hits.queries() | layout.queries()


def oracle_sql() -> dict[str, str]:
    from quarrystone.plans import answers, extended, hits, layout

    return _SQL | extended.oracle_sql() | answers.oracle_sql() | hits.oracle_sql() | layout.oracle_sql()
