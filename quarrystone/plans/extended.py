"""Registered queries of tables, structure and evidence, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators import evidence, structure, tables
from quarrystone.operators import records as R
from quarrystone.operators import retrieval as Q
from quarrystone.plans.registry import _BM25, _IP, _items, _ranked, _read, _records, _vectors
from quarrystone.sources.files import format_of
from quarrystone.sources.snapshots import problems
from quarrystone.streaming.ingest import windowed_counts


def markdown_tables(s: SparkSession, d: str) -> DataFrame:
    """One Markdown table per nation's customers, written and parsed again; every fifth row has one more cell."""
    third = F.when(F.col("c_custkey") % 5 == 0, " extra |").otherwise("")
    line = F.concat(F.lit("| "), F.col("c_custkey").cast("string"), F.lit(" | "), F.col("c_mktsegment"), F.lit("\\|x |"), third)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "\n")
    text = _read(s, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("| key | segment |\n| --- | :---: |\n"), body).alias("text"))
    t = text.select("c_nationkey", tables.markdown_table(F.col("text")).alias("t"))
    rows = t.select("c_nationkey", F.array_join("t.headers", ";").alias("headers"), F.posexplode("t.rows").alias("row", "cells"))
    return rows.select("c_nationkey", "headers", "row", F.array_join("cells", ";").alias("cells"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """lineitem with a place in its order that no two rows share."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return _read(s, d, "lineitem").withColumn("place", F.row_number().over(own))


def dense_rows(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    cells = _lines(s, d).select(
        F.col("l_orderkey").alias("id"), F.col("place").alias("ordinal"), n.alias("row"), (1 + n % 3).alias("column"), (1 + F.col("l_partkey") % 2).cast("int").alias("row_span"),
        (1 + F.col("l_suppkey") % 2).cast("int").alias("column_span"), F.col("l_partkey").cast("string").alias("value"),
    )
    return tables.dense_rows(cells).select("id", "row", F.array_join("values", ",").alias("cells"))


def title_paths(s: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("l_quantity") > 20, (1 + F.col("l_partkey") % 3).cast("int"))
    blocks = _lines(s, d).select(F.col("l_orderkey").alias("id"), F.col("place").alias("ordinal"), level.alias("level"), F.col("l_partkey").cast("string").alias("title"))
    return structure.title_paths(blocks).select("id", "ordinal", F.array_join("path", "/").alias("path"))


def split_long(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select("id", F.posexplode(structure.split_long(F.col("text"))).alias("piece", "body"))


def smallest_container(s: SparkSession, d: str) -> DataFrame:
    left, top = (F.col("l_linenumber") - 1) * F.lit(0.05), F.col("l_discount")
    box = F.array(left, top, left + F.col("l_quantity") / 50, top + 0.05 + F.col("l_tax") * 5)
    boxes = _lines(s, d).select(F.col("l_orderkey").alias("group"), F.col("place").alias("id"), box.alias("box"))
    return structure.smallest_container(boxes).select(F.col("group").alias("l_orderkey"), F.col("id").alias("place"), "parent")


def variant_merge(s: SparkSession, d: str) -> DataFrame:
    """Two variants of every hundredth vector as query: itself and its successor."""
    v = _vectors(s, d)
    pick = lambda k: v.where(f"id % 100 = {k}").select(F.col("id").alias("query_id"), "vector")
    hits = Q.vector_topk(v, pick(0).unionByName(pick(1)), 10).withColumn("query_id", F.col("query_id") - F.col("query_id") % 100)
    none = hits.withColumns({"keyword_rank": F.lit(None).cast("int"), "keyword_score": F.lit(0.0), "exact": F.lit(False)})
    return evidence.merge_variants(none).select("query_id", "id", "vector_rank", F.round("raw", 5).alias("raw"))


def evidence_budget(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("document"), F.coalesce("lang", F.lit("")).alias("container"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return evidence.within_budget(Q.with_records(_ranked(s, d, 30), docs, _items(s, d), 30), 10, 8000, 4, 2, 2000)


def page_formats(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "pages").select("page_id", format_of(F.concat("url", F.element_at(F.array(*map(F.lit, (".html", ".PDF", ".tiff", ".xlsm", ".exe", ""))), (1 + F.col("page_id") % 6).cast("int")))).alias("document_type"))


def record_problems(s: SparkSession, d: str) -> DataFrame:
    """The chunk windows of the documents without the first of each fifth: its successor has a dangling link."""
    w = R.windows(_records(s, d)).where("NOT (ordinal = 0 AND id % 5 = 0)")
    return problems(w).groupBy("problem").agg(F.count("*").alias("n"))


def windowed_events(s: SparkSession, d: str) -> DataFrame:
    out = windowed_counts(_read(s, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


_OVERLAP = "greatest(0.0, least(c.x1, p.x1) - greatest(c.x0, p.x0)) * greatest(0.0, least(c.y1, p.y1) - greatest(c.y0, p.y0))"
_AREA = "(greatest(0.0, {0}.x1 - {0}.x0) * greatest(0.0, {0}.y1 - {0}.y0))"
_FITS = """(len(f.docs) < 10 AND len(list_filter(f.docs, lambda x: x = o.document)) < 4 AND len(list_filter(f.conts, lambda x: x = o.document || chr(0) || o.container)) < 2 AND f.used + o.cost <= 8000)"""
_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS place FROM lineitem)"
_SQL = {
    "markdown_tables": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row, max(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey) AS wide FROM customer)
SELECT c_nationkey, 'key;segment' || CASE WHEN wide = 1 THEN ';column_3' ELSE '' END AS headers, row,
c_custkey || ';' || c_mktsegment || '|x' || CASE WHEN wide = 0 THEN '' WHEN c_custkey % 5 = 0 THEN ';extra' ELSE ';' END AS cells FROM c""",
    "dense_rows": f"""WITH {_LINES}, c AS (SELECT l_orderkey AS id, place AS o, l_linenumber AS r, 1 + l_linenumber % 3 AS k, l_partkey % 2 AS rs, l_suppkey % 2 AS ks, l_partkey AS v FROM lines),
g AS (SELECT id, min(r) AS r0, max(r) AS r1, min(k) AS c0, max(k) AS c1 FROM c GROUP BY id),
p AS (SELECT id, r, unnest(range(c0, c1 + 1)) AS k FROM (SELECT id, c0, c1, unnest(range(r0, r1 + 1)) AS r FROM g)),
f AS (SELECT p.id, p.r, p.k, arg_max(c.v, c.o) AS v FROM p LEFT JOIN c ON c.id = p.id AND p.r BETWEEN c.r AND c.r + c.rs AND p.k BETWEEN c.k AND c.k + c.ks GROUP BY ALL)
SELECT f.id, f.r - r0 AS row, string_agg(coalesce(v::VARCHAR, ''), ',' ORDER BY k) AS cells FROM f JOIN g USING (id) GROUP BY f.id, f.r, r0""",
    "title_paths": f"""WITH RECURSIVE {_LINES}, b AS (SELECT l_orderkey AS id, place AS ordinal, place AS i,
  CASE WHEN l_quantity > 20 THEN 1 + l_partkey % 3 END AS level, l_partkey::VARCHAR AS title FROM lines),
p AS (SELECT id, ordinal, i, CASE WHEN level IS NULL THEN []::VARCHAR[] ELSE [title] END AS path FROM b WHERE i = 1
  UNION ALL SELECT b.id, b.ordinal, b.i, CASE WHEN level IS NULL THEN path ELSE list_concat(path[1:level - 1], [title]) END FROM p JOIN b ON b.id = p.id AND b.i = p.i + 1)
SELECT id, ordinal, array_to_string(path, '/') AS path FROM p""",
    "split_long": """WITH RECURSIVE d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
l AS (SELECT id, list_filter(string_split(regexp_replace(regexp_replace(text, '([。！？!?；;.])\\s*', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM d WHERE length(text) > 384),
s AS MATERIALIZED (SELECT id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS n FROM l),
f AS (SELECT id, 0::BIGINT AS n, []::VARCHAR[] AS done, '' AS o FROM l
  UNION ALL SELECT f.id, s.n, CASE WHEN length(CASE WHEN o = '' THEN t ELSE o || chr(10) || t END) <= 384 THEN done WHEN length(t) <= 384 THEN CASE WHEN o = '' THEN done ELSE list_append(done, o) END
      ELSE list_concat(CASE WHEN o = '' THEN done ELSE list_append(done, o) END, list_transform(range(0, length(t), 336), lambda k: substring(t, k + 1, 384))) END,
    CASE WHEN length(CASE WHEN o = '' THEN t ELSE o || chr(10) || t END) <= 384 THEN CASE WHEN o = '' THEN t ELSE o || chr(10) || t END WHEN length(t) <= 384 THEN t ELSE '' END FROM f JOIN s ON s.id = f.id AND s.n = f.n + 1),
z AS (SELECT id, CASE WHEN o = '' THEN done ELSE list_append(done, o) END AS p FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)
SELECT id, unnest(range(len(p)))::INTEGER AS piece, unnest(p) AS body FROM z UNION ALL SELECT id, 0, text FROM d WHERE length(text) <= 384""",
    "smallest_container": f"""WITH {_LINES}, b AS (SELECT l_orderkey, place, (l_linenumber - 1) * 0.05::DOUBLE AS x0, l_discount AS y0, (l_linenumber - 1) * 0.05::DOUBLE + l_quantity / 50 AS x1, l_discount + 0.05::DOUBLE + l_tax * 5 AS y1 FROM lines),
m AS (SELECT c.l_orderkey, c.place, p.place AS parent, row_number() OVER (PARTITION BY c.l_orderkey, c.place ORDER BY {_AREA.format("p")}, p.place) AS best
  FROM b c JOIN b p ON c.l_orderkey = p.l_orderkey AND c.place <> p.place
  WHERE {_AREA.format("c")} > 0 AND {_OVERLAP} >= 0.92::DOUBLE * {_AREA.format("c")} AND {_AREA.format("p")} > 1.05::DOUBLE * {_AREA.format("c")})
SELECT b.l_orderkey, b.place, parent FROM b LEFT JOIN m ON m.l_orderkey = b.l_orderkey AND m.place = b.place AND best = 1""",
    "variant_merge": f"""SELECT query_id - query_id % 100 AS query_id, id, min(vector_rank) AS vector_rank, round(max(raw), 5) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS vector_rank
FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_IP} AS raw FROM embeddings a, embeddings b WHERE a.vec_id % 100 IN (0, 1))) WHERE vector_rank <= 10 GROUP BY ALL""",
    "evidence_budget": f"""WITH RECURSIVE {_BM25}, h AS (SELECT query_id, bmr.id, rank, coalesce(source, '') AS document, coalesce(lang, '') AS container, least(2000, length(coalesce(text, ''))) AS cost
  FROM bmr JOIN documents ON doc_id = bmr.id WHERE rank <= 30),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, document) AS lead_rank FROM h),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, lead_rank) AS n FROM t),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS n, []::BIGINT[] AS ids, []::VARCHAR[] AS docs, []::VARCHAR[] AS conts, 0::BIGINT AS used FROM o
  UNION ALL SELECT f.query_id, o.n, CASE WHEN {_FITS} THEN list_append(f.ids, o.id) ELSE f.ids END, CASE WHEN {_FITS} THEN list_append(f.docs, o.document) ELSE f.docs END,
  CASE WHEN {_FITS} THEN list_append(f.conts, o.document || chr(0) || o.container) ELSE f.conts END, CASE WHEN {_FITS} THEN f.used + o.cost ELSE f.used END
  FROM f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1),
z AS (SELECT query_id, ids FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1),
u AS (SELECT query_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM z)
SELECT query_id, id, place, printf('E%03d', place) AS evidence_id FROM u""",
    "page_formats": "SELECT page_id, ['html', 'pdf', 'image', 'xlsx', NULL, CASE WHEN regexp_matches(url, '[.]html?$') THEN 'html' END][page_id % 6 + 1] AS document_type FROM pages",
    "record_problems": """WITH n AS (SELECT doc_id, (length(text) - 1) // 336 AS last FROM documents WHERE length(text) > 0 AND doc_id % 5 = 0)
SELECT 'dangling link' AS problem, count(*) AS n FROM n WHERE last >= 1 HAVING count(*) > 0""",
    "windowed_events": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (markdown_tables, dense_rows, title_paths, split_long, smallest_container, variant_merge, evidence_budget, page_formats, record_problems, windowed_events)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
