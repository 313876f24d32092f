"""Registered queries of the scalar expressions of questions and answers, and their SQL.

The tables hold no Han characters: questions are made of fixed wordings around the rows' ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import answers as A
from quarrystone.plans.registry import _NORM, _read, _records

WORDINGS = ("设备{}的参数有哪些", "请问设备{}有哪些功能", "如何清除设备{}的故障问题", "设备{}和设备{}的区别", "设备{}的额定电压是什么", "怎么办", "compare unit {} and unit {}", "设备{}")
CLAIMS = ("参数包括电压", "功能", "主要是各类项目", "x{}", "")
QUESTION_SQL = "CASE item_id % 8 " + " ".join(f"WHEN {k} THEN replace('{w}', '{{}}', item_id::VARCHAR)" for k, w in enumerate(WORDINGS)) + " END"
CLAIM_SQL = "CASE item_id % 5 " + " ".join(f"WHEN {k} THEN replace('{w}', '{{}}', item_id::VARCHAR)" for k, w in enumerate(CLAIMS)) + " END"


def _made(wordings: tuple[str, ...]):
    i = F.col("item_id").cast("string")
    return F.element_at(F.array(*[F.replace(F.lit(w), F.lit("{}"), i) for w in wordings]), (1 + F.col("item_id") % len(wordings)).cast("int"))


def question_analysis(s: SparkSession, d: str) -> DataFrame:
    q = _read(s, d, "benchmark").select("item_id", _made(WORDINGS).alias("q"), F.length("text").cast("int").alias("n"))
    intent, both, limits = A.list_intent(F.col("q")), A.subject_focus(F.col("q")), A.budget_limits(F.col("q"), F.col("n") % 12, F.lit(9), F.lit(12_000))
    return q.select(
        "item_id", A.query_focus(F.col("q")).alias("focus"), intent["subject"].alias("list_subject"), intent["focus"].alias("list_focus"), both["subject"].alias("subject"), both["focus"].alias("attribute"),
        A.procedure_focus(F.col("q")).alias("procedure"), A.is_compound(F.col("q")).alias("compound"), limits["items"].alias("items"), limits["chars"].alias("chars"),
    )


def list_claims(s: SparkSession, d: str) -> DataFrame:
    q = _read(s, d, "benchmark").select("item_id", A.list_intent(_made(WORDINGS)).alias("i"), _made(CLAIMS).alias("c"))
    ids = F.array(F.format_string("E%03d", F.col("item_id")), F.lit("E999"))
    return q.select("item_id", A.list_identity(F.col("c"), F.col("i")).alias("identity"), A.names_an_item(F.col("c"), F.col("i")).alias("concrete"), A.rendered_claim(F.concat("c", F.lit("  ")), ids).alias("rendered"))


def evidence_text(s: SparkSession, d: str) -> DataFrame:
    """Contents with one of several fields, their searchable text and their block in a prompt."""
    t, i = _records(s, d).select("id", F.substring("text", 1, 5000).alias("text")), F.col("id")
    blank, known = F.lit("  "), lambda k, c: F.when(i % 3 == k, c)
    content = F.create_map(F.lit("raw"), known(0, F.col("text")), F.lit("markdown"), known(1, blank), F.lit("text"), F.when(i % 3 != 0, F.concat(F.lit("t "), i.cast("string"))), F.lit("other"), F.lit("o"))
    content = F.when(i % 7 != 0, F.map_filter(content, lambda _, v: v.isNotNull()))
    only = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), i.cast("string"))
    place = A.location(F.struct(F.when(i % 2 == 0, i).alias("page"), F.lit(None).cast("int").alias("slide"), F.when(i % 5 == 0, F.lit("S")).alias("sheet"), F.when(i % 10 == 0, F.lit("A1:B2")).alias("cell_range")))
    block = A.prompt_block(F.format_string("E%03d", i % 1000), F.lit("a/b\\c.pdf"), F.lit("text"), F.lit("core"), F.col("place"), F.col("body"), F.col("context"))
    rows = t.select("id", A.content_text(content).alias("body"), A.content_text(only).alias("plain"), place.alias("place"), F.when(i % 4 == 0, F.col("text")).otherwise("").alias("context"), content.alias("content"))
    return rows.select("id", "plain", "place", F.md5("body").alias("body_md5"), F.md5(block).alias("block_md5"), F.md5(A.searchable(A.collapsed(F.col("body")), F.col("context"), F.map_filter(F.col("content"), lambda k, _: k == "other"))).alias("search_md5"))


def structure_text(s: SparkSession, d: str) -> DataFrame:
    """Headings, containers and bounded texts of the documents' beginnings."""
    i, t = F.col("id"), _records(s, d).select("id", F.col("text"))
    text = F.concat(F.element_at(F.array(F.lit("第三章 "), F.lit("2.1. "), F.lit("x "), F.lit(""), F.lit("4、")), (1 + i % 5).cast("int")), F.substring("text", 1, 100 + 7))
    level = F.when(i % 4 == 0, (i % 3).cast("int"))
    label = F.when(i % 11 == 0, F.lit("Title"))
    titles = F.array(F.lit("One"), F.trim(F.element_at(F.split(F.substring("text", 1, 30), "\n"), 1)))
    nth = lambda k, c: F.when(i % 4 == k, c)
    return t.select(
        "id", A.heading_level(text, level, label).alias("level"), A.container_key(nth(0, F.lit("S")), nth(1, i), F.when(i % 2 == 0, i)).alias("container"),
        F.md5(A.bounded_text(titles, F.substring("text", 40, 25), F.substring("text", 1, 30), 50)).alias("bounded_md5"),
        F.md5(A.layout_text(F.concat(F.lit("| a | :--- | "), F.substring("text", 1, 200)))).alias("layout_md5"), A.cell_value(F.concat(F.substring("text", 1, 9), F.lit("|\r\nz|"))).alias("cell"),
    )


def normal_tables(s: SparkSession, d: str) -> DataFrame:
    """One table per nation: a blank row, a title, then rows of customers of unequal length; key-value tables for every fifth nation."""
    cells = F.array("c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")))
    rows = _read(s, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.filter(cells, lambda c: c.isNotNull()).alias("r")))).alias("rows"))
    body = F.transform(F.slice("rows", 1, 5), lambda x: F.when(F.col("c_nationkey") % 5 == 0, F.slice(x["r"], 1, 2)).otherwise(x["r"]))
    one = lambda v: F.array(F.array(F.lit(v)))
    matrix = F.concat(one(" "), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.array(F.lit(""), F.lit("Customers")))).otherwise(F.array().cast("array<array<string>>")), body, one(""))
    t = rows.select("c_nationkey", A.normal_table(matrix, F.lit(True)).alias("t"))
    focused = A.focused_rows(F.col("t.rows"), F.lit("building"))
    text = A.table_text(F.col("t.title"), F.col("t.headers"), F.col("t.rows"), F.when(F.col("c_nationkey") % 3 == 0, F.lit("A1:C9")))
    return t.select("c_nationkey", F.col("t.title").alias("title"), F.array_join("t.headers", ";").alias("headers"), F.size("t.rows").alias("n"), F.size(focused).alias("n_focused"), F.md5(text).alias("text_md5"))


def replies(s: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id").cast("string")
    shapes = [F.concat(F.lit(a), i, F.lit(b)) for a, b in (('{"x": ', "}"), ('```json\n{"properties": {"x": "', '"}}\n```'), ('[{"x": ', "}]"), ('[{"x": 1}, {"x": ', "}]"), ("", ""), ("{", ""))]
    q = _read(s, d, "benchmark").select("item_id", A.plain_json(F.element_at(F.array(*shapes), (1 + F.col("item_id") % 6).cast("int"))).alias("j"))
    return q.select("item_id", F.col("j").isNotNull().alias("valid"), A.unwrapped(F.col("j"), "x").alias("x"))


def boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes in page units from either corner, and distances of two hashes."""
    l = _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    n = F.col("l_linenumber").cast("double")
    box = A.normal_box(F.array(n, n * 2, n + 10, n * 2 + F.col("l_quantity")), F.lit(200.0), F.lit(100.0), F.col("l_partkey") % 2 == 0)
    hashes = lambda c: F.array(F.col(c), F.col(c) * 31, F.col(c) * 7, F.col("l_orderkey"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(box[0], 6).alias("x0"), F.round(box[1], 6).alias("y0"), F.round(box[2], 6).alias("x1"), F.round(box[3], 6).alias("y1"), A.hash_distance(hashes("l_partkey"), hashes("l_suppkey")).alias("distance"))


_PARTS = ("应该怎么", "怎么解决", "如何解决", "怎么处理", "如何处理", "怎么操作", "如何操作", "有哪些", "有什么", "是什么", "怎么办", "请问", "问题", "方法", "办法")


def _without(text: str, parts, by: str) -> str:
    for p in parts:
        text = f"replace({text}, '{p}', '{by}')"
    return text


_C = "regexp_replace(lower({}), '[^0-9a-z一-鿿]', '', 'g')"
_SHAPE = A.LIST_SHAPES
_Q = f"""q AS (SELECT item_id, q, {_C.format("q")} AS c, n FROM (SELECT item_id, {QUESTION_SQL} AS q, length(text) AS n FROM benchmark)),
m AS (SELECT *, regexp_extract(c, '{_SHAPE[0]}', 1) AS s1, regexp_extract(c, '{_SHAPE[0]}', 2) AS f1, regexp_extract(c, '{_SHAPE[1]}', 1) AS s2, regexp_extract(c, '{_SHAPE[1]}', 2) AS f2, regexp_replace(c, '{A.ATTRIBUTE_ENDS}', '') AS e FROM q),
i AS (SELECT *, CASE WHEN length(s1) >= 2 AND length(f1) >= 2 THEN s1 WHEN length(s2) >= 2 AND length(f2) >= 2 THEN s2 END AS ls, CASE WHEN length(s1) >= 2 AND length(f1) >= 2 THEN f1 WHEN length(s2) >= 2 AND length(f2) >= 2 THEN f2 END AS lf,
  regexp_extract(e, '^(.*)的(.*)$', 1) AS es, regexp_extract(e, '^(.*)的(.*)$', 2) AS ef,
  regexp_replace(regexp_replace(regexp_replace(c, '{A.PROCEDURE}', ''), '{A.TO_DO}', ''), '{A.PROCEDURE_ENDS}', '') AS p FROM m)"""
_KEY = "CASE WHEN ls IS NOT NULL THEN {0} WHEN length(es) >= 2 AND length(ef) >= 2 THEN {1} END"
_BODY = "CASE WHEN id % 7 = 0 THEN '' WHEN id % 3 = 0 AND trim(t) <> '' THEN trim(t) WHEN id % 3 = 0 THEN '{{\"other\":\"o\",\"raw\":' || to_json(t)::VARCHAR || '}}' ELSE 't ' || id END".replace("{{", "{").replace("}}", "}")
_SQL = {
    "question_analysis": f"""WITH {_Q} SELECT item_id, trim(regexp_replace({_without("trim(regexp_replace(lower(q), '\\s+', ' ', 'g'))", sorted(_PARTS, key=len, reverse=True), " ")}, '\\s+', ' ', 'g')) AS focus,
ls AS list_subject, lf AS list_focus, {_KEY.format("ls", "es")} AS subject, {_KEY.format("lf", "ef")} AS attribute, CASE WHEN regexp_matches(c, '{A.PROCEDURE}') AND length(p) >= 4 THEN p ELSE '' END AS procedure,
regexp_matches(lower(q), '{A.COMPOUND}') AS compound, least(9, n % 12, CASE WHEN regexp_matches(lower(q), '{A.COMPOUND}') THEN 10 ELSE 6 END)::INTEGER AS items, CASE WHEN regexp_matches(lower(q), '{A.COMPOUND}') THEN 12000 ELSE 10000 END::INTEGER AS chars FROM i""",
    "list_claims": f"""WITH {_Q}, k AS (SELECT item_id, ls, lf, {CLAIM_SQL.replace("item_id", "i.item_id")} AS c FROM i), z AS (SELECT *, {_without("replace(" + _C.format("c") + ", ls, '')", A.GENERIC, "")} AS identity, {_without("replace(replace(" + _C.format("c") + ", ls, ''), lf, '')", A.GENERIC, "")} AS rest FROM k)
SELECT item_id, identity, regexp_matches(rest, '[a-z0-9]') OR length(regexp_replace(rest, '[^一-鿿]', '', 'g')) >= 2 AS concrete,
rtrim(c) || CASE WHEN rtrim(c) = '' THEN '' ELSE '。' END || '[' || printf('E%03d', item_id) || '][E999]' AS rendered FROM z""",
    "evidence_text": f"""WITH t AS (SELECT doc_id AS id, substring(coalesce(text, ''), 1, 5000) AS t FROM documents),
b AS (SELECT id, t, {_BODY} AS body, CASE WHEN id % 4 = 0 THEN t ELSE '' END AS context, coalesce(nullif(concat_ws(', ', CASE WHEN id % 2 = 0 THEN 'page=' || id END, CASE WHEN id % 5 = 0 THEN 'sheet=S' END, CASE WHEN id % 10 = 0 THEN 'cell_range=A1:B2' END), ''), 'location=unknown') AS place FROM t),
w AS (SELECT *, CASE WHEN context = '' THEN body WHEN body = '' THEN '上下文：' || context ELSE body || chr(10) || '上下文：' || context END AS whole FROM b)
SELECT id, '{{"a":"' || id || '","b":"2"}}' AS plain, place, md5(body) AS body_md5,
md5('<' || printf('E%03d', id % 1000) || '>' || chr(10) || '来源：c.pdf' || chr(10) || '模态：text; 角色：core; ' || place || chr(10) || '内容开始' || chr(10) || CASE WHEN length(whole) > 4000 THEN substring(whole, 1, 3986) || chr(10) || '……（已截断）' ELSE whole END || chr(10) || '内容结束' || chr(10) || '</' || printf('E%03d', id % 1000) || '>') AS block_md5,
md5(trim(regexp_replace(body, '\\s+', ' ', 'g')) || chr(10) || context || CASE WHEN id % 7 = 0 THEN '' ELSE chr(10) || 'o' END) AS search_md5 FROM w""",
    "structure_text": f"""WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
h AS (SELECT *, trim(regexp_replace(['第三章 ', '2.1. ', 'x ', '', '4、'][id % 5 + 1] || substring(text, 1, 107), '\\s+', ' ', 'g')) AS v, CASE WHEN id % 4 = 0 THEN id % 3 END AS l,
  trim(string_split(substring(text, 1, 30), chr(10))[1]) AS first, regexp_replace(substring(text, 1, 30), '', '') AS body, substring(text, 40, 25) AS o FROM t),
p AS (SELECT *, trim(CASE WHEN first = trim(string_split(body, chr(10))[1]) THEN 'One' || chr(10) || o ELSE 'One' || chr(10) || first || chr(10) || o END, E' \\n\\t\\r') AS prefix FROM h)
SELECT id, CASE WHEN id % 11 = 0 OR coalesce(l <= 2 AND length(v) <= 160, false) OR (length(v) <= 120 AND regexp_matches(v, '^(?:第[一二三四五六七八九十百]+[章节]|\\d+(?:\\.\\d+)*[.、]\\s*)')) THEN greatest(coalesce(l, 2), 1) END::INTEGER AS level,
CASE WHEN id % 4 = 0 THEN 'sheet:S' WHEN id % 4 = 1 THEN 'slide:' || id WHEN id % 2 = 0 THEN 'page:' || id ELSE 'document' END AS container,
md5(trim(concat_ws(chr(10), nullif(trim(substring(prefix, 1, greatest(50 - length(body) - CASE WHEN prefix <> '' AND body <> '' THEN 1 ELSE 0 END, 0)), E' \\n\\t\\r'), ''), nullif(body, '')), E' \\n\\t\\r')) AS bounded_md5,
md5(lower(regexp_replace(regexp_replace('| a | :--- | ' || substring(text, 1, 200), '\\|?\\s*:?-{{2,}}:?\\s*', '', 'g'), '[\\s|`]', '', 'g'))) AS layout_md5, replace(replace(substring(text, 1, 9), '|', '\\|'), chr(10), '<br>') || '\\|<br>z\\|' AS cell FROM p""",
    "normal_tables": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer),
r AS (SELECT c_nationkey, p, c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE '' END AS k, max(CASE WHEN c_nationkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 3 ELSE 2 END) OVER (PARTITION BY c_nationkey) AS width FROM c WHERE p <= 5),
x AS (SELECT *, width = 2 AS kv, c_name || ' | ' || c_mktsegment || CASE WHEN width = 3 THEN ' | ' || k ELSE '' END AS line FROM r)
SELECT c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Customers' ELSE '' END AS title, CASE WHEN any_value(kv) THEN 'Field;Value' ELSE replace(min(CASE WHEN p = 1 THEN line END), ' | ', ';') END AS headers,
(count(*) - CASE WHEN any_value(kv) THEN 0 ELSE 1 END)::INTEGER AS n,
CASE WHEN count(*) FILTER ((kv OR p > 1) AND contains(lower(c_mktsegment), 'building')) = 0 THEN count(*) FILTER (kv OR p > 1) ELSE count(*) FILTER ((kv OR p > 1) AND contains(lower(c_mktsegment), 'building')) END::INTEGER AS n_focused,
md5(concat_ws(chr(10), CASE WHEN c_nationkey % 2 = 0 THEN 'Table: Customers' END, 'Columns: ' || CASE WHEN any_value(kv) THEN 'Field | Value' ELSE min(CASE WHEN p = 1 THEN line END) END, string_agg(CASE WHEN kv OR p > 1 THEN 'Row: ' || line END, chr(10) ORDER BY p), CASE WHEN c_nationkey % 3 = 0 THEN 'Source: A1:C9' END)) AS text_md5
FROM x GROUP BY c_nationkey""",
    "replies": "SELECT item_id, item_id % 6 < 3 AS valid, CASE WHEN item_id % 6 < 3 THEN item_id::VARCHAR END AS x FROM benchmark",
    "boxes": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_linenumber / 200.0::DOUBLE, 6) AS x0,
round(CASE WHEN l_partkey % 2 = 0 THEN 1 - (l_linenumber * 2 + l_quantity) / 100 ELSE l_linenumber * 2 / 100.0::DOUBLE END, 6) AS y0, round((l_linenumber + 10) / 200.0::DOUBLE, 6) AS x1,
round(CASE WHEN l_partkey % 2 = 0 THEN 1 - l_linenumber * 2 / 100.0::DOUBLE ELSE (l_linenumber * 2 + l_quantity) / 100 END, 6) AS y1,
(bit_count(xor(l_partkey, l_suppkey)) + bit_count(xor(l_partkey * 31, l_suppkey * 31)) + bit_count(xor(l_partkey * 7, l_suppkey * 7))) / 256.0::DOUBLE AS distance FROM lineitem""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (question_analysis, list_claims, evidence_text, structure_text, normal_tables, replies, boxes)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
