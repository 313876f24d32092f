"""Scalar expressions of questions, evidence and answers; all of them are Catalyst built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.text import bound, compact, normalized

# Question fragments that say nothing about the subject.
QUESTION_PARTS = ("应该怎么", "怎么解决", "如何解决", "怎么处理", "如何处理", "怎么操作", "如何操作", "有哪些", "有什么", "是什么", "怎么办", "请问", "问题", "方法", "办法")
# The two shapes of a question for a list.
LIST_SHAPES = ("^(.+?)(?:的)?(?:有|包括|包含|涉及|参加|参与|覆盖)哪些(.+)$", "^(.+?)的(.+?)(?:有)?哪些$")
# Words of a claim that name no list item.
GENERIC = (
    "赛车运动", "赛事系列", "赛车系列", "系列赛事", "具体包括", "主要包括", "系列赛", "分别是", "包括", "包含", "涉及", "涵盖", "覆盖", "拥有", "参加", "参与", "如下", "多个", "多种", "若干", "一些", "各类",
    "不同", "相关", "主要", "具体", "知名", "顶级", "全球", "国际", "国内", "运动", "赛事", "赛车", "系列", "项目", "类别", "类型", "领域", "有", "是", "为",
)
# Endings of a question for an attribute.
ATTRIBUTE_ENDS = "(?:分别有什么|具体有什么|包括哪些|有哪些|有什么|是什么|有何)$"
# How a question for a procedure begins, what is to be done, and how it ends.
PROCEDURE = "^(?:应该怎样|应该怎么|如何才能|怎样才能|怎么才能|请问如何|请问怎样|请问怎么|如何|怎样|怎么)"
TO_DO = "^(?:避免|防止|解决|处理|排除|清除)"
PROCEDURE_ENDS = "(?:的方法|的步骤|方法|步骤|怎么办|问题)$"
# Words of a question for several things.
COMPOUND = r"分别|共同|同时|比较|对比|各自|以及|和|与|、|哪些|列出|所有|区别|差异|\b(?:both|each|all|compare|comparison|versus|and)\b"
# The fields of a content that hold its text, the best first.
CONTENT_FIELDS = ("markdown", "text", "raw", "caption", "description", "summary")


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def query_focus(query: Column) -> Column:
    """The normalised question without fragments that any question has, the longest first."""
    out = normalized(query)
    for part in sorted(QUESTION_PARTS, key=len, reverse=True):
        out = F.replace(out, F.lit(part), F.lit(" "))
    return collapsed(out)


def searchable(embedding_text: Column, context: Column, content: Column) -> Column:
    """What a record is searched by: its embedding text, its context and the strings of its content (a map), by lines."""
    values = F.concat(F.array(embedding_text, context), F.coalesce(F.map_values(content), F.array().cast("array<string>")))
    return F.array_join(F.filter(values, lambda v: v.isNotNull()), "\n")


def content_text(content: Column) -> Column:
    """The text of a content (a map of strings): the first field that is not blank, else the whole as JSON; null: the empty string."""
    fields = [F.nullif(F.trim(F.try_element_at(content, F.lit(k))), F.lit("")) for k in CONTENT_FIELDS]
    return F.coalesce(*fields, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(content)))), F.lit(""))


def list_intent(query: Column) -> Column:
    """struct(subject, focus) of a question for a list, both of two characters at least; null if it is none."""
    q, found = compact(query), []
    for shape in LIST_SHAPES:
        subject, focus = F.regexp_extract(q, shape, 1), F.regexp_extract(q, shape, 2)
        found.append(F.when((F.length(subject) >= 2) & (F.length(focus) >= 2), F.struct(subject.alias("subject"), focus.alias("focus"))))
    return F.coalesce(*found)


def subject_focus(query: Column) -> Column:
    """struct(subject, focus) of a question for a list or an attribute; null if it is neither."""
    q = F.regexp_replace(compact(query), ATTRIBUTE_ENDS, "")
    subject, focus = F.regexp_extract(q, "^(.*)的(.*)$", 1), F.regexp_extract(q, "^(.*)的(.*)$", 2)
    return F.coalesce(list_intent(query), F.when((F.length(subject) >= 2) & (F.length(focus) >= 2), F.struct(subject.alias("subject"), focus.alias("focus"))))


def procedure_focus(query: Column) -> Column:
    """What a question for a procedure is about, of four characters at least; else the empty string."""
    q = compact(query)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(q, PROCEDURE, ""), TO_DO, ""), PROCEDURE_ENDS, "")
    return F.when(q.rlike(PROCEDURE) & (F.length(rest) >= 4), rest).otherwise("")


def list_identity(claim: Column, intent: Column) -> Column:
    """The claim without the subject and generic words: what tells list items apart."""
    out = F.replace(compact(claim), intent["subject"], F.lit(""))
    for part in GENERIC:
        out = F.replace(out, F.lit(part), F.lit(""))
    return out


def names_an_item(claim: Column, intent: Column) -> Column:
    """Whether a claim names an item of the list: a Latin letter or digit, or two Han characters, beside subject, focus and generic words."""
    left = F.replace(F.replace(compact(claim), intent["subject"], F.lit("")), intent["focus"], F.lit(""))
    for part in GENERIC:
        left = F.replace(left, F.lit(part), F.lit(""))
    return left.rlike("[a-z0-9]") | (F.length(F.regexp_replace(left, "[^一-鿿]", "")) >= 2)


def is_compound(query: Column) -> Column:
    return F.lower(query).rlike(COMPOUND)


def budget_limits(query: Column, candidates: Column, items: Column, chars: Column) -> Column:
    """struct(items, chars): six items and 10,000 characters, ten and 16,000 for a question for several things, within the given bounds."""
    several = is_compound(query)
    wanted, room = F.when(several, 10).otherwise(6), F.when(several, 16_000).otherwise(10_000)
    return F.struct(F.least(items, wanted, candidates).alias("items"), F.least(chars, room).alias("chars"))


def focused_rows(rows: Column, focus: Column) -> Column:
    """The rows (arrays of cells) with a cell that holds the focus; all rows if none or every one does."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.contains(compact(c), focus)))
    return F.when((F.size(kept) == 0) | (F.size(kept) == F.size(rows)), rows).otherwise(kept)


def location(provenance: Column) -> Column:
    """page, slide, sheet and cell range of a struct, those that are known."""
    part = lambda k: F.when(provenance[k].isNotNull(), F.concat(F.lit(f"{k}="), provenance[k].cast("string")))
    return F.coalesce(F.nullif(F.concat_ws(", ", part("page"), part("slide"), part("sheet"), F.nullif(part("cell_range"), F.lit("cell_range="))), F.lit("")), F.lit("location=unknown"))


def prompt_block(evidence_id: Column, source: Column, modality: Column, role: Column, place: Column, body: Column, context: Column, most: int = 4_000) -> Column:
    """An evidence item as a model reads it; a body of more than ``most`` characters is cut and says so."""
    more = F.concat(F.lit("上下文："), context)
    whole = F.when(F.coalesce(context, F.lit("")) == "", body).when(body == "", more).otherwise(F.concat_ws("\n", body, more))
    cut = F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 14), F.lit("\n……（已截断）"))).otherwise(whole)
    return F.concat(
        F.lit("<"), evidence_id, F.lit(">\n来源："), F.element_at(F.split(source, r"[/\\]"), -1), F.lit("\n模态："), modality, F.lit("; 角色："), role, F.lit("; "), place,
        F.lit("\n内容开始\n"), cut, F.lit("\n内容结束\n</"), evidence_id, F.lit(">"),
    )


def rendered_claim(text: Column, evidence_ids: Column) -> Column:
    """A claim that ends in a stop, and its citations."""
    clean = F.rtrim(text)
    stopped = F.when((clean == "") | clean.rlike("[。！？.!?;；]$"), clean).otherwise(F.concat(clean, F.lit("。")))
    return F.concat(stopped, F.array_join(F.transform(evidence_ids, lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""))


def heading_level(text: Column, level: Column, label: Column, clean: bool = False) -> Column:
    """The level of a heading, null for other blocks: named so by its label, of level 1 or 2 and short, or numbered and short; clean: the text is collapsed."""
    t = text if clean else collapsed(text)
    named = F.lower(F.coalesce(label, F.lit(""))).isin("title", "heading", "section_header", "section-header")
    numbered = (F.length(t) <= 120) & t.rlike(r"^(?:第[一二三四五六七八九十百]+[章节]|\d+(?:\.\d+)*[.、]\s*)")
    return F.when(named | F.coalesce((level <= 2) & (F.length(t) <= 160), F.lit(False)) | numbered, F.greatest(F.coalesce(level, F.lit(2)), F.lit(1)))


def container_key(sheet: Column, slide: Column, page: Column) -> Column:
    """Where a block stands: sheet, slide or page, else the document."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), c.cast("string")))
    return F.coalesce(part("sheet", sheet), part("slide", slide), part("page", page), F.lit("document"))


def bounded_text(titles: Column, overlap: Column, body: Column, most: int = 384) -> Column:
    """Titles, overlap and body in ``most`` characters; the body comes first, the beginning of the rest as far as it fits.

    The last title is left out where the body's first line is it."""
    first = F.trim(F.element_at(F.split(body, r"\R"), 1))
    same = (F.size(titles) > 0) & (F.coalesce(F.try_element_at(titles, F.lit(-1)), F.lit("")) == first)
    used = F.when(same, F.slice(titles, 1, F.greatest(F.size(titles) - 1, F.lit(0)))).otherwise(titles)
    kept = F.substring(body, 1, most)
    prefix = F.trim(F.regexp_replace(F.array_join(F.concat(used, F.array(overlap)), "\n"), r"^\s+|\s+$", ""))
    room = F.greatest(most - F.length(kept) - F.when((prefix != "") & (kept != ""), 1).otherwise(0), F.lit(0))
    prefix = F.regexp_replace(F.substring(prefix, F.lit(1), room), r"^\s+|\s+$", "")
    return F.regexp_replace(F.array_join(F.filter(F.array(prefix, kept), lambda x: x != ""), "\n"), r"^\s+|\s+$", "")


def table_text(title: Column, headers: Column, rows: Column, place: Column) -> Column:
    """A table as lines: its title, columns, rows and source, those that are known."""
    named = lambda name, c: F.filter(F.array(F.concat(F.lit(f"{name}: "), c)), lambda x: F.coalesce(c, F.lit("")) != "")
    body = F.transform(rows, lambda r: F.concat(F.lit("Row: "), F.array_join(r, " | ")))
    return F.array_join(F.concat(named("Table", title), F.array(F.concat(F.lit("Columns: "), F.array_join(headers, " | "))), body, named("Source", place)), "\n")


def normal_table(matrix: Column, native: Column) -> Column:
    """struct(title, headers, rows) of a matrix of cells; null if all cells are blank.

    Blank rows at both ends go, short rows are padded, a first row of one filled cell is the title. Two columns of native
    cells with distinct, filled names are fields and values."""

    def made(width: Column, rows: Column, titled: Column, title: Column) -> Column:
        names = F.transform(rows, lambda r: F.get(r, F.lit(0)))
        alike = bound(names, lambda n: F.forall(n, lambda x: F.trim(x) != "") & (F.size(F.array_distinct(n)) == F.size(n)))
        shaped = lambda pairs: F.struct(
            F.when(titled, title).otherwise("").alias("title"), F.when(pairs, F.array(F.lit("Field"), F.lit("Value"))).otherwise(F.get(rows, F.lit(0))).alias("headers"),
            F.when(pairs, rows).otherwise(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).alias("rows"),
        )
        return F.when(F.size(rows) > 0, bound(native & (width == 2) & alike, shaped))

    def headed(width: Column, body: Column) -> Column:
        cells = F.filter(F.get(body, F.lit(0)), lambda c: F.trim(c) != "")
        rest = lambda titled: F.when(titled, F.slice(body, 2, F.greatest(F.size(body), F.lit(1)))).otherwise(body)
        return bound((F.size(cells) == 1) & (width >= 2), lambda titled: bound(rest(titled), lambda rows: made(width, rows, titled, F.get(cells, F.lit(0)))))

    def cut(width: Column, padded: Column, filled: Column) -> Column:
        first, last = F.array_position(filled, True).cast("int"), (F.size(filled) + 1 - F.array_position(F.reverse(filled), True)).cast("int")
        return F.when(F.array_position(filled, True) > 0, bound(F.slice(padded, first, last - first + 1), lambda body: headed(width, body)))

    def padded(width: Column) -> Column:
        rows = F.transform(matrix, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        return bound(rows, lambda p: bound(F.transform(p, lambda r: F.exists(r, lambda c: F.trim(c) != "")), lambda filled: cut(width, p, filled)))

    return bound(F.array_max(F.transform(matrix, lambda r: F.size(r))), padded)


def layout_text(text: Column) -> Column:
    """Text compared in layouts: no table rules, pipes, backticks or white space, small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\|?\s*:?-{2,}:?\s*", ""), r"[\s|`]", ""))


def hash_distance(a: Column, b: Column) -> Column:
    """Share of different bits of two hashes, arrays of longs of the same size."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return bits / (64.0 * F.size(a))


def plain_json(reply: Column) -> Column:
    """The JSON object of a reply: code fences go, an array of one object is that object, anything else gives null."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))
    one = F.regexp_extract(bare, r"(?s)^\[\s*(\{.*\})\s*\]$", 1)
    single = F.when((one != "") & (F.coalesce(F.json_array_length(bare), F.lit(0)) == 1), one).otherwise(bare)
    return F.when(single.startswith("{") & F.json_object_keys(single).isNotNull(), single)


def unwrapped(reply: Column, field: str) -> Column:
    """A field of a JSON object, also inside an envelope ``properties``."""
    return F.coalesce(F.get_json_object(reply, f"$.{field}"), F.get_json_object(reply, f"$.properties.{field}"))


def cell_value(value: Column) -> Column:
    """A cell in a Markdown table: pipes escaped, line feeds as breaks; null: the empty string."""
    return F.coalesce(F.regexp_replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), "\r?\n", "<br>"), F.lit(""))


def normal_box(box: Column, width: Column, height: Column, from_bottom: Column) -> Column:
    """A box in page units to shares of the page from the top left corner."""
    top = F.when(from_bottom, 1 - box[3] / height).otherwise(box[1] / height)
    bottom = F.when(from_bottom, 1 - box[1] / height).otherwise(box[3] / height)
    return F.array(box[0] / width, top, box[2] / width, bottom)
