"""Context of visuals on pages and slides: nearby texts, groups, page rasters, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.answers import collapsed
from quarrystone.functions.text import page_sized

ROOM = 280


def shortened(text: Column, most: Column | int = ROOM) -> Column:
    """White space collapsed; what is longer than ``most`` is cut and ends in an ellipsis."""
    most = F.lit(most) if isinstance(most, int) else most
    t = collapsed(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, F.lit(1), most - 1)), F.lit("…")))


def joined_context(texts: Column, room: int = ROOM) -> Column:
    """Texts in order by lines, each cut to the room that is left; null if all are blank."""
    start = F.struct(F.lit("").alias("out"), F.lit(room).alias("left"))

    def step(a: Column, t: Column) -> Column:
        cut = shortened(t, a["left"])
        more = F.struct(F.when(a["out"] == "", cut).otherwise(F.concat(a["out"], F.lit("\n"), cut)).alias("out"), (a["left"] - F.length(cut) - 1).alias("left"))
        return F.when((a["left"] <= 0) | (cut == ""), a).otherwise(more)

    return F.nullif(F.aggregate(texts, start, step, lambda a: a["out"]), F.lit(""))


def nearby_context(visuals: DataFrame, texts: DataFrame, distance: int = 2) -> DataFrame:
    """visuals: id, container, reading_order; texts: id, container, reading_order, text -> id, before, after, context: the last text before and the
    first after a visual in its container, at most ``distance`` places away."""
    other = texts.where(F.trim("text") != "").select(F.col("id").alias("t"), "container", F.col("reading_order").alias("o"), "text")
    # every text stands for the places that it can be near to: an equality join, whatever the size of a container
    spread = other.select("t", "container", "o", "text", F.explode(F.sequence(F.col("o") - distance, F.col("o") + distance)).alias("reading_order")).where("o <> reading_order")
    near = visuals.join(spread, ["container", "reading_order"])
    side = lambda before, pick: pick(F.when((F.col("o") < F.col("reading_order")) == before, F.struct("o", "t", "text")))
    got = near.groupBy("id").agg(side(True, F.max).alias("b"), side(False, F.min).alias("a"))
    rows = visuals.join(got, "id", "left")
    parts = F.filter(F.array(F.col("b.text"), F.col("a.text")), lambda x: x.isNotNull())
    return rows.select("id", F.col("b.t").alias("before"), F.col("a.t").alias("after"), joined_context(parts).alias("context"))


def spatial_context(visuals: DataFrame, texts: DataFrame, edge: float = 0.01, overlap: float = 0.30, gap: float = 0.08, order_gap: int = 8) -> DataFrame:
    """visuals: id, slide, box, reading_order, matched; texts: id, slide, box, reading_order, text -> id, text_ids, context: texts whose centre lies in
    the visual or that stand right above or below it, from top to bottom. For visuals matched by geometry only texts at most order_gap places away."""
    t = texts.select(F.col("id").alias("t"), "slide", F.col("box").alias("b"), F.col("reading_order").alias("o"), "text")
    x = lambda k: (F.col("box")[k], F.col("b")[k])
    (l, tl), (u, tu), (r, tr), (d, td) = (x(k) for k in range(4))
    cx, cy = (tl + tr) / 2, (tu + td) / 2
    inside = cx.between(l - edge, r + edge) & cy.between(u - edge, d + edge)
    share = F.greatest(F.lit(0.0), F.least(r, tr) - F.greatest(l, tl)) / F.greatest(F.lit(0.001), tr - tl)
    apart = F.greatest(F.lit(0.0), tu - d, u - td)
    near = inside | ((share >= overlap) & (apart <= gap))
    far = F.coalesce(F.col("matched"), F.lit(False)) & (F.abs(F.col("o") - F.col("reading_order")) > order_gap)
    both = visuals.join(t, "slide").where(near & ~far)
    order = F.array_sort(F.collect_list(F.struct(tu.alias("top"), tl.alias("left"), "o", "t", "text")))
    got = both.groupBy("id").agg(order.alias("x"))
    return got.select("id", F.transform("x", lambda y: y["t"]).alias("text_ids"), joined_context(F.transform("x", lambda y: y["text"])).alias("context"))


def group_context(visuals: DataFrame) -> DataFrame:
    """visuals: id, parent_id, context, place. Groups without context take their children's (distinct, in order), then children without one take their group's."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own = visuals.where("parent_id IS NOT NULL").where(~blank(F.col("context")))
    lists = own.groupBy(F.col("parent_id").alias("p")).agg(F.array_sort(F.collect_list(F.struct("place", "id", F.trim("context").alias("c")))).alias("x"))
    given = lists.select("p", F.substring(F.array_join(F.array_distinct(F.transform("x", lambda y: y["c"])), "\n"), 1, ROOM).alias("given"))
    up = visuals.join(given, F.col("id") == F.col("p"), "left").withColumn("context", F.when(blank(F.col("context")), F.col("given")).otherwise(F.col("context"))).drop("p", "given")
    parents = up.where(~blank(F.col("context"))).select(F.col("id").alias("p"), F.col("context").alias("given"))
    down = up.join(parents, F.col("parent_id") == F.col("p"), "left")
    return down.withColumn("context", F.when(blank(F.col("context")), F.col("given")).otherwise(F.col("context"))).drop("p", "given")


def page_rasters(blocks: DataFrame, least: int = 8) -> DataFrame:
    """blocks: document_id, id, kind, page, box, text -> id, role of visuals of page size: background where the page has a text or table of
    ``least`` significant characters, else page_visual."""
    significant = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s|`:\-]", ""))
    said = blocks.where(F.col("kind").isin("text", "table") & (significant >= least)).select("document_id", "page").distinct().withColumn("said", F.lit(True))
    large = blocks.where((F.col("kind") == "visual") & page_sized(F.col("box")))
    return large.join(said, ["document_id", "page"], "left").select("id", F.when(F.col("said"), "background").otherwise("page_visual").alias("role"))


def common_baseline(shapes: DataFrame) -> DataFrame:
    """shapes: id, page, paragraph, line, top, height. Inline shapes of one line share its lowest bottom: adds bottom and the new top."""
    own = Window.partitionBy("page", "paragraph", "line", F.round("top", 1))
    low = F.max(F.col("top") + F.col("height")).over(own)
    return shapes.withColumn("bottom", low).withColumn("top", F.col("bottom") - F.col("height"))


def union_box(segments: DataFrame, by: list[str]) -> DataFrame:
    """The smallest box around all boxes of a key."""
    corner = lambda k, f: f(F.col("box")[k])
    return segments.groupBy(*by).agg(F.array(corner(0, F.min), corner(1, F.min), corner(2, F.max), corner(3, F.max)).alias("box"))


def dangling(results: DataFrame, blocks: DataFrame, key: str = "block_id") -> DataFrame:
    """Results that no block has, counted."""
    return results.join(blocks.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def distinct_warnings(warnings: Column) -> Column:
    """Warnings trimmed, without blanks and repetitions, in order."""
    return F.array_distinct(F.filter(F.transform(warnings, lambda w: F.trim(w)), lambda w: w.isNotNull() & (w != "")))


def recognised(kind: Column, semantic: Column) -> Column:
    """struct(kind, visual_type, status) of a parsed block: images and visual tasks are visuals whose recognition is deferred."""
    visual = kind.isin("image", "visual_task", "visual")
    type_ = F.when(semantic.isin("chart", "diagram", "icon"), semantic).otherwise("image")
    return F.struct(F.when(visual, "visual").otherwise(kind).alias("kind"), F.when(visual, type_).alias("visual_type"), F.when(visual, "deferred").alias("status"))


def crop_problem(page: Column, pages: Column, box: Column) -> Column:
    """Why a crop of a page can't be made; null if it can."""
    return (
        F.when(page.isNull(), "no page").when((page < 1) | (page > pages), "page out of range").when(box.isNull() | (F.size(box) != 4), "no box")
        .when((box[2] <= box[0]) | (box[3] <= box[1]), "empty box")
    )
