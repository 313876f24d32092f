"""Structure of documents: heading paths, long-text pieces, boxes inside boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import area, overlap


def title_paths(blocks: DataFrame, levels: int = 6) -> DataFrame:
    """blocks: id, ordinal, level (null: no heading), title -> the same with path.

    A heading of level l keeps the l - 1 outermost titles of the path and adds its own. With headings
    numbered i from 1, the depth after heading i is i plus the running minimum of (0, level - i); the path then
    holds the last title of every depth up to it. Levels above ``levels`` count as that one."""
    own = Window.partitionBy("id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("level").isNotNull()
    i = F.count("level").over(own)
    shift = F.when(heading, F.least(F.lit(0), F.greatest(F.lit(1), F.least("level", F.lit(levels))) - F.col("_i")))
    deep = blocks.withColumn("_i", i).withColumn("_s", shift).withColumn("_d", F.col("_i") + F.coalesce(F.min("_s").over(own), F.lit(0)))
    last = [F.last(F.when(heading & (F.col("_d") == k), F.col("title")), True).over(own) for k in range(1, levels + 1)]
    return deep.withColumn("path", F.slice(F.array(*last), 1, F.col("_d").cast("int"))).drop("_i", "_s", "_d")


def split_long(text: Column, most: int = 384, overlap_chars: int = 48) -> Column:
    """Pieces of at most ``most`` characters: sentences packed in order; a longer sentence becomes overlapping windows."""
    # the stop is taken along, as a look behind every character takes several times as long
    ends = F.regexp_replace(text, r"([。！？!?；;.])\s*|\n+", "$1\u0000")
    sentences = F.filter(F.split(ends, "\u0000"), lambda s: s != "")
    empty = F.array().cast("array<string>")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(most - overlap_chars)), lambda k: F.substring(s, k + 1, F.lit(most)))

    def step(state, s):
        joined = F.when(state["open"] == "", s).otherwise(F.concat(state["open"], F.lit("\n"), s))
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        fits = F.length(joined) <= most
        done = F.when(fits, state["done"]).when(F.length(s) <= most, closed).otherwise(F.concat(closed, cut(s)))
        still = F.when(fits, joined).when(F.length(s) <= most, s).otherwise(F.lit(""))
        return F.struct(done.alias("done"), still.alias("open"))

    pieces = F.aggregate(sentences, F.struct(empty.alias("done"), F.lit("").alias("open")), step, lambda x: F.when(x["open"] == "", x["done"]).otherwise(F.array_append(x["done"], x["open"])))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(pieces)


def smallest_container(boxes: DataFrame, containment: float = 0.92, larger: float = 1.05) -> DataFrame:
    """boxes: group, id, box -> group, id, parent: the smallest box of the group that holds at least ``containment``
    of this one and is more than ``larger`` times as large; ties go to the smaller id, null if there is none. A group is one page or slide."""
    child = boxes.select("group", "id", F.col("box").alias("b"))
    parent = boxes.select("group", F.col("id").alias("p"), F.col("box").alias("q"))
    holds = (area(F.col("b")) > 0) & (overlap(F.col("b"), F.col("q")) >= containment * area(F.col("b"))) & (area(F.col("q")) > larger * area(F.col("b")))
    found = child.join(parent, "group").where((F.col("id") != F.col("p")) & holds).groupBy("group", "id").agg(F.min(F.struct(area(F.col("q")).alias("a"), "p")).getField("p").alias("parent"))
    return boxes.select("group", "id").join(found, ["group", "id"], "left")
