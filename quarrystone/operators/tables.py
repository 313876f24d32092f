"""Tables inside documents: Markdown to arrays, sparse cells to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import bound


def markdown_table(text: Column) -> Column:
    """struct(headers, rows) of a Markdown table; null with fewer than two lines that hold a pipe.

    Runs of pipes at the edges go, escaped pipes are unescaped, missing headers are named column_n, short rows are padded."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("|")))
    split = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))

    def made(cells: Column) -> Column:
        ruled = F.forall(F.get(cells, F.lit(1)), lambda c: (c == "") | c.rlike("^:?-{3,}:?$"))
        head = F.get(cells, F.lit(0))
        body = F.slice(cells, F.when(ruled, 3).otherwise(2), F.greatest(F.size(cells), F.lit(1)))
        names = lambda width: F.when(width > F.size(head), F.transform(F.sequence(F.size(head) + 1, F.greatest(width, F.size(head) + 1)), lambda k: F.concat(F.lit("column_"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
        padded = lambda width: F.transform(body, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        return bound(F.array_max(F.transform(F.concat(F.array(head), body), lambda r: F.size(r))), lambda width: F.struct(F.concat(head, names(width)).alias("headers"), padded(width).alias("rows")))

    return bound(split, lambda cells: F.when(F.size(cells) >= 2, made(cells)))


def dense_rows(cells: DataFrame) -> DataFrame:
    """cells: id, ordinal, row, column, row_span, column_span, value -> id, row (from 0), values.

    A cell fills its spans, parts outside of the table are clipped, and of several cells at one place the
    one of largest ordinal stays. All steps share one shuffle by id; a group is one table."""
    own = Window.partitionBy("id")
    sized = cells.select("*", *[f(c).over(own).alias(n) for n, f, c in (("r0", F.min, "row"), ("r1", F.max, "row"), ("c0", F.min, "column"), ("c1", F.max, "column"))])
    span = lambda at, n, last: F.sequence(F.col(at), F.least(F.col(at) + F.greatest(F.col(n), F.lit(1)) - 1, F.col(last)))
    filled = sized.withColumn("row", F.explode(span("row", "row_span", "r1"))).withColumn("column", F.explode(span("column", "column_span", "c1")))
    one = filled.groupBy("id", "r0", "r1", "c0", "c1", "row", "column").agg(F.max_by("value", "ordinal").alias("value"))
    place = lambda row, column: (row - F.col("r0")).cast("long") * (F.col("c1") - F.col("c0") + 1) + column - F.col("c0")
    at = F.map_from_entries(F.collect_list(F.struct(place(F.col("row"), F.col("column")).alias("k"), "value")))
    table = one.groupBy("id", "r0", "r1", "c0", "c1").agg(at.alias("at"))
    rows = table.select("id", "r0", "c0", "c1", "at", F.explode(F.sequence("r0", "r1")).alias("at_row"))
    values = F.transform(F.sequence("c0", "c1"), lambda c: F.coalesce(F.try_element_at("at", place(F.col("at_row"), c)), F.lit("")))
    return rows.select("id", (F.col("at_row") - F.col("r0")).alias("row"), values.alias("values"))
