"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

A document is a bag of words weighted by how often each occurs. A sample follows Ioffe (2010): for a term
of weight w, r and c are Gamma(2, 1) and b uniform, all drawn from hashes of the term; with
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r, the term of least a is sampled together with
t. Two documents draw the same sample with a probability equal to their generalised Jaccard
similarity. A fingerprint has BINS * DRAWS samples. Terms are dealt over BINS bins by hash and each bin draws DRAWS
samples (bin-wise consistent weighted sampling, Li and Li 2021), so a term is drawn for DRAWS times, not once a sample. The
likeness of two fingerprints is the share of equal samples among the bins that either fills.

A fingerprint is 8 hexadecimal digits a sample, dots in an empty bin. Null texts are empty; an empty
text fills no bin; two empty ones have likeness 1. Rows are ordered by doc_id, then by a hash of the text;
null doc_ids come last in descending order; rows equal in both are one document in that order, so equal rows
get equal results. A single document is its own next. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import SPACE, documents, id_text, stored

#: Terms are dealt over so many bins, and each bin draws so many samples.
BINS, DRAWS = 8, 8
LOW = -(1 << 63)


def _uniforms(term: Column, k: int) -> tuple[Column, Column]:
    """Two numbers between 0 and 1, from the halves of a hash of the term."""
    h = F.xxhash64(term, F.lit(k))
    low = F.lit((1 << 32) - 1)
    return (h.bitwiseAND(low) + 0.5) / F.lit(float(1 << 32)), (F.shiftrightunsigned(h, 32) + 0.5) / F.lit(float(1 << 32))


def _sampled(term: Column, ln_weight: Column, r: Column, ln_c: Column, b: Column) -> Column:
    """A long whose order is that of ln a (top 32 bits) and whose low 32 bits name the sample (term, t)."""
    t = F.floor(ln_weight / r + b)
    ln_a = ln_c - r * (t - b) - r
    # ln a lies within +-2**8: as a fixed-point number it keeps 20 bits below the point. Nothing here may turn null into a number.
    fixed = F.floor(ln_a * float(1 << 20))
    return F.shiftleft(fixed, 32).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit((1 << 32) - 1)))


def bag_signatures(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and, for every text column, an array of BINS * DRAWS ints (null for an empty bin) under the column's name.

    Rows that are already dealt by keys are not shuffled again. A row without any word gives no row."""
    bags = F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).alias("body")) for k, c in enumerate(columns)])
    each = texts.select(*keys, F.explode(bags).alias("x")).select(*keys, "x.which", F.explode(F.split("x.body", f"[{SPACE}]+")).alias("w")).where("w <> ''")
    counts = [F.sum((F.col("which") == k).cast("int")).alias(f"n{k}") for k in range(len(columns))]
    bag = each.select(*keys, "which", F.xxhash64("w").alias("term")).groupBy(*keys, "term").agg(*counts)
    term, drawn = F.col("term"), []
    for j in range(DRAWS):
        (u1, u2), (u3, u4), (b, _) = (_uniforms(term, 3 * j + k) for k in range(3))
        drawn += [(-F.log(u1 * u2)).alias(f"r{j}"), F.log(-F.log(u3 * u4)).alias(f"c{j}"), b.alias(f"b{j}")]
    numbers = bag.select(*keys, "term", F.pmod(F.shiftright("term", 7), F.lit(BINS)).alias("bin"), *[F.log(F.col(f"n{k}").cast("double")).alias(f"l{k}") for k in range(len(columns))], *drawn)
    least = []
    for k in range(len(columns)):
        # a term that a text lacks has no logarithm, so its samples are null: a condition would keep common parts from being shared
        least += [F.min(_sampled(term, F.col(f"l{k}"), F.col(f"r{j}"), F.col(f"c{j}"), F.col(f"b{j}"))).alias(f"v{k}_{j}") for j in range(DRAWS)]
    low = lambda c: F.shiftright(F.shiftleft(F.col(c), 32), 32).cast("int")
    bins = numbers.groupBy(*keys, "bin").agg(*least).select(*keys, "bin", *[F.array(*[low(f"v{k}_{j}") for j in range(DRAWS)]).alias(f"a{k}") for k in range(len(columns))])
    maps = [F.map_from_entries(F.collect_list(F.struct("bin", f"a{k}"))).alias(f"m{k}") for k in range(len(columns))]
    none = F.array_repeat(F.lit(None).cast("int"), DRAWS)
    whole = lambda k: F.flatten(F.array(*[F.coalesce(F.try_element_at(f"m{k}", F.lit(i).cast("long")), none) for i in range(BINS)]))
    return bins.groupBy(*keys).agg(*maps).select(*keys, *[whole(k).alias(c) for k, c in enumerate(columns)])


def likeness(x: Column, y: Column) -> Column:
    """The share of equal samples among the bins that either fingerprint fills; both empty: 1."""
    filled = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p, q)), lambda p: p.isNotNull()))
    equal = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda p: F.coalesce(p, F.lit(False))))
    return F.when(filled == 0, 1.0).otherwise(equal / filled)


def printed(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda v: F.coalesce(F.lower(F.substring(F.lpad(F.hex(v), 16, "0"), -8, 8)), F.lit("........"))), "")


def next_documents(rows: DataFrame) -> DataFrame:
    """rows: id, h, distinct. Of each its successor in descending order, the first after the last: next_id, next_h.

    A range partitioning orders the rows; each partition finds successors within itself, and the first
    rows of the partitions (one row each) complete the last ones."""
    order = [F.desc("id"), F.desc("h")]
    placed = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    inner = Window.partitionBy("part").orderBy(*order)
    here = placed.select("id", "h", "part", F.lead(F.struct("id", "h")).over(inner).alias("next"))
    heads = sorted((r.part, r.top) for r in placed.groupBy("part").agg(F.max(F.struct("id", "h")).alias("top")).collect())
    follow = [(part, *heads[(k + 1) % len(heads)][1]) for k, (part, _) in enumerate(heads)]
    firsts = rows.sparkSession.createDataFrame(follow, "part int, first_id long, first_h long")
    return here.join(F.broadcast(firsts), "part", "left").select(
        "id", "h", F.coalesce("next.id", "first_id").alias("next_id"), F.coalesce("next.h", "first_h").alias("next_h")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The text is shuffled once by its key; the beginnings that replace the ends of other texts once more."""
    key = ["id", "h"]
    base = id_text(docs).select(F.coalesce("doc_id", F.lit(LOW)).alias("id"), F.xxhash64("text").alias("h"), "text")
    slim = stored(base.select(*key, F.length("text").alias("n")).groupBy(*key).agg(F.max("n").alias("n"), F.count("*").alias("m")), "sizes")
    order = stored(next_documents(slim.select(*key)), "next")
    if slim.agg(F.max("m")).first()[0] not in (None, 1):
        base = base.dropDuplicates(key)  # equal rows are worked on once
    half = F.floor(F.col("n") / 2).cast("int")
    wanted = order.join(slim, key).select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("for_id"), F.col("h").alias("for_h"), half.alias("half"))
    tails = base.join(wanted.hint("shuffle_hash"), key).select(F.col("for_id").alias("id"), F.col("for_h").alias("h"), F.col("half"), F.expr("substring(text, 1, half)").alias("tail"))
    both = base.join(tails, key).select(*key, "text", F.concat(F.expr("substring(text, 1, length(text) - half)"), "tail").alias("edited"))
    drawn = bag_signatures(both, key, ["text", "edited"])
    made = stored(both.select(*key, F.sha2("edited", 256).alias("sha")).join(drawn, key, "left"), "fingerprints")
    none = F.array_repeat(F.lit(None).cast("int"), BINS * DRAWS)
    own, edited, after = (F.coalesce(c, none) for c in ("text", "edited", "next_text"))
    nexts = made.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("text").alias("next_text"))
    rows = made.join(order, key).join(nexts, ["next_id", "next_h"]).join(slim, key).select("id", "n", "m", "sha", own.alias("a"), edited.alias("b"), after.alias("c"))
    return rows.select(F.explode(F.array_repeat("id", F.col("m").cast("int"))).alias("id"), "n", "sha", "a", "b", "c").select(
        F.when(F.col("id") != LOW, F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        printed(F.col("a")).alias("fingerprint"),
        printed(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
