"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (words) within a source. Every document of a source is taken
floor(target / size of the source) times; what then remains of the target, the budget, is met by taking some
documents once more. How many of each length: from the longest length down, the same share of every length, rounded
so that the words taken never exceed that share of the words seen; the share leaves twice the longest length of
the budget open. What is open is fitted by a bounded-knapsack dynamic programme over the documents left, whose result is the
subset sum nearest to it. Which documents of a length: those of the smallest seeded hash, found through two levels of counts of
hash buckets so that no group is ever ordered as a whole.

Null texts have size 0; size 0 is never short of or over anything and takes 0. A null source is a
source of its own, ordered last. Null and repeated doc_ids are ordinary; rows equal in doc_id, text and source tie in
the hash and are taken alike, which can exceed a budget by their number less one. Empty tables give no rows. Other columns are ignored by
``mix`` and kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

import math
from itertools import cycle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import SPACE, documents, stored, whole_text

SEED = 20_24
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: Bits of the seeded hash that make a bucket, at each of two levels.
BUCKET_BITS = 8
#: Bits of memory for the states that a dynamic programme holds at once.
HELD_BITS = 1 << 29
#: Lengths (a row for each source and length) up to which the plan is broadcast.
BROADCAST_ROWS = 200_000


def water_fill(sizes: list[int], weights: list[float], share: float = SHARE, most: float = 2.0) -> list[float]:
    """Targets in proportion to the weights, none above most times its size, the excess shared again by weight."""
    total = share * sum(sizes)
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(targets[k] for k in range(len(sizes)) if k not in open_)
        weight = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / weight > most * sizes[k]}
        for k in full:
            targets[k] = most * sizes[k]
        if not full:
            for k in open_:
                targets[k] = left * weights[k] / weight
            break
        open_ -= full
    return targets


def _grow(reach: int, items: list[tuple[int, int]], mask: int) -> int:
    for words, _ in items:
        reach |= reach << words & mask
    return reach


def _choose(reach: int, items: list[tuple[int, int]], goal: int, mask: int, held: int, take) -> int:
    """Goes back from the sum goal through items (words, what to take) to a sum in reach; gives that sum.

    Holds at most ``held`` states: of more items, only states at even distances, and those between them are made again."""
    if len(items) <= held:
        states = [reach]
        for words, _ in items[:-1]:
            states.append(states[-1] | states[-1] << words & mask)
        for (words, what), before in zip(reversed(items), reversed(states), strict=True):
            if not before >> goal & 1:
                take(what)
                goal -= words
        return goal
    step = -(-len(items) // held)
    parts = [items[k : k + step] for k in range(0, len(items), step)]
    starts = [reach]
    for p in parts[:-1]:
        starts.append(_grow(starts[-1], p, mask))
    for p, start in zip(reversed(parts), reversed(starts), strict=True):
        goal = _choose(start, p, goal, mask, held, take)
    return goal


def fit_budget(lengths: list[int], counts: list[int], budget: int, held_bits: int = HELD_BITS) -> list[int]:
    """How many documents of each length to take so that the words come as near as possible to budget.

    The programme works in units of the lengths' greatest common divisor and ends as soon as it reaches the best sum there is."""
    take = [0] * len(lengths)
    order = sorted((k for k in range(len(lengths)) if lengths[k] > 0 and counts[k] > 0), key=lambda k: -lengths[k])
    total = sum(lengths[k] * counts[k] for k in order)
    if total <= 0 or budget <= 0:
        return take
    share, seen, taken = max(0, budget - 2 * lengths[order[0]]), 0, 0
    for k in order:
        seen += lengths[k] * counts[k]
        take[k] = min(counts[k], (seen * share // total - taken) // lengths[k])
        taken += take[k] * lengths[k]
    unit = math.gcd(*(lengths[k] for k in order))
    rest = budget - taken
    cap = (rest + lengths[order[0]]) // unit + 1
    best = rest // unit + (2 * (rest % unit) > unit)
    # bit w of reach is set if w units can be made; items are powers-of-two bundles of each length, the shortest first
    mask, reach, items = (1 << (cap + 1)) - 1, 1, []
    for k in reversed(order):
        words = lengths[k] // unit
        free, bundle = min(counts[k] - take[k], cap // words), 1
        while free > 0:
            b = min(bundle, free)
            items.append((b * words, (k, b)))
            reach |= reach << b * words & mask
            free -= b
            bundle *= 2
        if reach >> best & 1:
            break
    below = (reach & ((1 << (rest // unit + 1)) - 1)).bit_length() - 1
    above = reach >> (rest // unit + 1)
    above = rest // unit + (above & -above).bit_length() if above else None
    goal = below if above is None or rest - below * unit <= above * unit - rest else above

    def chosen(what: tuple[int, int]) -> None:
        take[what[0]] += what[1]

    _choose(1, items, goal, mask, max(2, held_bits // cap), chosen)
    return take


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    text = whole_text()
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
        h.alias("h"),
    )


def _bucket(level: int):
    return F.shiftrightunsigned("h", 64 - level * BUCKET_BITS).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")


def _edges(counts: DataFrame, more: DataFrame) -> DataFrame:
    """counts: source, size, bucket, n; more: source, size, more -> source, size, edge, more: all buckets below the edge are taken whole,
    and so many rows of the edge. A length has at most 256 buckets."""
    own = Window.partitionBy("source", "size").orderBy("bucket")
    both = counts.alias("c").join(more.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source")) & (F.col("c.size") == F.col("m.size")))
    run = both.select("c.source", "c.size", "bucket", "n", "more").withColumn("upto", F.sum("n").over(own))
    return run.where("upto > more AND upto - n <= more").select("source", "size", F.col("bucket").alias("edge"), (F.col("more") - F.col("upto") + F.col("n")).alias("more"))


def _on(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with the columns of right, one row a source and size: by broadcast up to BROADCAST_ROWS rows."""
    right = right.withColumnsRenamed({"source": "_source", "size": "_size"})
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    return left.join(F.broadcast(right) if small else right, on, how).drop("_source", "_size")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, repeats, and h, the seeded hash of its doc_id and text, and source.

    One small row per source reaches the driver (a mixture names its sources); a source's lengths, at most as many as
    its longest text has words, are fitted in one task; all else is distributed."""
    spark = docs.sparkSession
    rows = stored(_sized(docs, seed), "mix")
    by_length = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    sources = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()
    sources.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = water_fill([r.source_size for r in sources], [w for w, _ in zip(cycle(weights), sources, strict=False)], share)
    plan = []
    for r, t in zip(sources, targets, strict=True):
        base = int(t // r.source_size) if r.source_size else 0
        plan.append((r.source, r.source_size, float(t), base, round(t) - base * r.source_size))
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, base long, rest long")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        pdf["more"] = fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), int(pdf["rest"].iloc[0]))
        return pdf[["source", "size", "n", "more", "source_size", "target", "base"]]

    planned = by_length.alias("l").join(F.broadcast(plan).alias("p"), F.col("l.source").eqNullSafe(F.col("p.source"))).select("l.source", "size", "n", "source_size", "target", "base", "rest")
    fitted = stored(planned.groupBy("source").applyInPandas(fit, "source string, size long, n long, more long, source_size long, target double, base long"), "mix-fitted")
    part = fitted.where("more > 0 AND more < n").select("source", "size", "more")
    coarse = _on(rows, part.drop("more"))
    first = stored(_edges(coarse.groupBy("source", "size", _bucket(1).alias("bucket")).agg(F.count("*").alias("n")), part), "mix-edges")
    inner = _on(rows, first).where(_bucket(1) == F.col("edge")).select("source", "size", "h", "more")
    inner = stored(inner, "mix-edge-rows")
    second = _edges(inner.groupBy("source", "size", _bucket(2).alias("bucket")).agg(F.count("*").alias("n")), first.drop("edge"))
    second = second.withColumnsRenamed({"edge": "edge2", "more": "more2"})
    # the last row taken of the second edge gives the greatest hash of all taken
    finest = _on(inner, second).where((_bucket(2) == F.col("edge2")) & (F.col("more2") > 0))
    place = F.row_number().over(Window.partitionBy("source", "size").orderBy("h"))
    last = finest.withColumn("place", place).where("place = more2").select("source", "size", F.col("h").alias("last"))
    cut = fitted
    for more in (first.drop("more"), second.drop("more2"), last):
        more = more.withColumnsRenamed({"source": "_source", "size": "_size"})
        cut = cut.join(more, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")), "left").drop("_source", "_size")
    cut = stored(cut, "mix-cut")
    b1, b2 = _bucket(1), _bucket(2)
    in_edge = (b2 < F.col("edge2")) | ((b2 == F.col("edge2")) & (F.col("h") <= F.col("last")))
    extra = F.when(F.col("more") >= F.col("n"), True).when(F.col("more") <= 0, False).when(b1 < F.col("edge"), True).when(b1 == F.col("edge"), in_edge)
    repeats = F.col("base") + F.coalesce(extra, F.lit(False)).cast("long")
    return _on(rows, cut).select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"), "h", "source")


def apply_mix(docs: DataFrame, seed: int = SEED, **parameters) -> DataFrame:
    """docs with each row as often as the mix takes it, 0 times included.

    Decisions are made on ids and hashes alone; rows that are taken are joined once with them."""
    text = whole_text()
    names = docs.columns
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    taken = mix(docs, seed=seed, **parameters).where("repeats > 0").groupBy("doc_id", "h", "source").agg(F.max("repeats").alias("n")).toDF("_1", "_2", "_3", "n")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("i"), key.alias("h"), F.col("source").cast("string").alias("s"))
    on = F.col("i").eqNullSafe(F.col("_1")) & (F.col("h") == F.col("_2")) & F.col("s").eqNullSafe(F.col("_3"))
    return rows.join(taken, on).select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(*[F.col(f"row.`{c}`") for c in names])


def op9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("repeats", "h", "source")
