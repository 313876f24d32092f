"""MinHash near-dedup with an LSH forest, exact confirmation and distributed components.

1. Every document's set of distinct word shingles is hashed to 64 bits a shingle; the set gets a
   digest and TREES x DEPTH MinHash values of 16 bits. Documents with equal sets form a class, and one
   member stands for it from here on, so copies cost nothing more.
2. Each tree is one global order of the classes by the tree's DEPTH values, held range-partitioned.
   Runs that share a prefix of FLOOR values are regions; a region of more than REGION classes is split by
   one more value, again and again (adaptive depth). Classes of a region that is small enough are
   candidates of each other. A region that is still large at full depth is saturated: at first it gives each
   class its neighbour in the order and the region's hub, the member that falls into the most and largest
   such regions of all trees.
3. Candidates are screened by size and by the share of equal MinHash values (five standard deviations below
   the threshold still pass), then confirmed on the full sets: 100 * intersection >= percent * union.
4. Components of the confirmed links come from alternating large-star and small-star steps.
5. What a saturated region still may hide are links between members of different components. The members
   outside the region's largest component are compared with all members, screen first and then full sets, in
   blocks of bounded size, and what links joins the components. Pairs inside a component can change nothing.

A pair of similarity 0.85 shares FLOOR values in at least one of the trees but for 4 in 10 million pairs; a
region that a range boundary cuts is missed in that tree alone; classes that agree in all values are not. Where the regions of a pair
are split to full depth in every tree, 0.17 % of such pairs share none.

Texts without words have the empty set and are linked with nothing; null texts count as such. Texts of
fewer words than a shingle have one shingle. A null doc_id is linked with nothing, has a null
component_id and is kept. Rows that share a doc_id are one document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import id_text, in_slices, stored

SHINGLE = 5
TREES, DEPTH, FLOOR = 20, 8, 4
REGION = 24
#: Members of a saturated region that are compared at once.
BLOCK = 512
#: Regions whose sizes, hubs and main components are broadcast to the members.
REGIONS = 200_000
#: Shingles of all members that are compared at once, on average.
BLOCK_SHINGLES = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(7))
_A = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Hashed sets of word shingles; word hashes are kept in a bounded table."""

    def __init__(self, width: int = SHINGLE, keep: int = 120_000):
        self.width, self.keep, self.known = width, keep, {}

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct shingle hashes. bytes.lower() changes A-Z only, bytes.split() splits at the contract's spaces."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        code = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.width + 1)
        h = code[:n].copy()
        for k in range(1, min(self.width, len(words))):
            h = (h ^ h >> np.uint64(29)) * _P + code[k : k + n]
        h = (h ^ h >> np.uint64(32)) * _P
        h ^= h >> np.uint64(31)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def min_values(h: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values of 16 bits."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 1024):
        np.minimum(least, (h[k : k + 1024, None] * _A + _B).min(axis=0), out=least)
    return ((least * _P) >> np.uint64(48)).astype(np.uint16)


def _keys(sig: np.ndarray) -> np.ndarray:
    """Per tree two signed longs: values 1-4 and 5-8, ordered as the values are."""
    four = sig.reshape(-1, TREES, 2, DEPTH // 2).astype(np.uint64)
    packed = np.zeros(four.shape[:3], np.uint64)
    for k in range(DEPTH // 2):
        packed = packed << np.uint64(16) | four[..., k]
    return (packed ^ np.uint64(1 << 63)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (hex digest of the set, null if empty), trees (binary: the longs of every tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in in_slices(batches):
            n, name, trees = [], [], []
            for t in b.column(1).to_pylist():
                h = shingler(t)
                n.append(len(h))
                name.append(hashlib.sha256(h.tobytes()).digest()[:16] if len(h) else None)
                trees.append(_keys(min_values(h)).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(trees, pa.binary())], names=["doc_id", "n_shingles", "class", "trees"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_shingles long, class binary, trees binary")


def _orders(reps: DataFrame) -> DataFrame:
    """rep -> one row per tree: tree, hi, lo, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 4096):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(len(ids), TREES, 2)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(keys[:, t, 0]), pa.array(keys[:, t, 1]), pa.array(ids)], names=["tree", "hi", "lo", "id"])

    return reps.select("id", "trees").mapInArrow(run, "tree int, hi long, lo long, id long")


def common_prefix(tree: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of each row but the first, how many values it shares with the row before; -1 in another tree."""
    x, y = (hi[1:] ^ hi[:-1]).view(np.uint64), (lo[1:] ^ lo[:-1]).view(np.uint64)
    out = np.full(len(x), DEPTH, np.int64)
    for k in range(DEPTH - 1, -1, -1):
        part, shift = (x, 48 - 16 * k) if k < DEPTH // 2 else (y, 48 - 16 * (k - DEPTH // 2))
        out[part >> np.uint64(shift) != 0] = k
    out[tree[1:] != tree[:-1]] = -1
    return out


def forest_regions(shared: np.ndarray, region: int = REGION) -> Iterator[tuple[int, int, bool]]:
    """Runs (first, stop, saturated) of an order whose rows share at least FLOOR values, split by further
    values until they have at most region rows; saturated ones share all values and are larger."""
    todo = [(0, len(shared) + 1, FLOOR - 1)]
    while todo:
        a, z, depth = todo.pop()
        if depth >= FLOOR and (z - a <= region or depth == DEPTH):
            if z - a > 1:
                yield a, z, z - a > region
            continue
        cuts = a + 1 + np.flatnonzero(shared[a : z - 1] < depth + 1)
        edges = np.concatenate([[a], cuts, [z]])
        todo.extend((int(p), int(q), depth + 1) for p, q in zip(edges[:-1], edges[1:], strict=True) if q - p > 1) if depth + 1 <= DEPTH else None


def _with_region(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows with what regions (one row a region) say of theirs: by broadcast up to REGIONS of them, so that no region's rows meet in one task."""
    small = regions.limit(REGIONS + 1).count() <= REGIONS
    return rows.join(F.broadcast(regions) if small else regions, ["tree", "hi", "lo"])


def candidates(reps: DataFrame, region: int = REGION) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of class representatives that the forest proposes, and the members of saturated regions."""
    orders = _orders(reps).repartitionByRange("tree", "hi", "lo", "id").sortWithinPartitions("tree", "hi", "lo", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last run of a batch may go on: it is carried over to the next
        held: list[pa.RecordBatch] = []
        first = True
        for b in batches:
            held.append(b)
            table = pa.Table.from_batches(held)
            tree, hi = (table.column(k).to_numpy() for k in (0, 1))
            same = (tree == tree[-1]) & (hi == hi[-1])
            cut = len(tree) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield from propose(table.slice(0, cut), first, False)
                first = False
                held = [table.slice(cut).combine_chunks().to_batches()[0]]
        if held:
            yield from propose(pa.Table.from_batches(held), first, True)

    def propose(table: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        tree, hi, lo, ids = (table.column(k).to_numpy() for k in range(4))
        left, right, near, far, size, where = [], [], [], [], [], []
        shared = common_prefix(tree, hi, lo)
        # a run of equal values at either end may go on in another partition: it counts as saturated
        cuts = np.flatnonzero(shared < DEPTH)
        head, tail = (int(cuts[0]) + 1, int(cuts[-1]) + 1) if len(cuts) else (len(ids), 0)
        ends = {(0, head)} if first else set()
        if last:
            ends.add((tail, len(ids)))
        where.extend((tree[a:z], hi[a:z], lo[a:z], ids[a:z]) for a, z in ends if z - a <= region)
        for a, z, saturated in forest_regions(shared, region):
            if saturated:
                near.append(ids[a : z - 1]), far.append(ids[a + 1 : z])
                where.append((tree[a:z], hi[a:z], lo[a:z], ids[a:z]))
            else:
                i, j = np.triu_indices(z - a, 1)
                left.append(ids[a + i]), right.append(ids[a + j])
        left, right = np.concatenate([*left, *near, np.zeros(0, np.int64)]), np.concatenate([*right, *far, np.zeros(0, np.int64)])
        left, right = np.minimum(left, right), np.maximum(left, right)
        both = np.unique(np.stack([left, right], 1), axis=0)
        both = both[both[:, 0] < both[:, 1]]
        none = pa.nulls(len(both), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), none.cast(pa.int32()), none, none], names=["a", "b", "tree", "hi", "lo"])
        for t, h, low, i in where:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.nulls(len(i), pa.int64()), pa.array(t), pa.array(h), pa.array(low)], names=["a", "b", "tree", "hi", "lo"])

    found = stored(orders.mapInArrow(run, "a long, b long, tree int, hi long, lo long"), "forest")
    pairs = found.where("b IS NOT NULL").select("a", "b")
    large = found.where("b IS NULL").select(F.col("a").alias("id"), "tree", "hi", "lo")
    sizes = stored(large.groupBy("tree", "hi", "lo").agg(F.count("*").alias("n")), "region-sizes")
    weight = _with_region(large, sizes).groupBy("id").agg(F.sum("n").alias("w"))
    hubs = large.join(weight, "id").groupBy("tree", "hi", "lo").agg(F.max(F.struct("w", "id")).getField("id").alias("hub"))
    to_hub = _with_region(large, stored(hubs, "hubs")).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return pairs.unionByName(to_hub).distinct(), large


def least_equal(percent: int) -> int:
    """Equal MinHash values that a pair of that similarity has, less five standard deviations."""
    n, p = TREES * DEPTH, percent / 100
    return int(n * p - 5 * math.sqrt(n * p * (1 - p)))


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The MinHash values of each row; their order inside a row is the same in all rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)


def screened(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes and MinHash values allow the similarity: a, b."""
    least = least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 4096):
            keep = pa.array((_values(b.column(2)) == _values(b.column(3))).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    one = pairs.join(reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("trees").alias("x")), "a")
    two = one.join(reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("trees").alias("y")), "b")
    return two.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _both(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, neither empty."""
    if len(y) < len(x):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def across(large: DataFrame, found: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links a, b of saturated regions that join different components."""
    key, least = ["tree", "hi", "lo"], least_equal(percent)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (i, c), (j, d) = ([t.column(k).to_numpy().copy() for k in ("id", "component")] for t in (left, right))
        x, y = _values(left.column("trees")), _values(right.column("trees"))
        u, v = ([np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()] for t in (left, right))
        tree, m = left.column("tree")[0].as_py() if len(i) else 0, np.array([len(g) for g in v])
        links = []
        for k, own in enumerate(u):
            at = np.flatnonzero((d != c[k]) & (100 * np.minimum(m, len(own)) >= percent * np.maximum(m, len(own))))
            equal = y[at] == x[k]
            # a pair that agrees in all values of an earlier tree is compared there
            earlier = equal.reshape(-1, TREES, DEPTH)[:, :tree].all(axis=2).any(axis=1)
            for r in at[(equal.sum(axis=1) >= least) & ~earlier]:
                if c[k] != d[r]:
                    both = _both(own, v[r])
                    if 100 * both >= percent * (len(own) + len(v[r]) - both):
                        links.append((int(i[k]), int(j[r])))
                        old = d[r]
                        c[c == old], d[d == old] = c[k], c[k]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    member = large.distinct().join(found, "id", "left").join(reps.select("id", "n_shingles"), "id").select("id", *key, "n_shingles", F.coalesce("component", "id").alias("component"))
    part = member.groupBy(*key, "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    split = part.groupBy(*key).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.sum("s").alias("s")).where("top.n < total")
    count = lambda n: F.greatest(F.ceil(n / block), F.ceil(F.col("s") * n / F.col("total") / BLOCK_SHINGLES))
    split = split.select(*key, F.col("top.component").alias("main"), count(F.col("total")).alias("blocks"), count(F.col("total") - F.col("top.n")).alias("parts"))
    member = stored(_with_region(member, stored(split, "split")), "members")
    held = [*key, "id", "component", "trees", "grams", "p", "q"]
    whole = member.join(reps.select("id", "trees"), "id").join(sets, "id")
    own, every = F.xxhash64("id"), lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    rest = whole.where("component <> main").withColumn("p", F.pmod(own, "parts").cast("int")).withColumn("q", every(F.col("blocks"))).select(held).toDF(*held)
    whole = whole.withColumn("q", F.pmod(own, "blocks").cast("int")).withColumn("p", every(F.col("parts"))).select(held).toDF(*held)
    return rest.groupBy(*key, "p", "q").cogroup(whole.groupBy(*key, "p", "q")).applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, grams (binary: sorted shingle hashes) of the representatives in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in in_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingler(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "grams"])

    # joined alike at every size: the list of ids grows with the corpus and is never broadcast
    return id_text(docs).join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(run, "id long, grams binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = _both(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], names=["a", "b"])

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id that has a link."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now


def near_groups(docs: DataFrame, percent: int = 85, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    sig = stored(signatures(docs), "signatures")
    known = sig.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(known.groupBy("class").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    reps = known.join(classes.select("id", F.col("class").alias("c")), (F.col("doc_id") == F.col("id")) & (F.col("class") == F.col("c"))).select("id", "n_shingles", "trees")
    reps = stored(reps, "representatives")
    pairs, large = candidates(reps, region)
    pairs = stored(screened(pairs, reps, percent), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select("id")).distinct()
    sets = stored(_sets(docs, ids), "sets")
    links = confirm(pairs, sets, percent)
    # rows that share a doc_id but not a set are one document: its classes are linked through their representatives
    shared = known.groupBy("doc_id").agg(F.min("class").alias("c1"), F.max("class").alias("c2"), F.count("*").alias("n")).where("n > 1 AND c1 <> c2").select("doc_id")
    own = known.select("doc_id", "class").join(shared, "doc_id", "left_semi").join(classes.select("class", "id"), "class")
    links = links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    found = components(links)
    links = stored(across(large, found, reps, sets, percent, block), "across")
    if not links.isEmpty():
        for end in ("a", "b"):
            links = links.join(found.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        joined = components(links).select(F.col("id").alias("component"), F.col("component").alias("root"))
        # an id that had no link so far is a component of its own
        every = found.unionByName(joined.select(F.col("component").alias("id"), "component"))
        found = every.distinct().join(joined, "component", "left").groupBy("id").agg(F.min(F.coalesce("root", "component")).alias("component"))
    groups = classes.select("class", "id").join(found, "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    return (
        sig.select("doc_id", "n_shingles", "class")
        .join(groups, "class", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op8_near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_groups(docs)
