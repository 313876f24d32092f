"""Ranked retrieval: BM25, phrases, vector top-k, fusion, dedup, neighbours, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import inner, inner_tokens, lexical_tokens, normalized
from quarrystone.operators.best import Best

K1, B = 1.5, 0.75
RRF_K = 60.0
VECTOR_WEIGHT, KEYWORD_WEIGHT, EXACT_WEIGHT = 1.0, 0.35, 0.75
MIN_RAW = 0.40


def bm25(records: DataFrame, queries: DataFrame, most: int = 500_000) -> DataFrame:
    """records: id, text; queries: query_id, text -> query_id, id, score.

    Tokens are made once: each record adds one empty token to its postings, which carries its length into the totals. Only tokens
    that a query has are kept. Up to ``most`` query tokens, they and their weights are broadcast, so that no token's postings meet in one task."""
    wanted = queries.select("query_id", F.explode(lexical_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    small = wanted.limit(most + 1).count() <= most
    keep = wanted.select("token").distinct().unionByName(records.sparkSession.createDataFrame([("",)], "token string"))
    docs = records.select("id", lexical_tokens(F.col("text")).alias("tokens"))
    each = docs.select("id", F.size("tokens").alias("len"), F.explode(F.array_append("tokens", F.lit(""))).alias("token"))
    tf = each.join(F.broadcast(keep) if small else keep, "token", "left_semi").groupBy("id", "len", "token").agg(F.count("*").alias("tf"))
    by_token = tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("len").alias("all_len"))
    total = by_token.where("token = ''").select(F.col("df").alias("n_docs"), (F.col("all_len") / F.col("df")).alias("avg_len"))
    weighted = wanted.join(by_token.select("token", "df"), "token").crossJoin(F.broadcast(total))  # total is one row
    rows = tf.join(F.broadcast(weighted) if small else weighted, "token")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.groupBy("query_id", "id").agg(F.sum(idf * weight * F.col("qf")).alias("score"))


def _best_scores(docs: DataFrame, wanted: pa.Table, phrases: list[tuple] | None, k: int, group: str | None, exact_first: bool, cells: int) -> DataFrame:
    """docs: id, tokens[, body][, group], ids that no two rows share; wanted: query_id, token, qf; phrases: query_id, phrase, inner tokens. See bm25_best."""
    spark = docs.sparkSession
    keep = spark.createDataFrame([(t,) for t in ["", *pc.unique(wanted.column("token")).to_pylist()]], "token string")
    each = docs.select(F.size("tokens").alias("len"), F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("token"))
    held = {r.token: (r.df, r.all_len) for r in each.join(F.broadcast(keep), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"), F.sum("len").alias("all_len")).collect()}
    n_docs, all_len = held.pop("", (0, 0))
    average = all_len / n_docs if all_len else 1.0
    known = wanted.filter(pc.is_in(wanted.column("token"), pa.array(list(held), pa.string()))).sort_by("token").combine_chunks()
    names = pc.unique(wanted.column("query_id"))
    at = {v: i for i, v in enumerate(names.to_pylist())}
    tokens = pc.unique(known.column("token"))
    place = {v: i for i, v in enumerate(tokens.to_pylist())}
    df = np.array([held[v][0] for v in tokens.to_pylist()], np.float64)
    owner = np.array([place[v] for v in known.column("token").to_pylist()], np.int64)
    count = np.bincount(owner, minlength=len(tokens))
    start = np.cumsum(count) - count
    query = np.array([at[v] for v in known.column("query_id").to_pylist()], np.int64)
    gain = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))[owner] * known.column("qf").to_numpy() * (K1 + 1)
    # a phrase is looked for where its rarest inner token is; without inner tokens, everywhere
    sought, loose = {}, []
    for q, phrase, inside in phrases or []:
        if q in at and phrase and all(x in place for x in inside):
            (sought.setdefault(min((place[x] for x in inside), key=lambda t: df[t]), []) if inside else loose).append((at[q], phrase))
    anchors = np.zeros(len(tokens), bool)
    anchors[list(sought)] = True
    nq, nt, exacts = len(names), len(tokens), phrases is not None
    more = [group] if group else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, groups, step = Best(k), {}, max(cells // max(nq, nt, 1), 1)
        for b in batches:
            codes = _codes(b.column(group), groups) if group else np.zeros(b.num_rows, np.int64)
            for row in range(0, b.num_rows, step):
                part = b.slice(row, step)
                lists, n = part.column("tokens"), part.num_rows
                size = np.diff(lists.offsets.to_numpy())
                found = pc.fill_null(pc.index_in(lists.flatten(), value_set=tokens), -1).to_numpy()
                tf = np.bincount((np.repeat(np.arange(n), size) * nt + found)[found >= 0], minlength=n * nt)
                cell = np.flatnonzero(tf)
                doc, token = cell // max(nt, 1), cell % max(nt, 1)
                weight = tf[cell] / (tf[cell] + K1 * (1 - B + B * size[doc] / average))
                times = count[token]
                entry = np.repeat(start[token] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                score = np.bincount(np.repeat(doc, times) * nq + query[entry], np.repeat(weight, times) * gain[entry], minlength=n * nq).reshape(n, nq)
                exact = np.zeros((n, nq), bool)
                if exacts:
                    there = np.flatnonzero(anchors[token])
                    bodies = {d: part.column("body")[int(d)].as_py() for d in (range(n) if loose else np.unique(doc[there]))}
                    for d, t in zip(doc[there], token[there], strict=True):
                        for q, phrase in sought[t]:
                            exact[d, q] = phrase in bodies[d]
                    for d in range(n) if loose else ():
                        for q, phrase in loose:
                            exact[d, q] = phrase in bodies[d]
                own = codes[row : row + n]
                for code in np.unique(own):
                    mine, slots = np.flatnonzero(own == code), code * nq + np.arange(nq)
                    s, e = score[mine], exact[mine]
                    r, q = np.nonzero((s > 0) & ((s >= best.floor(slots)) | (e if exact_first else False)))
                    # whether a hit is exact is kept in its slot
                    best.add(slots[q], s[r, q], pa.StructArray.from_arrays([part.column("id").take(pa.array(mine[r])), pa.array(e[r, q])], ["id", "exact"]), e[r, q] if exact_first else None)
        if left := best.take():
            slot, value, ids, _ = left
            own = {group: pa.array(list(groups), b.schema.field(group).type).take(pa.array(slot // nq))} if group else {}
            yield from _out({"query_id": names.take(pa.array(slot % nq)), "id": ids.field("id"), "score": pa.array(value), **({"exact": ids.field("exact")} if exacts else {}), **own})

    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kind["query_id"] = spark.createDataFrame(wanted.select(["query_id"]).slice(0, 0)).schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind['query_id']}, id {kind['id']}, score double" + (", exact boolean" if exacts else "") + (f", {group} {kind[group]}" if group else "")
    return docs.mapInArrow(run, schema)


def bm25_best(records: DataFrame, queries: DataFrame, k: int, group: str | None = None, phrases: bool = False, exact_first: bool = False, most: int = 500_000, cells: int = 1 << 21) -> DataFrame:
    """bm25() and the column ``group`` of the records, without scores that cannot be among the k best of a query (and group); with phrases
    whether the record contains the whole query (exact), with exact_first such records count as better than all others.

    The number of records with each query token and their lengths are taken from the records first, when this is called. Then a task scores its
    records in bounded pieces and holds k a query (and group), so that what is shuffled does not grow with the records of a task. More than
    ``most`` query tokens, or records that share an id, take the way of bm25(), over a shuffle of all scores."""
    wanted = queries.select("query_id", F.explode(lexical_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    held = wanted.limit(most + 1).toArrow()
    more = [group] if group else []
    if held.num_rows > most or not records.groupBy("id").count().where("count > 1").isEmpty():
        out = bm25(records, queries)
        if phrases:
            out = out.join(exact_phrases(records, queries).distinct().withColumn("exact", F.lit(True)), ["query_id", "id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
        return out.join(records.groupBy("id").agg(F.first(group).alias(group)), "id") if group else out
    docs = records.where("text IS NOT NULL").select("id", lexical_tokens(F.col("text")).alias("tokens"), *([normalized(F.col("text")).alias("body")] if phrases else []), *more)
    said = queries.where("text IS NOT NULL").select("query_id", normalized(F.col("text")), inner_tokens(F.col("text"))).collect() if phrases else None
    return _best_scores(docs, held, [tuple(x) for x in said] if phrases else None, k, group, exact_first, cells)


def ranked(scores: DataFrame, k: int, by: str = "score", name: str = "rank") -> DataFrame:
    """The k best of every query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 9)), "id")
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def with_records(hits: DataFrame, records: DataFrame, queries: DataFrame, k: int, most: int = 500_000) -> DataFrame:
    """hits, of which a query has k at most, with their records; up to ``most`` hits are broadcast, so that the records stay where they are."""
    few = queries.limit(most // k + 1).count() <= most // k
    return (F.broadcast(hits) if few else hits).join(records, "id")


def exact_phrases(records: DataFrame, queries: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """query_id, id of the records that contain the whole normalised query.

    Candidates hold every token that all texts with the phrase have: the bigrams of its CJK runs, and its Latin
    tokens but one at either end in text order, which the phrase may cut. Queries of up to most_bytes in all go to every task, which looks for a
    phrase where its longest such token is; more meet the records' tokens in a join. Queries without such tokens are compared with every record."""
    q = queries.select("query_id", normalized(F.col("text")).alias("phrase"), inner_tokens(F.col("text")).alias("inside"))
    r = records.select("id", normalized(F.col("text")).alias("body"), lexical_tokens(F.col("text")).alias("tokens"))
    q = q.where(F.length("phrase") > 0)
    if q.agg(F.coalesce(F.sum(F.length("phrase") + 100), F.lit(0))).first()[0] <= most_bytes:
        return _phrases_found(r, q)
    need = q.where(F.size("inside") > 0).select("query_id", F.size("inside").alias("n"), F.explode("inside").alias("token"))
    have = r.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    found = have.join(need, "token").groupBy("query_id", "id", "n").agg(F.count("*").alias("m")).where("m = n")
    long = found.join(q, "query_id").join(r, "id").where(F.contains("body", "phrase")).select("query_id", "id")
    short = q.where(F.size("inside") == 0).join(r, F.contains(F.col("body"), F.col("phrase"))).select("query_id", "id")
    return long.unionByName(short)


def _phrases_found(records: DataFrame, queries: DataFrame, step: int = 512) -> DataFrame:
    """records: id, body, tokens; queries: query_id, phrase, inside. See exact_phrases."""
    held = queries.select("query_id", "phrase", "inside").toArrow().combine_chunks()
    names = pa.concat_arrays(held.column(0).chunks) if held.num_rows else pa.array([])
    sought, loose = {}, []
    for i, (phrase, inside) in enumerate(zip(held.column(1).to_pylist(), held.column(2).to_pylist(), strict=True)):
        (sought.setdefault(max(inside, key=len), []) if inside else loose).append((i, phrase))
    anchors = pa.array(list(sought), pa.string())
    at = list(sought.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, step):
                b = whole.slice(row, step)
                lists, out = b.column("tokens"), []
                found = pc.fill_null(pc.index_in(lists.flatten(), value_set=anchors), -1).to_numpy()
                there = np.flatnonzero(found >= 0)
                pairs = np.unique(np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))[there] * len(at) + found[there])
                last, body = -1, ""
                for d, t in zip((pairs // max(len(at), 1)).tolist(), (pairs % max(len(at), 1)).tolist(), strict=True):
                    if d != last:
                        last, body = d, b.column("body")[d].as_py()
                    out += [(i, d) for i, phrase in at[t] if phrase in body]
                if loose:
                    out += [(i, d) for d, text in enumerate(b.column("body").to_pylist()) for i, phrase in loose if phrase in text]
                if out:
                    i, d = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                    yield from _out({"query_id": names.take(i), "id": b.column("id").take(d)})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return records.where("body IS NOT NULL").select("id", "body", "tokens").mapInArrow(run, f"query_id {kind(queries, 'query_id')}, id {kind(records, 'id')}")


def _codes(column: pa.Array, known: dict) -> np.ndarray:
    """A number for every value, the same one in all batches."""
    encoded = column.dictionary_encode()
    own = np.array([known.setdefault(v, len(known)) for v in encoded.dictionary.to_pylist()] + [-1], np.int64)
    index = pc.fill_null(encoded.indices, len(own) - 1).to_numpy()
    if encoded.null_count:
        own[-1] = known.setdefault(None, len(known))
    return own[index]


def _out(columns: dict[str, pa.Array], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for at in range(0, whole.num_rows, rows):
        yield whole.slice(at, rows)


def inner_products(records: DataFrame, queries: DataFrame, k: int | None = None, group: str | None = None, most_bytes: int = 64 << 20, cells: int = 1 << 19) -> DataFrame:
    """records: id, vector; queries: query_id, vector -> query_id, id, raw, the inner product in double precision, and the column ``group`` of the records.

    Queries of up to most_bytes in all go to every task as one matrix, which meets the records in products of at most ``cells`` numbers (one
    record at least). With k, what can be among a task's k best of a query (and group) leaves it, and no more is held. More queries meet the
    records in a join of blocks."""
    slim = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    size = slim.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0] * 8
    more = [group] if group else []
    if size > most_bytes:
        blocks = slim.groupBy(F.pmod(F.xxhash64("query_id"), F.ceil(F.lit(size) / F.lit(1 << 20))).alias("block")).agg(F.collect_list(F.struct("query_id", "vector")).alias("qs"))
        pairs = records.join(blocks).select("id", *more, F.col("vector").alias("v"), F.explode("qs").alias("q"))
        return pairs.select("q.query_id", "id", inner(F.col("v"), F.col("q.vector")).alias("raw"), *more)
    held = slim.toArrow().combine_chunks()
    n, names = held.num_rows, pa.concat_arrays(held.column(0).chunks) if held.num_rows else pa.array([])
    matrix = held.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))
    kinds = [dict(d.dtypes)[c] for d, c in ((slim, "query_id"), (records, "id"), *((records, g) for g in more))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known, step = Best(k) if k else None, {}, max(cells // max(n, 1), 1)
        for b in batches:
            if not b.num_rows or not n:
                continue
            vectors = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            codes = _codes(b.column(2), known) if group and k else np.zeros(b.num_rows, np.int64)
            for code in np.unique(codes):
                mine = np.flatnonzero(codes == code)
                for at in range(0, len(mine), step):
                    rows = mine[at : at + step]
                    raw = vectors[rows] @ matrix.T
                    if best:
                        slots = code * n + np.arange(n)
                        r, q = np.nonzero(~(raw < best.floor(slots)))
                        best.add(slots[q], raw[r, q], b.column(0).take(pa.array(rows[r])))
                    else:
                        taken = pa.array(np.repeat(rows, n))
                        yield from _out({"query_id": names.take(pa.array(np.tile(np.arange(n), len(rows)))), "id": b.column(0).take(taken), "raw": pa.array(raw.ravel()), **{g: b.column(2).take(taken) for g in more}})
        if best and (left := best.take()):
            slot, raw, ids, _ = left
            own = {group: pa.array(list(known), b.schema.field(2).type).take(pa.array(slot // n))} if group else {}
            yield from _out({"query_id": names.take(pa.array(slot % n)), "id": ids, "raw": pa.array(raw), **own})

    schema = f"query_id {kinds[0]}, id {kinds[1]}, raw double" + (f", {group} {kinds[2]}" if group else "")
    return records.where("vector IS NOT NULL").select("id", "vector", *more).mapInArrow(run, schema)


def vector_topk(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """records: id, vector; queries: query_id, vector -> query_id, id, raw, vector_rank by exact inner product."""
    return ranked(inner_products(records, queries, k), k, "raw", "vector_rank")


def fuse(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Weighted reciprocal rank fusion of vector hits (raw, vector_rank) and keyword hits (score, keyword_rank, exact).

    A hit passes with a raw score of at least MIN_RAW or a keyword rank."""
    both = vector.join(keyword, ["query_id", "id"], "full_outer").where((F.col("raw") >= MIN_RAW) | F.col("keyword_rank").isNotNull())
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    exact = F.when(F.coalesce("exact", F.lit(False)), EXACT_WEIGHT / (RRF_K + 1)).otherwise(0.0)
    fused = both.withColumn("fusion", part(VECTOR_WEIGHT, "vector_rank") + part(KEYWORD_WEIGHT, "keyword_rank") + exact)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion", 9)), F.desc(F.round(F.coalesce("raw", F.lit(-1.0)), 6)), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_hits(hits: DataFrame, k: int) -> DataFrame:
    """hits: query_id, id, rank, content_hash. The best of equal contents, ranked anew."""
    first = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "content_hash").orderBy("rank"))).where("place = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k).drop("place")


def metrics(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """expected: query_id, id; hits: query_id, id, rank. Recall at 5 and 10 over evidence, any and all, and MRR."""
    found = expected.join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    at = lambda k: F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
    each = found.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(at(5)).alias("at5"), F.sum(at(10)).alias("at10"), F.max(at(10)).alias("any10"), F.min(at(10)).alias("all10"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr")
    )
    return each.agg(
        F.count("*").alias("n_queries"), F.round(F.sum("at5") / F.sum("n"), 6).alias("recall_5"), F.round(F.sum("at10") / F.sum("n"), 6).alias("recall_10"),
        F.round(F.avg("any10"), 6).alias("any_10"), F.round(F.avg("all10"), 6).alias("all_10"), F.round(F.avg("rr"), 6).alias("mrr"),
    )
