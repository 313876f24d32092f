"""The training-data operators against brute force on small tables with nulls, ties, empty and long texts."""

import hashlib
import random

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import bpe_lexicon, budget_mix, grace_dedup, lang_rank, lsh_forest, packed_ids, weighted_sampling
from quarrystone.llm.queries import word_bpe

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    near = base.split()
    near[50] = "changed"
    out = {0: base, 1: base, 2: " ".join(near), 3: None, 4: "", 5: " \n\t ", 6: "one two", 7: prose(2, 30_000), 8: "Ünïcode ÀÉ straße\x1cx <|endoftext|> it's 7 77 a7b Σας", 9: "?!... 123"}
    return out | {k: prose(k, 40 + k) for k in range(10, 40)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, None, "x", "y") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    data = packed_ids.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (packed_ids.unpack(data, 1001, bits) == ids).all()


def test_packed_ids(spark, docs, empty, texts, library):
    got, at = by_id(packed_ids.op1_token_ids(spark, docs, word_bpe())), 0
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert packed_ids.op1_token_ids(spark, empty, word_bpe()).count() == 0


@pytest.mark.parametrize("budget", [grace_dedup.BUDGET, 3000])
def test_exact_dedup(docs, empty, texts, budget):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t or "", []).append(i)
    for i, r in by_id(grace_dedup.exact_groups(docs, budget)).items():
        own = groups[texts[i] or ""]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), i == max(own), hashlib.sha256((texts[i] or "").encode()).hexdigest())
    assert grace_dedup.exact_groups(empty).count() == 0
    twice = grace_dedup.exact_groups(docs.union(docs)).collect()
    assert sum(r.kept for r in twice) == len(groups)


def test_bpe(spark, docs, empty, texts, library):
    for i, r in by_id(bpe_lexicon.op6_bpe(spark, docs, word_bpe())).items():
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_lexicon.op6_bpe(spark, empty, word_bpe()).count() == 0


def test_fingerprints(spark, docs, empty, texts):
    got, order = by_id(weighted_sampling.fingerprints(docs)), sorted(texts, reverse=True)
    jaccard = lambda a, b: (lambda x, y: sum((x & y).values()) / max(1, sum((x | y).values())))(Counter(a.split()), Counter(b.split()))
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        if len(t) > 200:
            assert abs(got[i].near_edited - jaccard(t, edited)) < 0.3
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1.0
    assert weighted_sampling.fingerprints(empty).count() == 0


def test_near_dedup(docs, empty):
    got = by_id(lsh_forest.near_groups(docs))
    assert {got[i].component_id for i in (0, 1, 2)} == {0}
    assert all(got[i].component_id == i and got[i].kept for i in range(3, 40))
    assert got[3].n_shingles == got[5].n_shingles == 0 and got[6].n_shingles == 1
    assert lsh_forest.near_groups(empty).count() == 0


@pytest.mark.parametrize(("percent", "region", "block"), [(85, 2, 7), (80, 2, 512), (85, 24, 512)])
def test_near_dedup_of_a_group_of_near_copies(spark, percent, region, block):
    """Small regions make every region saturated; chains, islands and stragglers are found as brute force finds them."""
    r, words, texts = random.Random(11), prose(3, 240).split(), []
    for island in range(3):
        now = list(words)
        for k in r.sample(range(240), 3 * island):
            now[k] = f"island{island}"
        for _ in range(30):
            if r.random() < 0.5:
                now[r.randrange(240)] = f"step{r.randrange(10**6)}"
            own = list(now)
            for k in r.sample(range(240), r.randrange(6)):
                own[k] = f"own{r.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(x & y) >= percent * len(x | y)]
    for _ in texts:
        for i, j in links:
            low, high = sorted((least[i], least[j]))
            least = [low if c == high else c for c in least] if low < high else least
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(lsh_forest.near_groups(docs, percent, region, block))
    assert [got[i].component_id for i in range(len(texts))] == least
    assert len(set(least)) > 1


def test_mix(docs, empty, texts):
    got = budget_mix.mix(docs).collect()
    source = {i: f"s{i % 3}" if i % 7 else None for i in texts}
    taken, target = Counter(), {}
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split()) or r.doc_id == 8
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    sizes = Counter()
    for r in got:
        sizes[source[r.doc_id]] += r.size
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    want = dict(zip(order, budget_mix.water_fill([sizes[s] for s in order], [3, 1, 2, 3]), strict=True))
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and {r.source_size for r in got if source[r.doc_id] == s} == {sizes[s]}
        lengths = Counter(r.size for r in got if source[r.doc_id] == s)
        base = int(target[s] // sizes[s])
        assert abs(taken[s] - round(target[s])) <= exhaustive(list(lengths), list(lengths.values()), round(target[s]) - base * sizes[s]) + 1
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = {(r.doc_id, r.taken) for r in budget_mix.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    rows = budget_mix.apply_mix(docs)
    assert rows.columns == docs.columns and Counter(r.doc_id for r in rows.collect()) == Counter({r.doc_id: r.repeats for r in got if r.repeats})
    assert budget_mix.mix(empty).count() == 0


def exhaustive(lengths, counts, budget):
    """The least distance to budget of any choice of documents."""
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    return min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("held_bits", [1 << 29, 40])
@pytest.mark.parametrize("seed", range(40))
def test_fit_budget(seed, held_bits):
    """The optimum wherever the budget is at most two of the longest; else as near as the programme's part allows."""
    r = random.Random(seed)
    unit = r.choice([1, 1, 2, 5])
    lengths = [unit * n for n in r.sample(range(1, 40), 4)]
    counts = [r.randrange(1, 5) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    for budget in (r.randrange(1, total + 1), r.randrange(1, 2 * max(lengths))):
        take = budget_mix.fit_budget(lengths, counts, budget, held_bits)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        off = abs(sum(n * t for n, t in zip(lengths, take, strict=True)) - budget)
        best = exhaustive(lengths, counts, budget)
        assert off == best if budget <= 2 * max(lengths) else best <= off <= max(best, max(lengths) // 2)
    assert budget_mix.fit_budget([0, 3], [5, 0], 4) == [0, 0] and budget_mix.fit_budget([], [], 4) == []


def test_fit_budget_memory():
    """Even lengths and an odd budget, the last sum never reached; and one very long text."""
    import tracemalloc

    tracemalloc.start()
    lengths = [2 * k for k in range(1, 6001)]
    take = budget_mix.fit_budget(lengths, [3] * 6000, 20_000_001)
    assert abs(sum(n * t for n, t in zip(lengths, take, strict=True)) - 20_000_001) == 1
    lengths = [*range(1000, 1300), 50_000_000]
    take = budget_mix.fit_budget(lengths, [2] * 301, 50_400_123)
    assert sum(n * t for n, t in zip(lengths, take, strict=True)) == 50_400_123
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_language(spark, empty):
    r, rows = random.Random(5), []
    for i in range(60):
        lang, words = (("xx", "aba baba abba"), ("yy", "nono onno noon"))[i % 2]
        rows.append((i, " ".join(r.choice(words.split()) for _ in range(20)), lang))
    rows += [(100, None, "xx"), (101, "12 !?", "yy"), (None, "abba", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pred = lambda df, profiles: df.select("*", lang_rank.language(profiles)(F.col("text")).alias("x")).select("*", "x.*")
    got = {x.doc_id: x for x in pred(docs, lang_rank.learn_folds(docs)).collect()}
    assert all(x.lang_pred == x.lang for i, x in got.items() if i is not None and i < 60)
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[None].lang_pred == "xx"
    assert lang_rank.learn_folds(empty) == {} and pred(empty, {}).count() == 0
    assert {x.lang_pred for x in pred(docs, {}).collect()} == {"und"}


def test_pipeline(spark, docs, texts, library, tmp_path):
    """Texts without letters go, one of each near-duplicate group stays, the mix sets how often, ids are the library's."""
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t) and i not in (1, 2)}
    mixed = by_id(budget_mix.mix(docs.where(F.col("doc_id").isin(list(kept)))))
    times = Counter(r.doc_id for r in got)
    assert times == Counter({i: mixed[i].taken // mixed[i].size for i in kept if mixed[i].taken})
    for r in got:
        ids = np.array(library.encode(kept[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
