"""Every query of the training-data operators, and the pipeline, on tables with nulls, repeated rows, ties, long texts and clashing columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quarrystone.llm.queries import queries

NAMES = "text string, doc_id long, lang string, source string, n_chars long, id long, key long, rank int, row string, component string, _id string, _h long, _lines string, _gone long, _dropped long, t string, h long, lines string, value double, bucket int, size long, repeats long, i long, s string, n int, seen string"
CLASH = (1, 2, 3, "r", "c", "x", 4, "l", 5, 6, "t", 7, "ll", 0.5, 8, 9, 10, 11, "s", 12, "z")
PER_ROW = {"op1_token_ids", "op2_license_scan", "op3_exact_dedup", "op4_line_dedup", "op5_secrets", "op6_bpe", "op7_fingerprints", "op8_near_dedup", "op9_budget_mix", "op10_language_id"}


def rows():
    r = random.Random(1)
    words = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randrange(1, 9))) for _ in range(n))
    base = words(80)
    out = [(base, 1), (base, 2), (base + " x", 3), (base, 1), (None, 4), ("", 5), (None, None), (None, None), (base, None), (words(60), None), (" \n\t", 6), ("!!! 123 ..", 7), (words(40_000), 8), ("x" * 200_000, 9), ("é" * 50_000 + " token=abcdef123456", 10)]
    out += [(words(r.randrange(1, 90)) + "\nthe same footer in all of these documents", 20 + k) for k in range(30)]
    return [(t, i, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 2}", None, *CLASH) for k, (t, i) in enumerate(out)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for name, data in (("odd", rows()), ("empty", []), ("null", [(None, None, None, None, None, *CLASH)])):
        made[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(data, NAMES).repartition(3).write.parquet(f"{made[name]}/documents.parquet")
    return made


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_a_document(spark, folders, name):
    assert PER_ROW == {n for n in queries()}
    query = queries()[name]
    got = query(spark, folders["odd"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[1] for x in rows())
    # equal rows have equal results, but for places in an order and the one copy that stays
    free = {"path", "source_size", "target", "start", "kept", "taken", "near_next", "edited_sha256", "edited_fingerprint", "near_edited"}
    same = [tuple(v for k, v in r.asDict().items() if k not in free) for r in got if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1]
    again = query(spark, folders["odd"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert query(spark, folders["empty"]).collect() == []
    assert len(query(spark, folders["null"]).collect()) == 1


def test_pipeline(spark, folders):
    got = corpus_pipeline.run(spark, folders["odd"]).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {x[1] for x in rows() if x[0] and any(c.isalpha() for c in x[0])} and not {2, 3} & ids
    assert corpus_pipeline.run(spark, folders["empty"]).collect() == [] and corpus_pipeline.run(spark, folders["null"]).collect() == []


def test_stages_keep_columns_and_rows(spark, folders):
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folders["odd"])
        assert out.columns == docs.columns, name
        assert out.where("value <> 0.5 OR bucket <> 8").count() == 0, name
    assert corpus_pipeline.line_stage(spark, docs, folders["odd"]).count() == docs.count()
    texts = [r.text for r in corpus_pipeline.line_stage(spark, docs, folders["odd"]).collect()]
    assert not any(t and "same footer" in t for t in texts)
