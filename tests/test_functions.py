import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import retrieval as Q


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tokens_of_cjk_runs(spark):
    assert one(spark, T.lexical_tokens(F.lit("Abc-1 对象A和对象"))) == ["abc-1", "a", "对象", "对象", "和对象", "和对", "对象"]
    assert one(spark, T.lexical_tokens(F.lit("中"))) == ["中"]


def test_boxes(spark):
    box = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, T.iou(box(0.0, 0.0, 1.0, 1.0), box(0.5, 0.0, 1.5, 1.0))) == pytest.approx(1 / 3)
    assert one(spark, T.page_sized(box(0.0137, 0.0, 0.9859, 1.001)))
    assert not one(spark, T.page_sized(box(0.2, 0.2, 0.7, 0.7)))


def test_exact_match_beats_vector(spark):
    vector = spark.createDataFrame([(1, 10, 0.6, 1), (1, 11, 0.3, 2)], "query_id long, id long, raw double, vector_rank int")
    keyword = spark.createDataFrame([(1, 12, 5.0, 1, True)], "query_id long, id long, score double, keyword_rank int, exact boolean")
    assert [r.id for r in Q.fuse(vector, keyword, 5).orderBy("rank").collect()] == [12, 10]
    assert {r.id for r in Q.fuse(vector, keyword, 5).collect()} == {10, 12}


def test_metrics(spark):
    expected = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "query_id long, id long")
    hits = spark.createDataFrame([(1, 1, 2), (1, 2, 8)], "query_id long, id long, rank int")
    r = Q.metrics(expected, hits).first()
    assert (r.recall_5, r.recall_10, r.all_10, r.mrr) == (0.333333, 0.666667, 0.5, 0.25)


def test_exact_phrase_with_cjk_runs_at_its_ends(spark):
    """A CJK run at an end of the phrase may go on in the record; so may a Latin token."""
    from quarrystone.operators import retrieval

    texts = ["用 gpt 模型训练 吧", "gpt 模型", "大模型训练和 gpt 数据集合", "xgpt-a 模型训 b.c"]
    phrases = ["gpt 模型训", "模型训练和 gpt 数据集", "a 模型训 b", "模型 gpt 数据", "gpt 模型"]
    records = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries = spark.createDataFrame(list(enumerate(phrases)), "query_id long, text string")
    got = {(r.query_id, r.id) for r in retrieval.exact_phrases(records, queries).collect()}
    assert got == {(q, i) for q, p in enumerate(phrases) for i, t in enumerate(texts) if p in t}
