"""Brute-force versions and small cases of structure, tables and evidence."""

import random
import re

from pyspark.sql import functions as F

from quarrystone.operators import evidence, structure, tables


def pieces(text, most, lap):
    if len(text) <= most:
        return [text]
    out, open_ = [], ""
    for s in filter(None, re.split(r"(?<=[。！？!?；;.])\s*|\n+", text)):
        if open_ and len(open_) + 1 + len(s) > most:
            out.append(open_)
            open_ = ""
        if len(s) > most:
            out += [s[k : k + most] for k in range(0, len(s), most - lap)]
        else:
            open_ = f"{open_}\n{s}" if open_ else s
    return out + [open_] * bool(open_)


def test_split_long(spark):
    rng = random.Random(3)
    texts = ["", "short", "x" * 95, "a. b", *("".join(rng.choice(["word ", ". ", "\n\n", "！", "x" * 33, "? "]) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", structure.split_long(F.col("t"), 40, 8).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert got.pop(len(texts)) is None
    assert got == {i: pieces(t, 40, 8) for i, t in enumerate(texts)}


def test_title_paths(spark):
    rng, rows, want = random.Random(5), [], {}
    for d in range(30):
        path = []
        for n in range(rng.randint(1, 25)):
            level = rng.choice([None, 1, 2, 3, 4])
            rows.append((d, n, level, f"t{n}"))
            if level:
                path = [*path[: level - 1], f"t{n}"]
            want[d, n] = path
    got = structure.title_paths(spark.createDataFrame(rows, "id int, ordinal int, level int, title string"))
    assert {(r.id, r.ordinal): r.path for r in got.collect()} == want


def test_markdown(spark):
    cases = ["|a|b|\n|-|-|\n|1|2|", "||a | b||\n\n|:---|---:|\nnote\n| 1 | x\\|y | z |\r\n|2|", "one | line", "", None, "a|b\n---|---"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", tables.markdown_table(F.col("t")).alias("t")).orderBy("i").collect()]
    assert [g and (g.headers, g.rows) for g in got] == [
        (["a", "b"], [["-", "-"], ["1", "2"]]), (["a", "b", "column_3"], [["1", "x|y", "z"], ["2", "", ""]]), None, None, None, (["a", "b"], []),
    ]


def test_query_variants(spark):
    cases = ["", "  plain words? ", "甲和乙分别是什么？", "甲、乙共同；用途；", "讲甲；讲乙", "同时", None]
    got = [r.v for r in spark.createDataFrame(list(enumerate(cases)), "i int, q string").select("i", evidence.query_variants(F.col("q")).alias("v")).orderBy("i").collect()]
    assert got == [[], ["plain words?"], ["甲和乙分别是什么？", "甲是什么", "乙是什么"], ["甲、乙共同；用途；", "甲用途", "乙用途", "甲、乙共同", "用途"], ["讲甲；讲乙", "讲甲", "讲乙"], ["同时"], None]


def test_claim_problems(spark):
    known = spark.createDataFrame([(1, "E001", "The Tower is 300 metres high", None, "direct"), (1, "E002", "x", "Some context", "context")], "answer_id int, evidence_id string, content string, context string, support string")
    claims = spark.createDataFrame(
        [(1, 1, ["E001"], {"E001": "the  tower is"}), (1, 2, ["E002", "E009"], {"E002": "some context", "E001": "300 metres"}), (1, 3, ["E001"], {"E001": "300"}), (1, 4, ["E001", "E002"], {"E001": "400 metres"}), (1, 5, None, None)],
        "answer_id int, claim int, evidence_ids array<string>, quotes map<string,string>",
    )
    got = sorted((r.claim, r.problem, r.evidence_id or "") for r in evidence.claim_problems(claims, known).collect())
    assert got == [
        (2, "no direct support", ""), (2, "no quote", "E009"), (2, "quote of other evidence", "E001"), (2, "unknown evidence", "E009"), (3, "quote too short", "E001"),
        (4, "no quote", "E002"), (4, "quote not in the evidence", "E001"), (5, "no direct support", ""),
    ]
    assert evidence.claim_problems(claims.limit(0), known).count() == 0
