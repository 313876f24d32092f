"""Packing of texts and tables and the coverage order against brute-force versions, and the cases of the survey."""

import re

import pytest

from quarrystone.operators import chunking as H
from quarrystone.operators import selection as S

TEXT = "document_id long, block_id string, reading_order int, text string, level int, label string, sheet string, slide int, page int"


def records(spark, blocks, sizes):
    got = H.text_records(spark.createDataFrame(blocks, TEXT), sizes).collect()
    return sorted(got, key=lambda r: (r.document_id, r.ordinal))


def test_pages_and_overlap(spark):
    blocks = [(1, f"b{k}", k, "甲乙丙丁" * 6, None, None, None, None, 1 + k // 2) for k in range(4)]
    got = records(spark, blocks, H.Sizes(32, 48, 8))
    assert [r.block_ids for r in got] == [["b0"], ["b1"], ["b2"], ["b3"]]
    assert [r.overlap for r in got] == ["", "甲乙丙丁" * 2, "", "甲乙丙丁" * 2]
    assert [r.next_record_id for r in got[:-1]] == [r.record_id for r in got[1:]] and got[0].previous_record_id is None
    assert max(len(r.embedding_text) for r in got) <= 48
    assert len(records(spark, [(1, "a", 0, "字" * 100, None, None, None, None, 1)], H.Sizes(24, 32, 8))) == 5


def test_titles_blank_blocks_and_empty_tables(spark):
    blocks = [
        (1, "t", 0, "1. First", None, None, None, None, 1), (1, "a", 1, " some\n words ", None, None, None, None, 1), (1, "n", 2, None, None, None, None, None, 1), (1, "u", 3, "Second", 1, None, None, None, 1),
        (1, "c", 4, "more", None, None, None, None, 1), (2, "z", 0, "   ", None, None, None, None, None),
    ]
    got = records(spark, blocks, H.Sizes())
    assert [(r.titles, r.body) for r in got] == [(["1. First"], "1. First\nsome words"), (["Second"], "Second\nmore")]
    assert got[0].embedding_text == "1. First\nsome words"
    assert H.text_records(spark.createDataFrame([], TEXT)).count() == 0


def split(value, most, overlap):
    if len(value) <= most:
        return [value]
    out, now = [], ""
    for s in (x for x in re.split(r"(?<=[。！？!?；;\.])\s*|\n+", value) if x):
        both = s if not now else now + "\n" + s
        if len(both) <= most:
            now = both
            continue
        out += [now] if now else []
        now = s if len(s) <= most else ""
        if len(s) > most:
            out += [s[k : k + most] for k in range(0, len(s), most - overlap)]
    return out + ([now] if now else [])


@pytest.mark.parametrize("sizes", [H.Sizes(), H.Sizes(40, 60, 10), H.Sizes(60, 60, 0)])
def test_text_records_against_brute_force(spark, sizes):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    blocks = [(r.doc_id, f"{r.doc_id}:{k}", k, t, 1 + k % 3 if k % 5 == 0 else None, None, None, None, k // 4) for r in docs for k, t in enumerate((r.text or "").split("\n"))]
    want = {}
    for doc in {b[0] for b in blocks}:
        path, units, out = [], [], []
        for _, block, _, text, level, _, _, _, page in (b for b in blocks if b[0] == doc):
            text = re.sub(r"\s+", " ", text or "").strip()
            if not text:
                continue
            if (level is not None and level <= 2 and len(text) <= 160) or (len(text) <= 120 and re.match(r"^(?:第[一二三四五六七八九十百]+[章节]|\d+(?:\.\d+)*[.、]\s*)", text)):
                path = path[: (level or 2) - 1] + [text]
            units += [(p, block, page, list(path)) for p in split(text, sizes.most, sizes.overlap)]
        now, over = [], ""
        for k, u in enumerate(units):
            if now and (u[2:] != now[-1][2:]):
                out.append((over, "\n".join(x[0] for x in now)))
                now, over = [], ""
            elif k and u[2:] != units[k - 1][2:]:
                over = ""
            if now and len("\n".join([*u[3], over, *(x[0] for x in now), u[0]]).strip()) > sizes.target:
                out.append((over, "\n".join(x[0] for x in now)))
                now, over = [], out[-1][1][-sizes.overlap :] if sizes.overlap else ""
            now.append(u)
            if len("\n".join([*u[3], over, *(x[0] for x in now)]).strip()) >= sizes.most:
                out.append((over, "\n".join(x[0] for x in now)))
                now, over = [], out[-1][1][-sizes.overlap :] if sizes.overlap else ""
        want[doc] = out + ([(over, "\n".join(x[0] for x in now))] if now else [])
    got = {}
    for r in records(spark, blocks, sizes):
        got.setdefault(r.document_id, []).append((r.overlap, r.body))
        assert len(r.embedding_text) <= sizes.most
    assert got == {d: o for d, o in want.items() if o}


TABLE = "document_id long, block_id string, reading_order long, matrix array<array<string>>, raw string, native boolean, title string, place string"


def test_table_bands(spark):
    wide = [[f"c{k}" for k in range(14)], *[[f"v{r}.{k}" for k in range(14)] for r in range(25)]]
    rows = [(1, "w", 0, wide, None, None, "", ""), (2, "r", 0, None, "no table  here", None, "T", "p1"), (3, "k", 0, [["a", "1"], ["b", "2"]], None, True, None, None), (4, "l", 0, [["h", "g"], ["x" * 600, "y"]], None, None, "", ""), (5, "e", 0, [[" "]], "e", None, None, None)]
    got = sorted(H.table_records(spark.createDataFrame(rows, TABLE), H.Sizes(most=2000)).collect(), key=lambda r: (r.document_id, r.ordinal))
    own = [r for r in got if r.document_id == 1]
    assert [(r.columns[0], len(r.columns), r.row_start, r.row_end) for r in own] == [(0, 12, 0, 19), (0, 12, 20, 24), (0, 3, 0, 19), (0, 3, 20, 24)]
    assert [r.embedding_text for r in got if r.document_id == 2] == ["Table: T\nColumns: raw_content\nRow: no table here\nSource: p1"]
    assert [(r.headers, r.rows) for r in got if r.document_id == 3] == [(["Field", "Value"], [["a", "1"], ["b", "2"]])]
    short = H.table_records(spark.createDataFrame(rows, TABLE)).collect()
    assert all(len(r.embedding_text) <= 384 for r in short)
    long = sorted((r for r in short if r.document_id == 4), key=lambda r: r.segment)
    head, room = "Columns: h | g\n", 384 - 15
    text = long[0].embedding_text[len(head) :] + "".join(r.embedding_text[len(head) + 48 :] for r in long[1:])
    assert text == "Row: " + "x" * 600 + " | y" and all(r.embedding_text.startswith(head) and len(r.embedding_text) <= 15 + room for r in long)
    assert H.table_records(spark.createDataFrame([], TABLE)).count() == 0


def test_table_bands_against_brute_force(spark):
    import random

    r = random.Random(7)
    for _ in range(60):
        n = r.randrange(1, 20)
        headers, rows = [f"h{k}" for k in range(n)], [["x" * r.randrange(1, 40) for _ in range(n)] for _ in range(r.randrange(0, 30))]
        sizes = H.Sizes(most=r.choice([60, 200, 400]), rows=r.choice([3, 20]), columns=r.choice([4, 12]))
        text = lambda cols, own: "\n".join(["Columns: " + " | ".join(headers[c] for c in cols), *("Row: " + " | ".join(x[c] for c in cols) for x in own)])
        todo, want = [list(range(n))] if n <= sizes.columns else [[0, *range(k, min(k + sizes.columns - 1, n))] for k in range(1, n, sizes.columns - 1)], []
        while todo:
            cols = todo.pop(0)
            if len(cols) > 2 and any(len(text(cols, [x])) > sizes.most for x in rows):
                rest = cols[1:]
                half = max(len(rest) // 2, 1)
                todo = [[cols[0], *rest[:half]], [cols[0], *rest[half:]], *todo]
                continue
            now, start = [], 0
            for k, x in enumerate(rows):
                if now and (len(now) >= sizes.rows or len(text(cols, [*now, x])) > sizes.most):
                    want.append((cols, start, len(now)))
                    now, start = [], k
                now.append(x)
            want.append((cols, start, len(now)))
        assert [(c, s, len(o)) for c, s, o in H.bands("", headers, rows, "", sizes)] == want


def test_coverage_order_against_brute_force(spark):
    import random

    r, rows = random.Random(8), []
    words = ["alpha", "beta-2", "x1", "of", "longword", "q", "gamma", "delta9"]
    for q in range(12):
        rows += [(q, f"E{k:03d}", f"d{r.randrange(3)}", r.choice(["text", "table"]), k, sorted(r.sample(words, r.randrange(0, 6)))) for k in range(r.randrange(1, 12))]
    got = S.coverage_order(spark.createDataFrame(rows, "query_id int, evidence_id string, document_id string, modality string, rank int, matched array<string>")).collect()
    weight = lambda t: 3.0 if re.search(r"\d|-", t) else 1.5 if len(t) >= 5 else 1.0
    for q in range(12):
        left, covered, docs, want = [x for x in rows if x[0] == q], set(), set(), []
        while left:
            best = max(left, key=lambda x: (round(2 * sum(weight(t) for t in x[5] if t not in covered) + sum(map(weight, x[5])) + 0.75 * (x[2] not in docs) + 0.35 * (x[3] == "table"), 6), -x[4]))
            left.remove(best)
            covered |= set(best[5])
            docs.add(best[2])
            want.append(best[1])
        assert [x.evidence_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.place)] == want
