"""License and secret scans and fingerprints against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarrystone.llm import license_scan, secret_grammar, weighted_sampling

GPL = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.

int main() { return 0; }"""
MIT = dict(reversed([(n, t) for n, t in license_scan.NOTICES if n == "MIT"]))["MIT"]


def cosine(unit, template, idf, rare):
    a, b = (Counter(re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", x.lower())) for x in (unit, template))
    if len(a.keys() & b.keys()) < 2:
        return 0.0
    x, y = ({w: (1 + math.log(n)) * idf.get(w, rare) for w, n in c.items()} for c in (a, b))
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(v * y.get(w, 0) for w, v in x.items()) / norm if norm else 0.0


def brute_license(text, least=license_scan.LEAST):
    bags = [set(license_scan.words_of(t)) for _, t in license_scan.TEMPLATES]
    df = Counter(w for b in bags for w in b)
    idf = {w: 1 + math.log((1 + len(bags)) / (1 + n)) for w, n in df.items()}
    units, block = [text], []
    for line in [*text.split("\n"), ""]:
        line = license_scan.COMMENT.sub("", line)
        if line:
            block.append(line)
            continue
        units += license_scan.SENTENCE.split(" ".join(block))
        units += [" ".join(block[k:z]) for k in range(len(block)) for z in range(k + 1, len(block) + 1) if z - k <= license_scan.WINDOW or z - k == len(block)]
        block = []
    best = max(((cosine(u, t, idf, 1 + math.log((1 + len(bags)) / 2)), n) for u in units for n, t in license_scan.TEMPLATES), default=(0, None))
    return (best[0], {n for u in units for n, t in license_scan.TEMPLATES if cosine(u, t, idf, 1 + math.log((1 + len(bags)) / 2)) > best[0] - 1e-9}) if best[0] >= least else (0.0, {None})


@pytest.mark.parametrize("seed", range(6))
def test_licenses_against_brute_force(seed):
    r, scanner = random.Random(seed), license_scan.Templates()
    words = sorted(scanner.idf) + ["house", "tree", "river", "walk"] * 20
    parts = [t for _, t in license_scan.TEMPLATES]
    for _ in range(4):
        lines = []
        for _ in range(r.randrange(1, 6)):
            t = r.choice([r.choice(parts), " ".join(r.choices(words, k=r.randrange(1, 9))), "", r.choice(parts) + " " + " ".join(r.choices(words, k=4))]).split(" ")
            for w in r.sample(range(len(t)), min(len(t), r.randrange(3))):
                t[w] = r.choice(words)
            at = r.randrange(1, len(t) + 1)
            lines += [r.choice(["", "# ", " * ", "// "]) + " ".join(t[:at]), " ".join(t[at:])]
        text = "\n".join(lines)
        name, score, notices, _ = scanner.scan(text)
        want, names = brute_license(text)
        assert abs(score - want) < 1e-9 and name in names and (notices > 0) == (name is not None)
        assert name is None or re.search(scanner.hint, text)


def test_license_headers_and_files():
    scan = license_scan.Templates().scan
    cases = {
        GPL: "GPL-3.0-or-later", "# SPDX-License-Identifier: Apache-2.0\nx = 1": "Apache-2.0", "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "All rights reserved.": "LicenseRef-Proprietary",
        "   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007": "GPL-3.0-only", "Notes. Licensed under the Apache License, Version 2.0. Other prose goes on for long after it.": "Apache-2.0",
        "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + MIT: "MIT", "the general public was there, and any version of it is free": None, "": None, "Mit.\nmit der Zeit": None, "a " * 30_000 + "license": None,
    }
    for text, name in cases.items():
        assert scan(text)[0] == name, text[:60]


def test_inheritance(spark):
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.py", "x = 1"), (3, "a/b/d.py", "# Released under the MIT License.\n" + "x = y + z\n" * 9), (4, "z/e.py", None), (5, None, "y"),
        (6, "a/b/c/COPYING", GPL.split("\n\n")[0]), (7, "a/b/c/d/e/f.py", "y"), (8, "a/b/c/LICENSE", "nothing here"), (9, "LICENSE", "CC BY 4.0"), (10, "z/q", "w"), (11, "a/b/c.py", "x = 1"), (None, "ab/c", "q"), (12, "a/b/d.py/x", ""),
    ]
    df = spark.createDataFrame(files, "key long, path string, text string")
    got = {(r.key, r.path): (r.license, r.via, r.from_dir) for r in license_scan.inherit(license_scan.own_licenses(df)).collect()}
    for key, path, text in files:
        own = license_scan.Templates().scan(text or "")[0]
        want = (own, "own" if own else "none", None)
        if own is None and path is not None:
            up = path.split("/")[:-1]
            for k in range(len(up), -1, -1):
                there = sorted((p, license_scan.Templates().scan(t or "")[0]) for _, p, t in files if p and p.split("/")[:-1] == up[:k] and (re.match(license_scan.FILE_NAMES, p.split("/")[-1]) or t in ("Licensed under the Apache License, Version 2.0.",)))
                there = [x for x in there if x[1]]
                if there:
                    want = (there[0][1], "inherited", "/".join(up[:k]))
                    break
        assert got[key, path] == want


def test_tree_of_the_query_inherits(spark):
    rows = [(i, "Licensed under the Apache License, Version 2.0." if i == 20 else "plain words", "s", "x") for i in range(40)] + [(None, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    got = {r.key: r.via for r in license_scan.inherit(license_scan.own_licenses(license_scan.document_paths(docs))).collect()}
    assert [i for i, v in got.items() if v == "inherited"] == list(range(21, 30)) and got[20] == "own" and got[None] == "none"


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_against_brute_force(spark):
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    bits = ["token = ", "PassWord:", "api_key='", 'secret":"', "passwd=abc", "AKIA", "x", " ", "é", "\n", "=", "mail7.example.com", "10.20.30.40", "ſecret: abcdefg"]
    rows = [(i, "".join(r.choice([*bits, r.choice(hexes)[: r.randrange(4, 40)], r.choice(hexes)[:16].upper(), r.choice("abc ") * r.randrange(1, 9)]) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    rows += [(i, f'say token = "{h}" now') for i, h in zip(range(200, 260), hexes, strict=True)]
    rows += [(300, "key " + hexes[0][:22] + " and plain words mail7.example.com"), (301, None), (302, ""), (None, hexes[1]), (None, hexes[1]), (303, "a" * 300_000 + "=" * 300_000 + " 1")]
    docs = spark.createDataFrame([(i, t, "s", "g") for i, t in rows], "doc_id long, text string, spans string, kind string").repartition(3)
    values = secret_grammar.labelled_values(docs)
    scanner = secret_grammar.Scanner(values)
    got = {(x.doc_id, x.base_sha256, x.spans): x for x in secret_grammar.scan(docs, scanner).collect()}
    names = ("assign", "access", "hex", "gram")
    for i, t in rows:
        base = brute_base(t or "")
        bare = list(t or "")
        for s, _, e in base:
            bare[s:e] = " " * (e - s)
        added = [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_.=-]+", "".join(bare)) if len(m[0]) >= 6 and scanner.score(m[0]) >= secret_grammar.LIKELY]
        digest = hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        x = got[i, digest, ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(base + added))]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
    assert got[300, hashlib.sha256(b"").hexdigest(), "gram:4:26"]
    assert secret_grammar.op5_secrets(spark, docs.limit(0)).count() == 0


def test_secret_scores_of_many_equal_those_of_one():
    r = random.Random(4)
    values = {"hex": ["".join(r.choices("0123456789abcdef", k=32)) for _ in range(80)], "none": ["".join(r.choices("etaoinshr", k=r.randrange(6, 12))) for _ in range(300)]}
    scanner = secret_grammar.Scanner(values)
    test = ["".join(r.choices("0123456789abcdefXYZ+/_.=-", k=r.randrange(6, 90))) for _ in range(200)]
    assert np.allclose(scanner.scores(pa.array(test)), [scanner.score(v) for v in test])
    assert secret_grammar.Scanner({}).scores(pa.array(test)).max() == -np.inf


def test_fingerprints_estimate_the_generalised_jaccard_similarity(spark):
    """The mean error is near zero, also of texts with few words; single ones stay within five standard deviations."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = [(i, " ".join(r.choices(vocabulary[: r.choice([30, 400])], k=r.choice([20, 60, 400])))) for i in range(300)]
    texts = dict(rows)
    docs = spark.createDataFrame([(*x, "f") for x in rows] + [(1, texts[1], "f")], "doc_id long, text string, fingerprint string")
    got = weighted_sampling.fingerprints(docs).collect()
    assert len(got) == 301 and len({(x.doc_id, x.fingerprint) for x in got}) == 300
    bag = lambda t: Counter(t.split())
    likeness = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values()))
    off = []
    for x in got:
        t, after = texts[x.doc_id], texts[(x.doc_id - 1) % 300]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and len(x.fingerprint) == 8 * weighted_sampling.BINS * weighted_sampling.DRAWS
        off.append((len(t), x.near_edited - likeness(bag(t), bag(edited)), x.near_next - likeness(bag(t), bag(after))))
    for k in (1, 2):
        assert abs(np.mean([x[k] for x in off])) < 0.015 and max(abs(x[k]) for x in off) < 0.33
        assert abs(np.mean([x[k] for x in off if x[0] < 200])) < 0.03
