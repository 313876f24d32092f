"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are identifiers, titles, notices, headers and whole short licence texts with their SPDX names. A text is cut into
blocks (lines up to a blank one, without comment marks). Of every block these units are
scored: each line, each sentence of the joined lines, each run of adjacent lines of up to WINDOW lines, and the whole block; and
the whole text. So wrapped headers, titles of two lines and whole licence files are compared as wholes, and a notice inside a longer line by its
sentence. A unit is a sparse vector of its words, 1 + ln of how often each occurs, weighted by inverse document frequency over the templates; words that no
template has weigh as much as the rarest template word, so running text around a mention lowers the
cosine. A unit is a notice of the template of highest cosine, of those with which it shares SHARED words, where that reaches ``least``; ties go to
the first template. Units that cannot reach any template, by the words they have, are not scored; texts without an anchor
word are not looked at (``anchors`` derives the words from the templates and the threshold).

A file's own licence is the template of the best unit (the earliest in the order above of equals). A file is a licence file
if its name is one (LICENSE, COPYING, NOTICE, ...) or if at least half of its words are in notices; it
speaks for its directory, the smallest path first if there are several. Files without a licence of
their own inherit that of the nearest ancestor directory that has a licence file. Ancestors are resolved
once per directory, not per file.

Null texts have no licence of their own; a null path neither gives nor inherits. Equal rows get equal
rows. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import by_chars, documents, stored

LEAST = 0.7
#: Distinct words that a notice shares with its template, at least.
SHARED = 2
#: Lines of a block that are scored together, besides the whole block.
WINDOW = 4
# SPDX names with the titles of their licences.
TITLES = (
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"), ("Zlib", "zlib License"), ("Unlicense", "The Unlicense"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"), ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"), ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"), ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
)
# Notices, headers and short licences, as their authors word them.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights: CC0 1.0."),
    ("LicenseRef-Proprietary", "All rights reserved."),
)
# Names and versions of the GNU licences, and the wording of their headers.
GNU = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"))
GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or any later version."
GNU_LONG = GNU_HEADER.replace("or any", "or (at your option) any") + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
GNU_SHORT = "This work is licensed under the {0}, version {1}."


def _templates() -> tuple[tuple[str, str], ...]:
    out = list(NOTICES)
    for spdx, name, version in GNU:
        out += [(f"{spdx}-or-later", GNU_HEADER.format(name, version)), (f"{spdx}-or-later", GNU_LONG.format(name, version)), (f"{spdx}-only", GNU_SHORT.format(name, version))]
    names = {n for n, _ in (*TITLES, *out)} - {"LicenseRef-Proprietary"}
    for n in sorted(names):
        out.append((n, f"SPDX-License-Identifier: {n}"))
        if n.startswith("CC-"):
            plain = n.replace("CC-", "CC ").replace("-4.0", " 4.0")
            out += [(n, f"Licensed under {plain}."), (n, plain)]
    for n, title in TITLES:
        out += [(n, title), (n, f"Licensed under the {title}.")]
    return tuple(dict.fromkeys(out))


TEMPLATES = _templates()
SENTENCE = re.compile(r"(?<=[.!?:])\s+")
#: Marks of comments at the ends of lines.
COMMENT = re.compile(r"^[\s/*#;%!<>-]*(?:(?:REM|rem|dnl)\s)?\s*|[\s*/>-]*$")
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words_of(line: str) -> list[str]:
    return WORD.findall(line.lower())


class Templates:
    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.names, self.least = [n for n, _ in templates], least
        bags = [Counter(words_of(t)) for _, t in templates]
        df = Counter(w for b in bags for w in b)
        self.idf = {w: 1 + math.log((1 + len(bags)) / (1 + n)) for w, n in df.items()}
        self.rare = 1 + math.log((1 + len(bags)) / 2)
        self.lists: dict[str, list[tuple[int, float]]] = {}
        weights = []
        for k, b in enumerate(bags):
            v = {w: (1 + math.log(n)) * self.idf[w] for w, n in b.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            weights.append({w: x / norm for w, x in v.items()})
            for w, x in weights[k].items():
                self.lists.setdefault(w, []).append((k, x))
        self.squares = {w: np.zeros(len(bags)) for w in self.lists}
        for w, own in self.lists.items():
            for k, x in own:
                self.squares[w][k] = x * x
        self.anchors = self._anchors(weights)
        every = "|".join(re.escape(w).replace("\\-", "-") for w in sorted(self.anchors, key=lambda w: (-len(w), w)))
        self.found = re.compile(rf"(?i)(?<![a-z0-9])(?:{every})(?![a-z0-9])")
        #: The same as a quick search of whole texts.
        self.hint = rf"(?i)(?:^|[^a-z0-9])(?:{every})(?:$|[^a-z0-9])"

    def _anchors(self, weights: list[dict[str, float]]) -> set[str]:
        """Words such that a line without any of them stays below the threshold for every template: by
        Cauchy-Schwarz the cosine is at most the norm of what is left of the template."""
        out: set[str] = set()
        for v in weights:
            left = {w: x for w, x in v.items() if w not in out}
            # short words come last: they are everywhere
            for w in sorted(left, key=lambda w: (w.isalpha() and len(w) < 5, -left[w], w)):
                if math.sqrt(sum(x * x for x in left.values())) < self.least:
                    break
                out.add(w)
                del left[w]
        return out

    def reaches(self, text: str) -> bool:
        """Whether any part of the text can reach a template: by Cauchy-Schwarz no cosine exceeds the norm of the template's words that the text has."""
        found = self.squares.keys() & set(words_of(text))
        if len(found) < SHARED:
            return False
        own = np.array([self.squares[w] for w in found])
        return bool(((own.sum(axis=0) >= self.least**2 - 1e-9) & ((own > 0).sum(axis=0) >= SHARED)).any())

    def best(self, line: str) -> tuple[int, float]:
        """The template nearest to a line, and the cosine."""
        norm, dot, shared = 0.0, Counter(), Counter()
        for w, n in Counter(words_of(line)).items():
            x = (1 + math.log(n)) * self.idf.get(w, self.rare)
            norm += x * x
            for k, y in self.lists.get(w, ()):
                dot[k] += x * y
                shared[k] += 1
        dot = {k: x for k, x in dot.items() if shared[k] >= SHARED}
        if not dot:
            return -1, 0.0
        k = min(dot, key=lambda k: (-dot[k], k))
        return k, dot[k] / math.sqrt(norm)

    def units(self, block: list[str]) -> Iterator[tuple[int, int, str]]:
        """First line, line after the last, and words of the units of a block's lines that can reach a template."""
        n, can = len(block), {}

        def reaches(unit: str) -> bool:
            if unit not in can:
                can[unit] = self.reaches(unit)
            return can[unit]

        for size in (1, 0, *range(2, WINDOW + 1), n):
            if size == 0:  # sentences
                at, joined, starts = 0, " ".join(block), []
                for line in block:
                    starts.append(at)
                    at += len(line) + 1
                at = 0
                for sentence in SENTENCE.split(joined):
                    at = joined.index(sentence, at)
                    if reaches(sentence):
                        yield bisect_right(starts, at) - 1, bisect_right(starts, at + max(0, len(sentence) - 1)), sentence
                    at += len(sentence)
            elif size <= WINDOW or size == n:
                for k in range(n - size + 1):
                    if reaches(unit := " ".join(block[k : k + size])):
                        yield k, k + size, unit

    def scan(self, text: str) -> tuple[str | None, float, int, int]:
        """The licence of the best notice and its cosine, the number of notices (runs of lines in notices) and of their words."""
        name, score, notices, words = None, 0.0, 0, 0
        seen = -1
        if not self.reaches(text):
            return name, score, notices, words
        for m in self.found.finditer(text):
            if m.start() < seen:
                continue
            a, seen = self._block(text, m.start())
            if not self.reaches(text[a:seen]):
                continue
            block = [COMMENT.sub("", x) for x in text[a:seen].split("\n")]
            covered = [False] * len(block)
            for first, stop, unit in self.units(block):
                k, cosine = self.best(unit)
                if cosine >= self.least:
                    covered[first:stop] = [True] * (stop - first)
                    if cosine > score:
                        name, score = self.names[k], cosine
            notices += sum(c and not b for b, c in zip([False, *covered], covered, strict=False))
            words += sum(len(x.split()) for x, c in zip(block, covered, strict=True) if c)
        if seen >= 0:
            k, cosine = self.best(text)
            if cosine >= self.least:
                notices, words = max(notices, 1), len(text.split())
                if cosine > score:
                    name, score = self.names[k], cosine
        return name, score, notices, words

    @staticmethod
    def _block(text: str, at: int) -> tuple[int, int]:
        """Start and end of the lines around a place, up to blank lines."""
        a = z = at
        while True:
            a = text.rfind("\n", 0, a) + 1
            if not a or not COMMENT.sub("", text[text.rfind("\n", 0, a - 1) + 1 : a - 1]):
                break
            a -= 1
        while True:
            z = text.find("\n", z)
            if z < 0:
                return a, len(text)
            end = text.find("\n", z + 1)
            if not COMMENT.sub("", text[z + 1 : end if end >= 0 else len(text)]):
                return a, z
            z += 1


def own_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files: key, path, text. Gives key, path, own, cosine, n_notices, is_license_file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(least=least)
        for b in by_chars(batches, 2):
            out = [(None, 0.0, 0, False)] * b.num_rows
            hints = pc.fill_null(pc.match_substring_regex(b.column(2), templates.hint), False)
            for k in np.flatnonzero(hints.to_numpy(zero_copy_only=False)).tolist():
                t = b.column(2)[k].as_py()
                name, score, n, words = templates.scan(t)
                out[k] = name, score, n, n > 0 and 2 * words >= len(t.split())
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.bool_()), strict=True))],
                names=["key", "path", "own", "cosine", "n_notices", "mostly"],
            )

    rows = files.mapInArrow(run, "key long, path string, own string, cosine double, n_notices long, mostly boolean")
    return rows.withColumn("is_license_file", F.col("own").isNotNull() & (F.col("mostly") | F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES), F.lit(False)))).drop("mostly")


def folder_of(path: Column) -> Column:
    """The directory of a path, the empty string at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(rows: DataFrame) -> DataFrame:
    """rows as own_licenses gives them, with ``license`` and ``via`` (own, inherited or none) and the directory it comes from."""
    rows = rows.withColumn("dir", folder_of(F.col("path")))
    speaks = rows.where("is_license_file AND path IS NOT NULL").groupBy("dir").agg(F.min(F.struct("path", "own")).getField("own").alias("dir_license"))
    dirs = rows.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("level")).select("dir", "level", F.array_join(F.slice(parts, 1, F.col("level")), "/").alias("ancestor"))
    near = above.join(speaks.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct("level", "ancestor", "dir_license")).alias("near"))
    near = near.select(F.col("dir").alias("d"), "near.ancestor", "near.dir_license")
    out = rows.join(near, F.col("dir") == F.col("d"), "left")
    via = F.when(F.col("own").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "key", "path", "own", "cosine", "n_notices", "is_license_file", F.coalesce("own", "dir_license").alias("license"), via.alias("via"),
        F.when(via == "inherited", F.col("ancestor")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents table as a tree of files: source / thousands / tens / id. Ids that end in 0, 00 and 000 are the file LICENSE of
    their ten, hundreds of their thousand, and thousands of their source."""
    i = F.col("doc_id").cast("long")
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    thousand, ten = F.floor(i / 1000).cast("string"), F.floor(i % 1000 / 10).cast("string")
    name = F.when(i % 10 == 0, F.lit("LICENSE")).otherwise(i.cast("string"))
    path = F.concat_ws("/", source, F.when(i % 1000 != 0, thousand), F.when(i % 100 != 0, ten), name)
    return docs.select(i.alias("key"), F.when(i.isNotNull(), path).alias("path"), F.col("text").cast("string").alias("text"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(own_licenses(document_paths(documents(spark, sf_dir))), "licenses")
    return inherit(rows).withColumnRenamed("key", "doc_id")
