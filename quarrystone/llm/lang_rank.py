"""Language ID by rank-order n-gram profiles and the out-of-place distance (Cavnar and Trenkle, 1994).

Texts are lower-cased; runs of anything but letters become one space, which also stands at both ends.
A document's profile is its most frequent n-grams of 1 to 3 characters, a language's profile those of
all its training documents. The distance sums, over the document's profile, how far each n-gram is
from its place in the language's, an n-gram it lacks costing the whole profile length.

Ties in frequency are broken by the n-gram's code. Null texts and texts without a letter get ``und``
with score 0; where nothing was learned every text gets it. A null doc_id counts as the empty string
in the fold and is held out. Only n-grams that profiles are chosen from (16 x PROFILE rows a language) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import by_chars, documents

PROFILE = 400
NONE = "und"
SHIFT = np.uint64(21)

_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _is_letter


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as codes (21 bits a character), and their counts."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.where(letter, code, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    code = code[keep].astype(np.uint64)
    pad = np.zeros(1, np.uint64)
    code = np.concatenate([pad, code, pad] if code[0] and code[-1] else [pad[: int(code[0] > 0)], code, pad[: int(code[-1] > 0)]])
    two = code[:-1] << SHIFT | code[1:]
    three = two[:-1] << SHIFT | code[2:]
    # letters have code points below 2**20, so triples leave the two top bits clear; these tell pairs and single letters
    pair = np.uint64(1) << np.uint64(63)
    lone = np.uint64(3) << np.uint64(62)
    every = np.sort(np.concatenate([code[code > 0] | lone, two | pair, three]))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(np.append(first, len(every)))


def top(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, the most frequent first, equal ones by code."""
    if len(counts) > size:
        least = np.partition(counts, -size)[-size]
        sure = counts >= least
        codes, counts = codes[sure], counts[sure]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.size = PROFILE
        known = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.known, self.rank = known, np.full((len(self.names), len(known) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.rank[k, np.searchsorted(known, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.names:
            return NONE, 0.0
        mine = top(codes, counts)
        at = np.searchsorted(self.known, mine)
        at[self.known[np.minimum(at, len(self.known) - 1)] != mine] = len(self.known)
        ranks = self.rank[:, at]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(out.argmin())
        return self.names[best], float(1 - out[best] / (self.size * len(mine)))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % 5 == 0


def learn(train: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """train: lang, text. Counts n-grams over all rows; only the profiles come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_chars(batches):
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = train.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each of 16 parts of a language's n-grams hold its best: 16 x size rows a language reach the driver
    order = Window.partitionBy("lang", F.pmod("gram", F.lit(16))).orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    best = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    out: dict[str, list[int]] = {}
    for _, lang, gram in sorted((-r.n, r.lang, r.gram & (1 << 64) - 1) for r in best.collect()):
        if len(mine := out.setdefault(lang, [])) < size:
            mine.append(gram)
    return out


def language(profiles: dict[str, list[int]]):
    """A function of a text column that gives lang_pred and score; other columns never leave the JVM."""

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Profiles(profiles)
        for part in texts:
            names, scores = [], []
            for at in range(0, len(part), 512):
                for t in part.slice(at, 512).to_pylist():
                    name, score = model.predict(t)
                    names.append(name), scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run


def learn_folds(docs: DataFrame) -> dict[str, list[int]]:
    return learn(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = language(learn_folds(docs))(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), got.alias("x")).select("doc_id", "held_out", "x.*")
