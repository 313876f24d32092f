"""Secret scans: fixed patterns, and automata inferred from labelled credentials.

The patterns label credentials by kind. For every kind a prefix tree of labelled values is generalised
by merging states whose counts are statistically compatible (ALERGIA: Hoeffding bounds on every
symbol's and the end's frequency), which gives a probabilistic automaton of the format. Symbols are
character classes; within a class a character counts as uniform. Candidates are all runs of credential characters outside
the base spans (what a base span leaves of a run is one), from SHORTEST characters on. Each is scored by every automaton against
a bigram model of ordinary candidates, and becomes a span ``gram`` where the mean log likelihood ratio per character of
the best automaton reaches the threshold.

A batch's distinct candidates are found in Arrow and scored together, character by character in numpy, so that time is
linear in the text; runs of any length are scored. Texts without base spans and likely candidates are not looked at again.

Training values are a bounded sample: the TRAIN_VALUES of each kind, and the PLAIN_VALUES ordinary candidates, that have the smallest hashes of all
in the corpus, cut to TRAIN_CHARS characters. Everything else reads all rows and whole texts. Null texts count as empty;
a null doc_id is kept; equal rows give equal rows; without labelled values no span is added. Offsets are code points.
Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import by_chars, id_text, stored

KINDS = ("assign", "access", "hex")
#: Fixed patterns. Letters of the keywords match in either case.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: What a text with a base span has, as a quick search.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}"
#: The least characters of a candidate: those of the shortest value that a pattern labels.
SHORTEST = 6
TRAIN_VALUES, PLAIN_VALUES, TRAIN_CHARS = 400, 8000, 256
ALPHA = 0.05
#: Mean log likelihood ratio per character from which a candidate counts as a credential.
LIKELY = 1.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's place, end, value) of every match of the fixed patterns, by start and kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


#: Character classes of the automata and how many characters each holds.
CLASSES = {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"} | {c: c for c in "+/_.=-"}
CLASS_OF = {c: k for k, chars in CLASSES.items() for c in chars}
LOG_SIZE = {k: math.log(len(chars)) for k, chars in CLASSES.items()}


class Automaton:
    """A deterministic probabilistic automaton: per state how often it was reached, ended in, and left by each symbol."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.reached, self.ended = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for v in values:
            state = 0
            self.reached[0] += 1
            for c in v:
                c = CLASS_OF[c]
                if c not in self.next[state]:
                    self.next[state][c] = len(self.reached)
                    self.reached.append(0), self.ended.append(0), self.next.append({}), self.count.append({})
                self.count[state][c] = self.count[state].get(c, 0) + 1
                state = self.next[state][c]
                self.reached[state] += 1
            self.ended[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if self._differ(self.ended[p], self.reached[p], self.ended[q], self.reached[q]):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if self._differ(self.count[p].get(c, 0), self.reached[p], self.count[q].get(c, 0), self.reached[q]):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to the states from p on."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.reached[p] += self.reached[q]
            self.ended[p] += self.ended[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _infer(self) -> None:
        red = [0]
        while True:
            blue = [(p, c, q) for p in red for c, q in sorted(self.next[p].items()) if q not in red]
            if not blue:
                return
            p, c, q = max(blue, key=lambda x: self.reached[x[2]])
            for r in red:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)

    def log_likelihood(self, value: str) -> float:
        """With add-one smoothing over the symbols and the end; unknown transitions restart at the root."""
        state, out, kinds = 0, 0.0, len(CLASSES) + 1
        for c in value:
            k = CLASS_OF[c]
            out += math.log((self.count[state].get(k, 0) + 0.5) / (self.reached[state] + 0.5 * kinds)) - LOG_SIZE[k]
            state = self.next[state].get(k, 0)
        return out + math.log((self.ended[state] + 0.5) / (self.reached[state] + 0.5 * kinds))


class Background:
    """Character bigrams of candidates that no pattern labels."""

    def __init__(self, values: list[str]):
        self.pair: dict[tuple[str, str], int] = defaultdict(int)
        self.one: dict[str, int] = defaultdict(int)
        for v in values:
            for a, b in zip("\n" + v, v + "\n", strict=True):
                self.pair[a, b] += 1
                self.one[a] += 1

    def log_likelihood(self, value: str) -> float:
        return sum(math.log((self.pair.get((a, b), 0) + 0.5) / (self.one.get(a, 0) + 0.5 * 69)) for a, b in zip("\n" + value, value + "\n", strict=True))


class Scanner:
    def __init__(self, values: dict[str, list[str]], alpha: float = ALPHA, likely: float = LIKELY):
        self.automata = [Automaton(sorted(values[k]), alpha) for k in KINDS if values.get(k)]
        self.background, self.likely = Background(sorted(values.get("none", []))), likely
        self.tables = [self._table(a) for a in self.automata]
        chars = "".join(CLASS_OF)
        self.code = np.zeros(128, np.int64)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        every = "\n" + chars
        self.pair = np.array([[math.log((self.background.pair.get((x, y), 0) + 0.5) / (self.background.one.get(x, 0) + 0.5 * 69)) for y in every] for x in every])

    def _table(self, a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per state and character: log probability and next state; per state: log probability of the end."""
        kinds, n = len(CLASSES) + 1, len(a.reached)
        log, after = np.zeros((n, len(CLASS_OF) + 1)), np.zeros((n, len(CLASS_OF) + 1), np.int64)
        for s in range(n):
            for k, c in enumerate(CLASS_OF.values()):
                log[s, k + 1] = math.log((a.count[s].get(c, 0) + 0.5) / (a.reached[s] + 0.5 * kinds)) - LOG_SIZE[c]
                after[s, k + 1] = a.next[s].get(c, 0)
        return log, after, np.array([math.log((a.ended[s] + 0.5) / (a.reached[s] + 0.5 * kinds)) for s in range(n)])

    def score(self, value: str) -> float:
        if not self.automata:
            return -math.inf
        return (max(a.log_likelihood(value) for a in self.automata) - self.background.log_likelihood(value)) / (len(value) + 1)

    def scores(self, values: pa.Array) -> np.ndarray:
        """score() of each of many values, the longest first, one character of all at a time."""
        n = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.automata or not len(n):
            return np.full(len(n), -np.inf)
        order = np.argsort(-n, kind="stable")
        ends = np.cumsum(n)
        text = self.code[np.frombuffer("".join(values.to_pylist()).encode(), np.uint8)]
        size, start = n[order], (ends - n)[order]
        best = np.full(len(n), -np.inf)
        plain, last = np.zeros(len(n)), np.zeros(len(n), np.int64)
        sums, states = [np.zeros(len(n)) for _ in self.tables], [np.zeros(len(n), np.int64) for _ in self.tables]
        for k in range(int(size[0])):
            m = int(np.searchsorted(-size, -k, "left"))  # values with more than k characters
            c = text[start[:m] + k]
            plain[:m] += self.pair[last[:m], c]
            last[:m] = c
            for (log, after, _), total, state in zip(self.tables, sums, states, strict=True):
                total[:m] += log[state[:m], c]
                state[:m] = after[state[:m], c]
        plain += self.pair[last, 0]
        for (_, _, end), total, state in zip(self.tables, sums, states, strict=True):
            best = np.maximum(best, total + end[state])
        out = np.empty(len(n))
        out[order] = (best - plain) / (size + 1)
        return out

    def scan(self, texts: pa.Array) -> list[tuple[list[tuple], list[tuple]]]:
        """Of each text its base spans and the added ones."""
        hints = pc.match_substring_regex(texts, HINT).to_numpy(zero_copy_only=False)
        base: list[list[tuple]] = [[] for _ in range(len(texts))]
        plain = {}
        for k in np.flatnonzero(hints).tolist():
            t = texts[k].as_py()
            base[k] = base_spans(t)
            if base[k]:
                plain[k] = uncovered(t, base[k])
        runs = candidates(with_changes(texts, plain))
        likely = np.flatnonzero(self.scores(runs.dictionary) >= self.likely)
        rows = np.unique(runs.rows[np.isin(runs.index, likely)])
        known = set(runs.dictionary.take(pa.array(likely)).to_pylist())
        added: list[list[tuple]] = [[] for _ in range(len(texts))]
        for k in rows.tolist():
            t = plain.get(k) or texts[k].as_py()
            added[k] = [(m.start(), len(KINDS), m.end()) for m in RUN.finditer(t) if m[0] in known]
        return list(zip(base, added, strict=True))


def uncovered(text: str, base: list[tuple]) -> str:
    """The text with blanks where base spans are."""
    out, at = [], 0
    for s, _, e, _ in sorted(base, key=lambda x: x[0]):
        if e > at:
            s = max(s, at)
            out += [text[at:s], " " * (e - s)]
            at = e
    return "".join([*out, text[at:]])


def with_changes(texts: pa.Array, changed: dict[int, str]) -> pa.Array:
    if not changed:
        return texts
    mask = np.zeros(len(texts), bool)
    mask[list(changed)] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[k] for k in sorted(changed)], texts.type))


class Candidates(NamedTuple):
    dictionary: pa.Array
    index: np.ndarray
    rows: np.ndarray


def candidates(texts: pa.Array) -> Candidates:
    """The distinct runs of credential characters from SHORTEST on, and each of their places: run and text."""
    lists = pc.split_pattern_regex(texts, "[^A-Za-z0-9+/_.=-]+")
    flat, rows = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    long = pc.greater_equal(pc.binary_length(flat), SHORTEST)
    coded = pc.dictionary_encode(flat.filter(long))
    return Candidates(coded.dictionary, coded.indices.to_numpy(), rows[long.to_numpy(zero_copy_only=False)])


def labelled_values(docs: DataFrame, labelled: int = TRAIN_VALUES, plain: int = PLAIN_VALUES) -> dict[str, list[str]]:
    """Of each kind (and of unlabelled candidates, ``none``) the values with the smallest hashes."""
    bounds = dict.fromkeys(KINDS, labelled) | {"none": plain}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, str]] = {k: {} for k in (*KINDS, "none")}

        def put(kind: str, values) -> None:
            held, bar = best[kind], bars.get(kind, 1 << 63)
            for v in values:
                h = xxhash.xxh3_64_intdigest(v) >> 1
                if h < bar:
                    held[h] = v[:TRAIN_CHARS]
            if len(held) > 4 * bounds[kind]:
                best[kind] = dict(sorted(held.items())[: bounds[kind]])
                bars[kind] = max(best[kind])

        bars: dict[str, int] = {}
        for b in by_chars(batches):
            texts, bare = b.column(1), {}
            for k in np.flatnonzero(pc.match_substring_regex(texts, HINT).to_numpy(zero_copy_only=False)).tolist():
                t = texts[k].as_py()
                base = base_spans(t)
                for _, kind, _, v in base:
                    put(KINDS[kind], (v,))
                if base:
                    bare[k] = uncovered(t, base)
            put("none", candidates(with_changes(texts, bare)).dictionary.to_pylist())
        out = [{"kind": k, "h": h, "value": v} for k, held in best.items() for h, v in sorted(held.items())[: bounds[k]]]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("kind", pa.string()), ("h", pa.int64()), ("value", pa.string())]))

    found = stored(id_text(docs).mapInArrow(run, "kind string, h long, value string").distinct(), "credentials")
    # a histogram of the hashes' logarithms tells which hashes can be among the smallest; little more than those reach the driver
    grade = F.floor(F.log2(F.col("h") + 1.0) * 16).cast("int")
    left, least = dict(bounds), dict.fromkeys(bounds, -1)
    for r in sorted(found.groupBy("kind", grade.alias("g")).agg(F.count("*").alias("n")).collect()):
        if left[r.kind] > 0:
            left[r.kind], least[r.kind] = left[r.kind] - r.n, r.g
    wanted = F.lit(False)
    for kind, g in least.items():
        wanted = wanted | ((F.col("kind") == kind) & (grade <= g))
    out: dict[str, list[str]] = {k: [] for k in bounds}
    for r in sorted(found.where(wanted).select("kind", "h", "value").collect()):
        if len(out[r.kind]) < bounds[r.kind]:
            out[r.kind].append(r.value)
    return out


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    names = (*KINDS, "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_chars(batches):
            counts, digest, spans = ([], [], []), [], []
            for base, added in scanner.scan(b.column(1)):
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
                every = sorted([x[:3] for x in base] + added)
                spans.append(",".join(f"{names[k]}:{s}:{e}" for s, k, e in every))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op5_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs, Scanner(labelled_values(docs)))
