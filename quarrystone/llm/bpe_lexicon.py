"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Words (pieces of the pre-tokenizer) are counted over all documents; the frequent ones, at most
LEXICON_WORDS of them, are encoded by exact merging and compiled into a minimal acyclic automaton whose
equal suffixes are shared. Its arcs carry numbers that add up to a word's place in the lexicon, and
that place to its ids, which makes it a transducer from words to ids. It is one flat file in the shared
folder; workers map it into memory (or, from a store without mapping, read it into one buffer).
Unseen words are merged exactly: the pair of lowest rank first, the leftmost of equals. The words that a batch adds
walk the automaton together, a byte a step, and those it lacks are merged together, a pair a step.

The steps follow the tokenizer file: special strings are cut out first, then NFC, lower case by
character, and the pattern of the Split pre-tokenizer; no piece crosses white space, so texts are
worked on by their white-space-free parts. Beyond Latin-1, composition, lower case and the classes of letters and numbers
change with the version of Unicode: there they are asked of the library, once a part and once a character. Decoding maps ids to token strings and joins them by blanks,
as a tokenizer without decoder does.

Null texts count as empty: no ids, the empty string. A null doc_id is kept. Equal rows get equal rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import by_chars, file_system, id_text, in_slices, shared_path, stored
from quarrystone.llm.word_ids import WordIds, gather

LEXICON_WORDS = 1 << 16
#: Words that a task counts before it emits them.
COUNTED = 100_000
#: White space as the tokenizer's patterns take it (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
#: Parts of these characters alone are composed, and the same in every version of Unicode.
LATIN = regex.compile("[\\x00-\u00ff]*")
SHORT = regex.compile("'(?:s|t|re|ve|m|ll|d)")
RUN = regex.compile("L+|N|P+|S+")
HEAD = struct.Struct("<8sIIII")
NO_PAIR = 1 << 62
#: Bytes of the longest word that is merged together with others, and words merged at once.
ROW, ROWS = 64, 1 << 14
MAGIC = b"QSMAT001"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is
    printable and no blank, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Kinds(dict):
    """Of a character: L letter, N number, S white space, P anything else, as the library's pre-tokenizer takes it."""

    def __init__(self, split):
        self.split = split

    def __missing__(self, c: str) -> str:
        alone = len(self.split(c))
        self[c] = "S" if not alone else "L" if len(self.split("a" + c)) == 1 else "P" if len(self.split("-" + c)) == 1 else "N"
        return self[c]


class Bpe:
    """The parts of a tokenizer file, and exact merging."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalize, self.kind = library.normalizer.normalize_str, Kinds(library.pre_tokenizer.pre_tokenize_str)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        # a pair of ids as one number -> its rank, then the id that it becomes
        vocab = self.vocab
        self.pair = {vocab[a] << 32 | vocab[b]: k << 32 | vocab[a + b] for k, (a, b) in enumerate(pairs)}
        self.pair_keys = np.array(sorted(self.pair), np.int64)
        self.pair_ranks = np.array([self.pair[k] for k in self.pair_keys.tolist()], np.int64)
        symbols = byte_symbols()
        self.byte, self.last = [vocab[c] for c in symbols], [vocab[c + self.suffix] for c in symbols]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.heads = {s[0] for s in self.special}
        self.letters = not any(h.isascii() and h.isalpha() for h in self.heads)
        tokens = {k: t for t, k in self.vocab.items()} | {k: t for t, k in self.special.items()}
        self.tokens = [tokens.get(k, "") for k in range(max(tokens) + 1)]

    def plain(self, words: pa.Array) -> pa.Array:
        """Which words are ASCII letters alone, so that their lower case is their one piece."""
        return pc.and_(pc.ascii_is_alpha(words), self.letters)

    def pieces(self, part: str) -> list[str]:
        """Normalised pieces of a text without white space and special strings."""
        if not part:
            return []
        if part.isascii():
            low = part.lower()
            if low.isalpha():
                return [low]
            return [low[:-1], low[-1]] if low[:-1].isalpha() else PIECES.findall(low)
        if LATIN.fullmatch(part):
            return PIECES.findall(part.lower())
        low, out, at = self.normalize(part), [], 0
        kinds = "".join(map(self.kind.__getitem__, low))
        while at < len(low):
            m = SHORT.match(low, at) or RUN.match(kinds, at)
            if kinds[at] != "S":
                out.append(low[at : m.end()])
            at = m.end()
        return out

    def parts(self, part: str) -> list[str | int]:
        """Pieces and ids of special strings of a text without white space."""
        if self.heads.isdisjoint(part):
            return self.pieces(part)
        out, at = [], 0
        for m in self.cut.finditer(part):
            out += [*self.pieces(part[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.pieces(part[at:])

    def merge(self, piece: bytes) -> list[int]:
        word = [*map(self.byte.__getitem__, piece[:-1]), self.last[piece[-1]]]
        get = self.pair.get
        if len(word) > ROW:
            return self._merge_long(word)
        best_of = [get(a << 32 | b, NO_PAIR) for a, b in zip(word, word[1:], strict=False)]
        while best_of:
            best = min(best_of)
            if best == NO_PAIR:
                break
            k = best_of.index(best)
            word[k] = best & 0xFFFFFFFF
            del word[k + 1], best_of[k]
            if k:
                best_of[k - 1] = get(word[k - 1] << 32 | word[k], NO_PAIR)
            if k < len(best_of):
                best_of[k] = get(word[k] << 32 | word[k + 1], NO_PAIR)
        return word

    def _merge_long(self, word: list[int]) -> list[int]:
        """All places of the best pair in one pass: no pair that a merge makes has a lower rank than it."""
        get = self.pair.get
        while len(word) > 1:
            best, pair = min((get(p, NO_PAIR), p) for p in {a << 32 | b for a, b in zip(word, word[1:], strict=False)})
            if best == NO_PAIR:
                break
            a, b, made, out, k = pair >> 32, pair & 0xFFFFFFFF, best & 0xFFFFFFFF, [], 0
            while k < len(word):
                if k + 1 < len(word) and word[k] == a and word[k + 1] == b:
                    out.append(made)
                    k += 2
                else:
                    out.append(word[k])
                    k += 1
            word = out
        return word

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a << 32 | b
        if not len(self.pair_keys):
            return np.full(pairs.shape, NO_PAIR)
        at = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == pairs, self.pair_ranks[at], NO_PAIR)

    def merge_all(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge, of all words (runs of data): their ids one after another, and how many each has."""
        flat, counts = [], []
        for at in range(0, len(starts), ROWS):
            ids, n = self._merge_rows(data, starts[at : at + ROWS], sizes[at : at + ROWS])
            flat.append(ids)
            counts.append(n)
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the longest words on: at each step all words of n ids, n falling, are one matrix, and lose one id or are done."""
        byte, last = np.array(self.byte, np.int64), np.array(self.last, np.int64)
        done = [(np.array([k]), np.array([self.merge(data[starts[k] : starts[k] + sizes[k]].tobytes())])) for k in np.flatnonzero(sizes > ROW)]
        short = sizes[sizes <= ROW]
        n = int(short.max(initial=0))
        which, ids, best = np.zeros(0, np.int64), np.zeros((0, n), np.int64), np.zeros((0, max(n - 1, 0)), np.int64)
        for n in range(n, 0, -1):  # noqa: B020, PLR1704
            new = np.flatnonzero(sizes == n)
            if len(new):
                raw = data[starts[new][:, None] + np.arange(n)]
                more = byte[raw]
                more[:, -1] = last[raw[:, -1]]
                which, ids = np.concatenate([which, new]), np.concatenate([ids, more])
                best = np.concatenate([best, self._ranks(more[:, :-1], more[:, 1:])])
            if n == 1:
                done.append((which, ids))
                break
            row = np.arange(len(which))
            k = best.argmin(1)
            v = best[row, k]
            go = v != NO_PAIR
            done.append((which[~go], ids[~go]))
            which, ids, best, k, v = which[go], ids[go], best[go], k[go], v[go]
            row = row[: len(which)]
            ids[row, k] = v & 0xFFFFFFFF
            stay = np.ones(ids.shape, bool)
            stay[row, k + 1] = False
            ids = ids[stay].reshape(len(row), n - 1)
            stay = np.ones(best.shape, bool)
            stay[row, k] = False
            best = best[stay].reshape(len(row), n - 2)
            r, c = row[k > 0], k[k > 0]
            best[r, c - 1] = self._ranks(ids[r, c - 1], ids[r, c])
            r, c = row[k < n - 2], k[k < n - 2]
            best[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
        counts = np.zeros(len(sizes), np.int64)
        for which, ids in done:
            counts[which] = ids.shape[1]
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for which, ids in done:
            flat[first[which][:, None] + np.arange(ids.shape[1])] = ids
        return flat, counts


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton file of words and their ids (built from sorted words, minimised on the way)."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple]] = []  # (ends a word, ((byte, target), ...))

    def settled(final: bool, arcs: list) -> int:
        sign = (final, tuple(arcs))
        if sign not in register:
            register[sign] = len(nodes)
            nodes.append(sign)
        return register[sign]

    path: list[list] = [[False, []]]  # the states of the last word, not yet settled: [final, arcs]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settled(final, arcs)))

    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in w[same:])
        path[-1][0] = True
        last = w
    close(0)
    root = settled(*path[0])
    below = [0] * len(nodes)
    labels, targets, skips, first = bytearray(), [], [], []
    for k, (final, arcs) in enumerate(nodes):  # targets come before their sources
        first.append(len(targets))
        n = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(n)
            n += below[target]
        below[k] = n
    first.append(len(targets))
    ids = [entries[w] for w in words]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    finals = np.array([int(f) for f, _ in nodes], np.uint32)
    body = [np.array(x, "<u4").tobytes() for x in (first, finals, targets, skips, ends, [i for x in ids for i in x])]
    return HEAD.pack(MAGIC, len(nodes), len(targets), len(words), root) + b"".join(body) + bytes(labels)


class Lexicon:
    """A compiled automaton, mapped into memory."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        if fs.type_name == "local":
            data = memoryview(pa.memory_map(at).read_buffer())
        else:
            with fs.open_input_file(at) as f:
                data = memoryview(f.read_buffer())
        data = data.cast("B")  # Arrow's own bytes are signed
        magic, n, arcs, words, self.root = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        at, parts = HEAD.size, []
        for k in (n + 1, n, arcs, arcs, words + 1):
            parts.append(data[at : at + 4 * k].cast("I"))
            at += 4 * k
        self.first, self.final, self.target, self.skip, self.ends = parts
        total = self.ends[words]
        self.ids = data[at : at + 4 * total]
        self.labels = data[at + 4 * total :]
        #: State and label of each arc as one number, rising.
        self.keys = np.repeat(np.arange(n) << 8, np.diff(np.asarray(self.first).astype(np.int64))) | np.asarray(self.labels)[:arcs]

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers; None if the lexicon lacks it."""
        state, place, first, labels = self.root, 0, self.first, self.labels
        for b in word:
            a, z = first[state], first[state + 1]
            while a < z:
                mid = (a + z) >> 1
                if labels[mid] < b:
                    a = mid + 1
                else:
                    z = mid
            if a == first[state + 1] or labels[a] != b:
                return None
            place += self.skip[a]
            state = self.target[a]
        if not self.final[state]:
            return None
        return bytes(self.ids[4 * self.ends[place] : 4 * self.ends[place + 1]])

    def places(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of all words (runs of data); -1 if the lexicon lacks a word."""
        target, skip = np.asarray(self.target), np.asarray(self.skip)
        state, place = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        alive, i = np.arange(len(starts)), 0
        while len(alive := alive[sizes[alive] > i]):
            want = state[alive] << 8 | data[starts[alive] + i]
            a = np.searchsorted(self.keys, want)
            found = a < len(self.keys)
            found[found] = self.keys[a[found]] == want[found]
            place[alive[~found]] = -1
            alive, a = alive[found], a[found]
            place[alive] += skip[a]
            state[alive] = target[a]
            i += 1
        return np.where((place >= 0) & (np.asarray(self.final)[state] > 0), place, -1)


class Encoder:
    """Texts to ids by lexicon and merging."""

    def __init__(self, tokenizer: str, lexicon: str | None):
        self.bpe, self.lexicon = Bpe(tokenizer), Lexicon(lexicon) if lexicon else None
        self.words = WordIds(self._resolve)

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after another, and how many each has."""
        pieces = pa.concat_arrays([pieces, pa.array([], pa.large_string())])
        _, ends, data = pieces.buffers()
        ends = np.frombuffer(ends, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        starts, sizes = ends[:-1], np.diff(ends)
        if self.lexicon is None:
            return self.bpe.merge_all(data, starts, sizes)
        place = self.lexicon.places(data, starts, sizes)
        new = np.flatnonzero(place < 0)
        ids, counts = self.bpe.merge_all(data, starts[new], sizes[new])
        known, ends = np.frombuffer(self.lexicon.ids, "<u4"), np.asarray(self.lexicon.ends).astype(np.int64)
        first, n = ends[place], ends[place + 1] - ends[place]
        first[new], n[new] = len(known) + np.cumsum(counts) - counts, counts
        return gather(np.concatenate([known, ids]), first, n), n

    def _resolve(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        plain = self.bpe.plain(words)
        easy, odd = words.filter(plain), words.filter(pc.invert(plain))
        parts = list(map(self.bpe.parts, odd.to_pylist()))
        items = [p for part in parts for p in part]
        coded = pc.dictionary_encode(pa.concat_arrays([pc.ascii_lower(easy), pa.array(["" if isinstance(p, int) else p for p in items], pa.large_string())]))
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, counts = self._ids(coded.dictionary)
        special = [k for k, p in enumerate(items) if isinstance(p, int)]
        index[np.array(special, np.int64) + len(easy)] = len(counts) + np.arange(len(special))
        ids = np.concatenate([ids, np.array([items[k] for k in special], np.uint32)])
        counts = np.concatenate([counts, np.ones(len(special), np.int64)])
        first, sizes = (np.cumsum(counts) - counts)[index], counts[index]
        stops = np.concatenate([[0], np.cumsum(sizes[len(easy) :])])[np.cumsum([0, *map(len, parts)])]
        return pa.concat_arrays([easy, odd]), gather(ids, first, sizes), np.concatenate([sizes[: len(easy)], np.diff(stops)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where those of each text stop."""
        return self.words.encode(texts)


_encoders: dict[tuple, Encoder] = {}


def encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    """One encoder a worker process, for the lexicon in use: its cache outlives a task."""
    key = (tokenizer, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer, lexicon)
    return _encoders[key]


class Decoder:
    def __init__(self, tokens: list[str]):
        self.tokens = [t.encode() for t in tokens]

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def count_words(docs: DataFrame, tokenizer: str) -> DataFrame:
    """word, n over all documents. Each task counts in a bounded table and emits it whenever that is full."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, kept, rows = Bpe(tokenizer), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                found = pa.concat_tables(kept).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
                kept.clear()
                yield from found.combine_chunks().to_batches()

        for b in by_chars(batches):
            found = pc.value_counts(pc.ascii_split_whitespace(b.column(1)).flatten())
            part, n = found.field(0), found.field(1)
            plain = bpe.plain(part)
            odd, words = pc.invert(plain), Counter()
            for x, c in zip(part.filter(odd).to_pylist(), n.filter(odd).to_pylist(), strict=True):
                for p in bpe.parts(x):
                    if isinstance(p, str):
                        words[p] += c
            for w, c in ((pc.ascii_lower(part.filter(plain)), n.filter(plain)), (pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()))):
                kept.append(pa.table({"word": w.cast(pa.binary()), "n": c}))
                rows += len(w)
            if rows > COUNTED:
                yield from flush()
                rows = 0
        yield from flush()

    return id_text(docs).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words and write the automaton to the shared folder; gives its path.

    A histogram of the logarithms of the counts gives the least count that keeps to the bound; only the
    words above it reach the driver."""
    counts = stored(count_words(docs, tokenizer), "words")
    grade = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    left, least = words, None
    for r in sorted(counts.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if r.n > left:
            break
        left, least = left - r.n, r.g
    bpe = Bpe(tokenizer)
    frequent = counts.where(grade >= least).select("word").collect() if least is not None else []
    path = shared_path(docs.sparkSession, "lexicon")
    fs, at = file_system(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(compile_lexicon({bytes(r.word): bpe.merge(bytes(r.word)) for r in frequent}))
    return path


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None) -> DataFrame:
    """doc_id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, lexicon)
        for b in by_chars(batches):
            ids, stops = enc.encode(b.column(1))
            ends = pa.array(np.concatenate([[0], stops]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(ids.view(np.int32)))], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids (null ids: the empty string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(Bpe(tokenizer).tokens)
        for b in in_slices(batches):
            text = [dec.decode(np.array(i or [], "<u4").tobytes()).decode() for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str | None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, lexicon)
        dec = Decoder(enc.bpe.tokens)
        for b in by_chars(batches):
            flat, stops = enc.encode(b.column(1))
            ids = [flat[a:z].astype("<u4").tobytes() for a, z in zip([0, *stops.tolist()], stops.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(dec.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return round_trip(docs, tokenizer, build_lexicon(docs, tokenizer))
