"""Token-id output: fixed-width bit packing with block offsets.

Each id takes the fewest bits that the vocabulary needs. A shard file holds blocks of a fixed number
of ids, packed most significant bit first and padded to whole bytes, then a footer with the byte
offset of every block and a table of documents, so any document or range of ids is read by seeking
to its blocks, and a block is unpacked by a few numpy calls.

Shards are written in ascending doc_id order (null ids first, equal ids by text). A task writes its
shard under a name of its own attempt and reports that name; the manifest lists only reported shards,
so a repeated task leaves at most an unlisted file, which is removed when the manifest is written.

Nulls: a null text is empty and still gets the end id; a null doc_id is kept as null. Repeated rows
stay repeated. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import by_chars, file_system, id_text, shared_path
from quarrystone.llm.word_ids import WordIds

MAGIC = b"QSBITS01"
HEAD, TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
BLOCK_IDS = 65536


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold the ids 0 .. vocab_size - 1."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(flat.reshape(-1)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


class ShardWriter:
    """Streams documents into one shard; only one block of ids is held."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.doc_ids, self.known, self.counts, self.at = array("q"), array("B"), array("q"), HEAD.size
        self.blocks = [self.at]
        out.write(HEAD.pack(MAGIC, bits, block_ids))

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents and how many of the ids each has."""
        self.doc_ids.extend(x or 0 for x in doc_ids)
        self.known.extend(x is not None for x in doc_ids)
        self.counts.extend(counts.tolist())
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for k in range(0, whole, self.block_ids):
            data = pack(ids[k : min(k + self.block_ids, whole)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for part in (np.array(self.blocks, "<u8"), np.array(self.doc_ids, "<i8"), np.array(self.counts, "<i8"), np.array(self.known, np.uint8)):
            self.out.write(part.tobytes())
        self.out.write(TAIL.pack(len(self.blocks) - 1, len(self.doc_ids), self.n_ids, self.at, MAGIC))
        self.out.close()


class ShardReader:
    """Random access to one shard."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n_blocks, n_docs, self.n_ids, foot, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a packed id shard")
        _, self.bits, self.block_ids = HEAD.unpack(file.read_at(HEAD.size, 0))
        foot_data, at = file.read_at(size - TAIL.size - foot, foot), 8 * (n_blocks + 1)
        self.blocks = np.frombuffer(foot_data, "<u8", n_blocks + 1)
        ids = np.frombuffer(foot_data, "<i8", n_docs, at)
        self.counts = np.frombuffer(foot_data, "<i8", n_docs, at + 8 * n_docs)
        known = np.frombuffer(foot_data, np.uint8, n_docs, at + 16 * n_docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids start .. stop - 1 of the shard; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        parts = []
        for b in range(first, last + 1):
            lo = int(self.blocks[b] - self.blocks[first])
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            parts.append(unpack(data[lo : lo + int(self.blocks[b + 1] - self.blocks[b])], n, self.bits))
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class LibraryEncoder:
    """Ids as the tokenizers library gives them for whole texts.

    Where the tokenizer file has the settings that SETTINGS states, no token crosses white space, so a text's ids
    are those of its words in order (``WordIds``). Words of the letters LETTERS, with at most one mark behind, need no normalisation but lower case (all of them are
    letters in every version of Unicode and composed already) and go to a copy of the tokenizer that splits at blanks
    only; all others go to the tokenizer as it is, many to a call with a digit between them that none of them has,
    whose id then parts their ids. With any other settings, whole texts go to the library."""

    # The settings of the file word_bpe_49k.json.
    SETTINGS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "post_processor": None,
    }
    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    MARK = "7"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        added = data["added_tokens"]
        known = all(data.get(k) == v for k, v in self.SETTINGS.items()) and model["type"] == "BPE" and model["end_of_word_suffix"]
        self.by_word = bool(known) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added)
        if self.by_word:
            blanks = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, self.SETTINGS["pre_tokenizer"]["pretokenizers"][1]]}
            self.plain = Tokenizer.from_str(json.dumps(data | {"normalizer": None, "pre_tokenizer": blanks, "added_tokens": [], "truncation": None, "padding": None}))
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[k for w, k in model["vocab"].items() if w.endswith(model["end_of_word_suffix"])]] = True
            mark = self._ids(self.MARK)
            self.mark = int(mark[0]) if len(mark) == 1 else None
        self.words = WordIds(self._resolve)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of LETTERS and at most one mark behind, and how many each has."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), r"([.,;:!?])$", r" \1")
        ids = np.array(self.plain.encode_batch_fast([" ".join(spaced.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
        parts = np.cumsum(1 + pc.match_substring_regex(words, "[.,;:!?]$").to_numpy(zero_copy_only=False))
        stops = np.flatnonzero(self.ends[ids])[parts - 1] + 1 if len(parts) else np.zeros(0, np.int64)
        return ids, np.diff(stops, prepend=0)

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(words)
        joint = [k for k, w in enumerate(words) if self.MARK not in w] if self.mark is not None else []
        for a in range(0, len(joint), 4096):
            part = joint[a : a + 4096]
            ids = self._ids(f" {self.MARK} ".join(words[k] for k in part))
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(part) - 1:
                for k, x, z in zip(part, [0, *(marks + 1)], [*marks, len(ids)], strict=True):
                    out[k] = ids[x:z]
        out = [self._ids(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.array([len(x) for x in out], np.int64)

    def _resolve(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, f"^[{self.LETTERS}]+[.,;:!?]?$")
        easy, rest = words.filter(plain), words.filter(pc.invert(plain))
        (a, m), (b, n) = self._plain(easy), self._other(rest.to_pylist())
        return pa.concat_arrays([easy, rest]), np.concatenate([a, b]), np.concatenate([m, n])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where those of each text stop."""
        if self.by_word:
            return self.words.encode(texts)
        each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([*each, np.zeros(0, np.uint32)]), np.cumsum([len(x) for x in each], dtype=np.int64)


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a worker process: its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def vocab_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode documents and write shards in doc_id order below path; gives the manifest.

    manifest: shard long, file string, start long (ids in earlier shards), n_docs long, n_ids long. The driver
    sees one such row per shard and nothing else."""
    spark, bits = docs.sparkSession, bits_for(vocab_size(tokenizer))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer = TaskContext.get().partitionId(), None
        for b in by_chars(batches):
            if writer is None:
                fs, folder = file_system(path)
                fs.create_dir(folder, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bits"
                enc, writer = library_encoder(tokenizer), ShardWriter(fs.open_output_stream(f"{folder}/{name}"), bits, block_ids)
            ids, stops = enc.encode(b.column(1))
            writer.add(b.column(0).to_pylist(), np.diff(stops, prepend=0) + 1, np.insert(ids, stops, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids}])

    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted(ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long").collect())
    listed, at = [], 0
    for r in rows:
        listed.append((r.shard, r.file, at, r.n_docs, r.n_ids))
        at += r.n_ids
    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)
    from pyarrow.fs import FileSelector

    names = {r[1] for r in listed}
    for info in fs.get_file_info(FileSelector(folder)):
        if info.base_name.endswith(".bits") and info.base_name not in names:
            fs.delete_file(info.path)
    manifest = spark.createDataFrame(listed, "shard long, file string, start long, n_docs long, n_ids long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest.repartition(max(1, len(listed)))


def read_packed(manifest: DataFrame, path: str, at_once: int = 1 << 20) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before), n_tokens, ids (binary, little-endian 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(f"{folder}/{r['file']}") as f:
                    shard, k = ShardReader(f), 0
                    n = len(shard.counts)
                    while k < n:
                        stop = max(k + 1, int(np.searchsorted(shard.starts, shard.starts[k] + at_once, "right")) - 1)
                        stop = min(stop, n, k + 4096)
                        ids, base = shard.ids(int(shard.starts[k]), int(shard.starts[stop])).astype("<u4"), int(shard.starts[k])
                        cut = [ids[int(shard.starts[j]) - base : int(shard.starts[j + 1]) - base].tobytes() for j in range(k, stop)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.doc_ids[k:stop], pa.int64()),
                                pa.array(shard.starts[k:stop] + r["start"], pa.int64()),
                                pa.array(shard.counts[k:stop], pa.int64()),
                                pa.array(cut, pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        k = stop

    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_ids(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_path(spark, "packed")
    manifest = write_packed(docs, path, tokenizer, end_id=1)
    return read_packed(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
