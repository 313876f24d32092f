"""Ids of texts, put together from the ids of their words in Arrow and numpy, with a cache bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP_BYTES = 24 << 20


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that start there, one after another."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class WordIds:
    """Texts are split at ASCII white space, the distinct words of a batch are found in Arrow, words that the cache lacks
    are resolved, and the ids of the batch are gathered. When the cache exceeds its bytes, what the batch at hand has stays.

    resolve(words) gives the same words in any order, their ids one after another, and how many each has."""

    def __init__(self, resolve: Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]], keep_bytes: int = KEEP_BYTES):
        self.resolve, self.keep_bytes = resolve, keep_bytes
        self.words, self.flat, self.at = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where those of each text stop."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = pc.dictionary_encode(lists.flatten())
        words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        at = pc.index_in(words, self.words)
        if at.null_count:
            if self.words.nbytes + self.flat.nbytes + self.at.nbytes > self.keep_bytes:
                keep = pc.drop_null(at).to_numpy()
                held, sizes = self.words.take(pa.array(keep)), self.at[keep + 1] - self.at[keep]
                self.flat, self.at, self.words = gather(self.flat, self.at[keep], sizes), np.concatenate([[0], np.cumsum(sizes)]), held
            new, ids, sizes = self.resolve(words.filter(pc.is_null(at)))
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)]).astype(np.int64)
            at = pc.index_in(words, self.words)
        at = at.to_numpy()[index]
        sizes = self.at[at + 1] - self.at[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        return gather(self.flat, self.at[at], sizes), stops
