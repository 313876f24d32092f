"""The k best of every slot of a stream of batches: what leaves a task is bounded by k and the slots, not by the rows read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values are ranked as rounded to so many digits, ties by id.
DIGITS = 9
#: Added to the keys of rows that come before all others; keys of values stay below.
FIRST = 5 * 10**18
_NONE = np.iinfo(np.int64).min


def _keys(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest integer that a value times 10 ** DIGITS can round to, whichever way it is rounded in binary or decimal; NaN is the largest of all."""
    s = value * 10.0**DIGITS
    slack = np.minimum(1e-6 + 1e-15 * np.abs(s), 1e18)
    low, high = (np.where(np.isnan(s), 2.2e18, np.clip(np.floor(np.nan_to_num(s, nan=0.0, posinf=2.1e18, neginf=-2.1e18) + 0.5 + sign * slack), -2.1e18, 2.1e18)).astype(np.int64) for sign in (-1, 1))
    return low, high


def _ordered(ids: pa.Array) -> pa.Array:
    """What rows are ordered by: of rows with further fields, the id."""
    return ids.field("id") if pa.types.is_struct(ids.type) else ids


class Best:
    """Rows (slot, value, id, first) of which those are held that can be among their slot's k best: rows marked as first, then by rounded value, then by id.

    Rows are dropped only if k rows are surely better; a value that rounds one way or the other counts as both."""

    def __init__(self, k: int, room: int = 1 << 18):
        self.k, self.room, self.held, self.parts = k, room, 0, []
        self.least = np.empty(0, np.int64)

    def floor(self, slots: np.ndarray) -> np.ndarray:
        """Values below this cannot be among the k best of their slot, unless they are marked as first."""
        self._grow(int(slots.max(initial=-1)) + 1)
        least = self.least[slots]
        return np.where(least == _NONE, -np.inf, (least - 1.0) / 10.0**DIGITS * (1 - 1e-12 * np.sign(least)))

    def add(self, slot: np.ndarray, value: np.ndarray, ids: pa.Array, first: np.ndarray | None = None) -> None:
        if len(slot):
            self._grow(int(slot.max()) + 1)
            self.parts.append((slot.astype(np.int64), value, ids, np.zeros(len(slot), bool) if first is None else first))
            self.held += len(slot)
            if self.held > max(self.room, 2 * self.k * len(self.least)):
                self._prune()

    def take(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray] | None:
        """The rows that are left, by slot; None if there are none."""
        self._prune()
        return self.parts[0] if self.parts else None

    def _grow(self, slots: int) -> None:
        if slots > len(self.least):
            self.least = np.concatenate([self.least, np.full(slots - len(self.least), _NONE)])

    def _prune(self) -> None:
        if not self.parts:
            return
        slot, value, first = (np.concatenate([p[n] for p in self.parts]) for n in (0, 1, 3))
        chunks = [c for p in self.parts for c in (p[2].chunks if isinstance(p[2], pa.ChunkedArray) else [p[2]])]
        ids = pa.concat_arrays(chunks)
        low, high = _keys(value)
        low, high = low + FIRST * first, high + FIRST * first
        order = np.lexsort((-low, slot))
        count = np.bincount(slot, minlength=len(self.least))
        start = np.cumsum(count) - count
        full = np.flatnonzero(count >= self.k)
        self.least[full] = low[order[start[full] + self.k - 1]]
        least = self.least[slot]
        keep = high >= least
        # of rows that surely have the k-th value, the smallest ids stay
        tie = np.flatnonzero((low == least) & (high == least))
        above = np.bincount(slot[low > least], minlength=len(self.least))
        tie = tie[np.lexsort((pc.rank(_ordered(ids.take(pa.array(tie))), null_placement="at_start", tiebreaker="dense").to_numpy(), slot[tie]))]
        of = slot[tie]
        new = np.r_[True, of[1:] != of[:-1]] if len(of) else np.empty(0, bool)
        place = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0)) if len(of) else np.empty(0, np.int64)
        keep[tie[above[of] + place >= self.k]] = False
        left = np.flatnonzero(keep)
        left = left[np.argsort(slot[left], kind="stable")]
        self.parts, self.held = [(slot[left], value[left], ids.take(pa.array(left)), first[left])], len(left)
