"""Ids of strings met before, remembered under 64-bit keys."""

import numpy as np
import pyarrow as pa

from .hashing import string_hashes


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs [start, start + size) of `flat`, one after the other."""
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    return flat[np.repeat(starts - stops + sizes, sizes) + np.arange(total)]


class Memo:
    """Runs of ids by string, some 20 bytes a string. `keep` bounds the bytes remembered (memory only):
    past it the memo starts anew. Subclasses encode what is new."""

    def __init__(self, kind: np.dtype, keep: int = 32 << 20):
        self.kind, self.keep = kind, keep
        self.clear()

    def clear(self) -> None:
        self.flat, self.keys = np.zeros(0, self.kind), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def fresh(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct strings one after the other, and their counts."""
        raise TypeError("a subclass encodes")

    def entries(self, strings: pa.Array) -> np.ndarray:
        """Where the ids of distinct strings are remembered, as places in `starts` and `sizes`."""
        keys = string_hashes(strings)
        if self.flat.nbytes + self.keys.nbytes + self.starts.nbytes + self.sizes.nbytes > self.keep:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if not new.any():
            return at
        ids, sizes = self.fresh(strings.filter(pa.array(new)))
        starts = len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.flat = np.concatenate([self.flat, ids])
        merged = np.concatenate([self.keys, keys[new]])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.sizes = np.concatenate([self.sizes, sizes]).astype(np.int32)[order]
        return np.searchsorted(self.keys, keys)
