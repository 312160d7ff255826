"""Texts cut into pieces that a tokenizer treats independently, each distinct piece encoded once.

A piece is known by the 64-bit hash of its bytes; a worker remembers a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidecast.llm.common import _BYTE, _ODD, _powers, mix

#: Pieces a worker remembers; beyond, it begins anew.
REMEMBERED = 600_000


def piece_hashes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of data[begin[i]:begin[i + 1]] for every i but the last of ``begin``."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    a, b = begin[:-1], begin[1:]
    return mix((total[b] - total[a]) * down[a] + np.uint64(_ODD) * (b - a).astype(np.uint64))


class PieceTable:
    """Encodings of pieces by hash: lengths, and the ids in one flat array."""

    def __init__(self, encode: Callable[[list[str]], list], keep_ids: bool, remember: int = REMEMBERED):
        self.encode = encode
        self.keep_ids = keep_ids
        self.remember = remember
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.lengths = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.int32)
        self.offsets = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _room(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if n > len(old):
            setattr(self, name, np.concatenate([old, np.zeros(max(n, 2 * len(old)) - len(old), old.dtype)]))

    def look_up(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Index of every piece of ``data``; new ones are encoded together."""
        distinct, first, inverse = np.unique(piece_hashes(data, begin), return_index=True, return_inverse=True)
        if len(self.at) + len(distinct) > self.remember:
            self._clear()
        keys = distinct.tolist()
        found = [self.at.get(k, -1) for k in keys]
        new = [i for i, x in enumerate(found) if x < 0]
        if new:
            raw = data.tobytes()
            spans = [(int(begin[first[i]]), int(begin[first[i] + 1])) for i in new]
            rows = self.encode([raw[a:b].decode("utf-8", "surrogatepass") for a, b in spans])
            n = len(self.at)
            self._room("lengths", n + len(new))
            lengths = np.array([len(r) for r in rows], np.int64)
            self.lengths[n : n + len(new)] = lengths
            if self.keep_ids:
                self._room("offsets", n + len(new))
                self._room("ids", self.used + int(lengths.sum()))
                self.offsets[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
                for r in rows:
                    self.ids[self.used : self.used + len(r)] = r
                    self.used += len(r)
            for j, i in enumerate(new):
                self.at[keys[i]] = found[i] = n + j
        return np.array(found, np.int64)[inverse]

    def ids_of(self, index: np.ndarray) -> np.ndarray:
        """The ids of the pieces of ``index``, one after another."""
        n = self.lengths[index]
        shift = self.offsets[index] - (np.cumsum(n) - n)
        return self.ids[np.repeat(shift, n) + np.arange(int(n.sum()))]


_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of all white space beyond ASCII
_WIDE = np.zeros(256, bool)
_WIDE[[0xE1, 0xE2, 0xE3]] = True
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def single_breaks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of single spaces and of single line feeds with no white space on either side.

    A neighbour whose first byte could begin white space beyond ASCII counts as white space.
    """
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at + 1 < len(data))]
    before, after = data[at - 1], data[at + 1]
    ok = ~_ASCII_SPACE[before] & ~_ASCII_SPACE[after] & ~_LEAD[after]
    far = before >= 0x80
    ok &= ~(far & ((data[np.maximum(at - 2, 0)] == 0xC2) | ((at >= 3) & _WIDE[data[np.maximum(at - 3, 0)]])))
    at = at[ok]
    return at[data[at] == 0x20], at[data[at] == 0x0A]
