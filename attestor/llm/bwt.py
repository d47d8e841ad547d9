"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes in external files.

Each round inserts one more symbol of every string that has one left, from the last to the first (Bauer, Cox,
Rosone, 2013), and updates the longest common prefixes with it (Cox, Garofalo, Rosone, Sciortino, 2016). The transform
and the prefixes lie in two files that a round reads once from start to end and writes anew; in memory there is one
block of them, one number a symbol, and a few numbers a string.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
#: Symbol of a row whose string has no further symbol.
END = 0


class Columns:
    """The transform of a growing collection.

    depths: the common prefix of each string's start row with the one before, in sorted order of the start rows (all
    0 for distinct end marks; larger where the strings' tails are known already). Symbols are 1 to 256.
    """

    def __init__(self, depths: np.ndarray, first: np.ndarray, cap: int, block: int = BLOCK):
        self.dir = tempfile.TemporaryDirectory(prefix="bwt-")
        self.block, self.cap, self.round = block, cap, 0
        self.m = len(depths)
        self.rows = np.arange(self.m)  # of each string's latest suffix
        self._path = os.path.join(self.dir.name, "0")
        first.astype(np.uint16).tofile(self._path + ".b")
        np.minimum(depths, cap).astype(np.uint16).tofile(self._path + ".l")
        self.size = self.m
        self.symbols = first.astype(np.int64)
        self.totals = np.bincount(self.symbols, minlength=258)

    def close(self) -> None:
        self.dir.cleanup()

    def _blocks(self, suffix: str) -> Iterator[np.ndarray]:
        with open(self._path + suffix, "rb") as f:
            while len(x := np.fromfile(f, np.uint16, self.block)):
                yield x

    def insert(self, following: np.ndarray) -> np.ndarray:
        """One round: each string whose row shows a symbol gets the suffix that begins with it; following: the symbol
        before that suffix, or END. Returns the strings that got one, with their common prefixes with the rows before
        and after, as (string, before, after)."""
        live = np.flatnonzero(self.symbols)
        order = live[np.argsort(self.rows[live], kind="stable")]
        at, sym = self.rows[order], self.symbols[order]
        base = self.m + np.concatenate(([0], np.cumsum(self.totals[1:])))  # first row of symbol 1, 2, ...
        rank, before = np.empty(len(order), np.int64), np.zeros(len(order), np.int64)
        after_row, after_val = [], []  # rows of the old transform's images whose prefix changes, and the new values
        seen = np.zeros(258, np.int64)
        carry = np.zeros(258, np.int64)  # least common prefix since a symbol was last seen
        was_open = np.zeros(258, bool)  # whether that last one got a suffix in this round
        offset = 0
        for b, depth in zip(self._blocks(".b"), self._blocks(".l")):
            n = len(b)
            lo, hi = np.searchsorted(at, (offset, offset + n))
            is_open = np.zeros(n, bool)
            is_open[at[lo:hi] - offset] = True
            counts = np.bincount(b, minlength=258)
            present = np.flatnonzero(counts)
            head = np.cumsum(counts[present]) - counts[present]
            by = np.argsort(b.astype(np.uint8) if present[-1] < 256 else b, kind="stable")
            mine = is_open[by]
            after_open = np.empty(n, bool)
            after_open[1:] = mine[:-1]
            after_open[head] = was_open[present]
            mine |= after_open
            need = np.flatnonzero(mine[counts[END] :]) + counts[END]
            group = np.searchsorted(head, need, "right") - 1
            row, c = by[need], present[group]
            prev = np.where(need > head[group], by[need - 1], -1)
            least = range_min(depth, prev + 1, row)
            crossing = prev < 0
            least[crossing] = np.where(seen[c[crossing]] > 0, np.minimum(least[crossing], carry[c[crossing]]), -1)
            value = np.minimum(least + 1, self.cap)
            image = base[c - 1] + seen[c] + need - head[group]
            own = is_open[row]
            where = np.searchsorted(at[lo:hi], row[own] + offset) + lo
            rank[where], before[where] = image[own], value[own]
            after_row.append(image[~own])
            after_val.append(value[~own])
            seen += counts
            offset += n
            if offset < self.size:
                low_since = np.append(np.minimum.accumulate(depth[::-1])[::-1], depth.dtype.type(self.cap))
                carry = np.minimum(carry, int(depth.min()))
                last = by[head + counts[present] - 1]
                carry[present] = low_since[last + 1]
                was_open[present] = is_open[last]
        ended = np.flatnonzero(self.symbols == END)  # their rows move down by the new rows above them
        above = np.sort(rank) - np.arange(len(rank))
        self.rows[ended] += np.searchsorted(above, self.rows[ended], "right")
        self._write(order, rank, before, following, np.concatenate(after_row), np.concatenate(after_val))
        self.rows[order] = rank
        self.symbols[:] = END
        self.symbols[order] = following[order]
        self.totals += np.bincount(following[order], minlength=258)
        return order, before, self._after(rank)

    def _write(self, order, rank, before, following, changed, values) -> None:
        """Images above are rows of the matrix with this round's rows in it; copy the old rows around the new ones."""
        path = os.path.join(self.dir.name, str(self.round % 2 + 1))
        by = np.argsort(rank, kind="stable")
        new_rows, new_sym, new_dep = rank[by], following[order][by], before[by]
        by = np.argsort(changed, kind="stable")
        changed, values = changed[by], values[by]
        total, done = self.size + len(order), 0
        with open(path + ".b", "wb") as fb, open(path + ".l", "wb") as fl, open(self._path + ".b", "rb") as ob, open(self._path + ".l", "rb") as ol:
            while done < total:
                n = min(self.block, total - done)
                lo, hi = np.searchsorted(new_rows, (done, done + n))
                old = np.ones(n, bool)
                old[new_rows[lo:hi] - done] = False
                b, depth = np.empty(n, np.uint16), np.empty(n, np.uint16)
                b[old], depth[old] = np.fromfile(ob, np.uint16, n - (hi - lo)), np.fromfile(ol, np.uint16, n - (hi - lo))
                x, y = np.searchsorted(changed, (done, done + n))
                depth[changed[x:y] - done] = values[x:y]
                b[~old], depth[~old] = new_sym[lo:hi], new_dep[lo:hi]
                b.tofile(fb)
                depth.tofile(fl)
                done += n
        self._path, self.size, self.round = path, total, self.round + 1

    def _after(self, rank: np.ndarray) -> np.ndarray:
        """Common prefix of each row with the next one (0 at the end)."""
        out, offset = np.zeros(len(rank), np.int64), 0
        order = np.argsort(rank, kind="stable")
        wanted = rank[order] + 1
        for depth in self._blocks(".l"):
            lo, hi = np.searchsorted(wanted, (offset, offset + len(depth)))
            out[order[lo:hi]] = depth[wanted[lo:hi] - offset]
            offset += len(depth)
        return out

    def transform(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols and common prefixes; for tests and small collections."""
        return tuple(np.concatenate([*self._blocks(x), np.empty(0, np.uint16)]) for x in (".b", ".l"))


def range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(x[low..high]), ends included."""
    if not len(low):
        return np.empty(0, np.int64)
    order = np.argsort(low, kind="stable")
    pairs = np.empty(2 * len(low), np.int64)
    pairs[::2], pairs[1::2] = low[order], high[order] + 1
    padded = np.append(x, x.dtype.type(0))
    out = np.empty(len(low), np.int64)
    out[order] = np.minimum.reduceat(padded, pairs)[::2]
    return out


def build(strings: list[bytes], cap: int, depths: np.ndarray | None = None, block: int = BLOCK, each=None) -> Columns:
    """Insert the strings column by column, last symbol first. each(string, round, before, after) sees every round."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum(sizes)

    def symbol(k: int) -> np.ndarray:
        """The k-th symbol from the end."""
        has = sizes > k
        out = np.zeros(len(strings), np.int64)
        out[has] = flat[end[has] - 1 - k].astype(np.int64) + 1
        return out

    columns = Columns(np.zeros(len(strings), np.int64) if depths is None else depths, symbol(0), cap, block)
    for k in range(1, int(sizes.max(initial=0)) + 1):
        got = columns.insert(symbol(k))
        if each:
            each(got[0], k, got[1], got[2])
    return columns
