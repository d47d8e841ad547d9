"""Edit similarity of strings: of one pair, and of many pairs side by side."""

from __future__ import annotations

import numpy as np

from .common import U64

#: Words of the letter tables of one step (8 MB), and pairs of one step.
TABLE_WORDS, STEP_PAIRS = 1 << 20, 4096
#: From so many pairs on, whose shorter strings differ in length by half at most, pairs are compared side by side.
SIDE_BY_SIDE = 48
ONE, FULL = U64(1), U64(0xFFFFFFFFFFFFFFFF)


def similar(a: str, b: str, percent: int) -> bool:
    """Whether 100 * (1 - distance / longer length) >= percent."""
    return within(a, b, (100 - percent) * max(len(a), len(b)) // 100)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is at most `most`: the columns of the distance table as bits of integers
    (Myers, 1999), given up as soon as the rest cannot make good for it."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= most
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, n = (1 << len(a)) - 1, len(b)
    up, down, get = full, 0, places.get
    for at in range(0, n, 32):
        for c in b[at : at + 32]:
            x = get(c, 0) | down
            same = ((x & up) + up ^ up) | x
            more = (down | full & ~(same | up)) << 1 | 1
            up, down = ((up & same) << 1 | ~(same | more)) & full, more & same
        k = min(at + 32, n)
        score = k + up.bit_count() - down.bit_count()  # the distance to the first k letters
        if score - (n - k) > most:
            return False
    return score <= most


def similar_pairs(forms: list[str], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """similar(forms[i], forms[j], percent) for arrays of places. Pairs whose shorter strings are of about one length are
    compared side by side; where there are few of them, one by one."""
    n = np.fromiter(map(len, forms), np.int64, len(forms))
    swap = n[i] > n[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    most = (100 - percent) * n[b] // 100
    out = np.zeros(len(a), bool)
    open_ = np.flatnonzero(n[b] - n[a] <= most)
    out[open_[n[a[open_]] == 0]] = True
    open_ = open_[n[a[open_]] > 0]
    open_ = open_[np.lexsort((b[open_], a[open_], n[a[open_]]))]
    size, codes, s = n[a[open_]], None, 0
    line = np.cumsum(np.diff(a[open_], prepend=-1) != 0)
    while s < len(open_):
        e = min(int(np.searchsorted(size, max(64, 3 * size[s] // 2), "right")), s + STEP_PAIRS)
        if e - s >= SIDE_BY_SIDE:
            if codes is None:
                letters, codes = _letters(forms)
                begin = np.cumsum(n) - n
            tables = max(1, TABLE_WORDS // (int((size[e - 1] + 63) // 64) * letters))
            e = min(e, int(np.searchsorted(line, line[s] + tables, "left")))
        own = open_[s:e]
        if e - s < SIDE_BY_SIDE:
            for k in own.tolist():
                out[k] = within(forms[a[k]], forms[b[k]], int(most[k]))
        else:
            row = line[s:e] - line[s]
            table = _table(codes, begin, n, a[own], row, int((size[e - 1] + 63) // 64), letters)
            out[own] = _columns(table, row * letters, size[s:e], codes, begin[b[own]], n[b[own]], most[own])
        s = e
    return out


def _letters(forms: list[str]) -> tuple[int, np.ndarray]:
    """How many letters there are, and the number of each letter of the strings, one string after the other."""
    codes = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32)
    number = np.zeros(int(codes.max()) + 1, np.int64)
    number[codes] = 1
    number = np.cumsum(number) - 1
    return int(number[-1]) + 1, number[codes]


def _table(codes: np.ndarray, begin: np.ndarray, n: np.ndarray, a: np.ndarray, line: np.ndarray, w: int, letters: int) -> np.ndarray:
    """For each machine word, line and letter the places of the letter in the line, as bits."""
    rows, first = np.unique(line, return_index=True)
    size = n[a[first]]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    code = codes[np.repeat(begin[a[first]], size) + place]
    out = np.zeros(w * len(rows) * letters, U64)
    np.bitwise_or.at(out, (place // 64 * len(rows) + np.repeat(rows, size)) * letters + code, ONE << (place % 64).astype(U64))
    return out.reshape(w, -1)


def _columns(table: np.ndarray, row: np.ndarray, na: np.ndarray, codes: np.ndarray, at: np.ndarray, nb: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the distances are at most `most`: columns of the distance table in blocks of 64 rows (Hyyrö, 2003), one
    pair an element. A step takes each block one column on, a block one column behind the block above it, whose carry it
    needs: then all blocks of all pairs are one operation. Only blocks that a distance of `most` can reach are computed:
    rows above and below count as growing by one, which is no less than they do. Every 16 steps pairs go that cannot
    make good any more: rows between the ends of two blocks, S and T, are (S + T - 64) / 2 at least."""
    out, blocks, top = np.zeros(len(row), bool), np.arange(len(table))[:, None], (na - 1) // 64
    order = np.argsort(-(nb + top), kind="stable")  # those that end first stand last
    row, at, nb, most, top = row[order], at[order], nb[order], most[order], top[order]
    end, reach, tall = nb + top, int(most.max()), len(table) - 1
    bottom = np.where(blocks == top, (na[order] - 1) % 64, 63).astype(U64)
    ups, downs = np.full(bottom.shape, FULL), np.zeros(bottom.shape, U64)
    plus, minus, letter = (np.zeros((tall + 2, len(row)), kind) for kind in (U64, U64, np.int64))
    score, flat, width = bottom.astype(np.int64) + 1, table.ravel(), table.shape[1]
    high, low = 0, -1  # the blocks computed in the step before
    for t in range(int(end[0])):
        live = int(np.searchsorted(-end, -t, "left"))  # end > t
        if live < len(row):
            out[order[live:]] = score[top[live:], np.arange(live, len(row))] <= most[live:]
        keep = None
        if t % 16 == 15:
            two = score[high : low + 1, :live].copy()
            two[1:] += score[high:low, :live]
            two[0] += t - 1 if high == 0 else two[0] - 63
            hope = ((two <= 2 * most[:live] + 67) & (blocks[high : low + 1] <= top[:live])).any(axis=0)
            hope |= top[:live] < high
            keep = np.flatnonzero(hope) if hope.sum() < 0.8 * live else None
        if keep is None and live < len(row):
            keep = slice(live)
        if keep is not None:
            order, row, at, nb, most, top, end = (x[keep] for x in (order, row, at, nb, most, top, end))
            bottom, ups, downs, plus, minus, letter, score = (np.ascontiguousarray(x[:, keep]) for x in (bottom, ups, downs, plus, minus, letter, score))
            if not len(row):
                return out
        before, high, new = high, max(0, (t - reach - 64) // 65 + 1), min(tall, t, (t + 1 + reach) // 65)
        if new > low and new:
            score[new] += score[new - 1] + (minus[new] - plus[new]).view(np.int64)
        low = new
        letter[high] = row + codes[np.minimum(at + (t - high), len(codes) - 1)]
        if high == before:  # else the block above has just had its last column, and this one still takes its carry
            plus[high], minus[high] = ONE, U64(0)
        w, below = slice(high, low + 1), slice(high + 1, low + 2)
        up, down, carry, borrow = ups[w], downs[w], plus[w], minus[w]
        eq = flat[letter[w] + blocks[w] * width]
        vertical = eq | down
        eq |= borrow
        across = eq & up
        across += up
        across ^= up
        across |= eq
        more, less = down | ~(across | up), up & across
        out_plus, out_minus = (more >> bottom[w]) & ONE, (less >> bottom[w]) & ONE
        more <<= ONE
        more |= carry
        less <<= ONE
        less |= borrow
        np.bitwise_or(less, ~(vertical | more), out=up)
        np.bitwise_and(more, vertical, out=down)
        score[w] += (out_plus - out_minus).view(np.int64)
        plus[below], minus[below] = out_plus, out_minus
        letter[below] = letter[w].copy()
    out[order] = score[top, np.arange(len(row))] <= most
    return out
