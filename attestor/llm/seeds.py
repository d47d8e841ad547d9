"""Winnowed anchors and the joins around them, shared by the byte-wise and the word-wise duplicate removal.

A window of `span` units (bytes or words) holds span - k + 1 grams of k units; those with the smallest hash are its
anchors. The choice depends on the window's content only, so two equal windows choose equal anchors at equal
places: a window that repeats is found among the anchors that repeat (Schleimer, Wilkerson, Aiken, 2003).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U64, only, staged

_STEP = 1 << 18


def slide(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """best over x[i:i+width] for each i, by doubling."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def window_starts(first: np.ndarray, sizes: np.ndarray, span: int, n: int) -> np.ndarray:
    """Whether a window of span units that starts at a unit ends in the same document."""
    edge = np.zeros(n + 1, np.int32)
    fit = np.maximum(sizes - span + 1, 0)
    np.add.at(edge, np.minimum(first, n), 1)  # a document without a window can start behind the last gram
    np.add.at(edge, np.minimum(first + fit, n), -1)
    return np.cumsum(edge[:n]).astype(bool)


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions of the grams that are the smallest (all of a tie) in some valid window of `width` grams."""
    chosen, n = [], len(grams)
    for s in range(0, n, _STEP):
        low, high = max(0, s - width + 1), min(n, s + _STEP + width - 1)
        x = grams[low:high]
        if len(x) < width:
            continue
        least = slide(np.minimum, x, width)
        padded = np.zeros(len(least) + 2 * (width - 1), U64)
        padded[width - 1 : width - 1 + len(least)] = np.where(valid[low : low + len(least)], least, U64(0))
        top = slide(np.maximum, padded, width)
        found = np.flatnonzero((top == x) & (top > 0)) + low
        chosen.append(found[(found >= s) & (found < s + _STEP)])
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def slices(texts: list[bytes], margin: int, limit: int = CHUNK_BYTES) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Groups of (row, base, low, high, part), about `limit` bytes each: part is text[base:...], and positions from
    low to high of the text belong to it; the parts of a very long text overlap by `margin` on either side."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for low in range(0, max(1, len(text)), limit):
            high, base = min(len(text), low + limit), max(0, low - margin)
            part = text[base : high + margin] if len(text) > limit else text
            if held and size + len(part) > limit + 2 * margin:
                yield held
                held, size = [], 0
            held.append((row, base, low, high, part))
            size += len(part) + 1
    if held:
        yield held


def hits_by_document(anchors: DataFrame, repeated: DataFrame, name: str) -> DataFrame:
    """(doc_id, hs): the anchors of each document that repeat. Both sides are joined on the anchor's hash, which is
    pre-aggregated on one side and can be split on the other, so that an anchor in a third of all documents is no
    task of its own; a document's list is bounded by its text."""
    hits = only(anchors, repeated, "h").join(repeated, "h").groupBy("doc_id").agg(F.collect_list("h").alias("hs"))
    return staged(hits, name)
