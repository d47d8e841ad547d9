"""Removal of repeated byte strings with a column-wise suffix order, and the query op2.

Winnowed anchors of 144 bytes find, over the whole collection, the places at which a 200-byte string can repeat. An
anchor's occurrences with equal surroundings are one context: a context that occurs twice repeats as a whole. The
other contexts of a repeated anchor go to a task by the anchor's hash, where their right sides and then their left
sides are inserted column by column into the collection's Burrows-Wheeler transform, whose common prefixes tell how
far each context agrees with its nearest neighbours (bwt.py). Only distinct contexts are sorted, so that copies,
however many, cost a count.

Defined cases: null is empty; a text shorter than the string length loses nothing; a string that overlaps its own
repeat counts. A row that repeats a doc_id and its text is one more copy of it, and one row is returned for the id. An
empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import build, range_min
from .common import U64, as_bytes, documents, joined, left_join_some, mix, only, prefix_hash, signed, span_hash, staged
from .seeds import hits_by_document, slices, window_starts, winnow

LENGTH, ANCHOR = 200, 144
#: Bytes of text a vectorised step works on here: its arrays stay in the processor's cache.
SLICE = 1 << 16


def _layout(group, length: int, anchor: int):
    """Buffer of a group of slices, its prefix hashes, and the anchors that belong to the slices: (slice, place)."""
    buf, begin = joined([x[4] for x in group])
    sums = prefix_hash(buf)
    n = len(buf) - anchor + 1
    if n <= 0:
        return buf, begin, sums, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    starts = np.arange(n)
    grams = mix(span_hash(sums, starts, starts + anchor))
    sizes = np.diff(begin) - 1
    at = winnow(grams, window_starts(begin[:-1], sizes, length, n), length - anchor + 1)
    part = np.searchsorted(begin, at, "right") - 1
    base, low, high = (np.array([x[i] for x in group], np.int64) for i in (1, 2, 3))
    place = base[part] + at - begin[part]
    own = (place >= low[part]) & (place < high[part])
    return buf, begin, sums, at[own], part[own], grams[at[own]]


def _anchors(length: int, anchor: int) -> Callable:
    """(doc_id, text) -> (h, doc_id, n): how often an anchor occurs in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), np.asarray(batch.column(0))
            for group in slices(texts, 2 * length, SLICE):
                _, _, _, at, part, h = _layout(group, length, anchor)
                if not len(at):
                    continue
                row = np.array([x[0] for x in group])[part]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))))
                n = np.diff(np.append(head, len(h)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h[head])), pa.array(ids[row[head]]), pa.array(n.astype(np.int32))], ["h", "doc_id", "n"]
                )

    return run


def _contexts(length: int, anchor: int) -> Callable:
    """(doc_id, text, hs) -> (h, c, doc_id, pos, before, behind): repeated anchors with the name and the reach of
    their surroundings."""
    reach = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, wanted = as_bytes(batch.column(1)), np.asarray(batch.column(0)), batch.column(2)
            for group in slices(texts, 2 * length, SLICE):
                buf, begin, sums, at, part, h = _layout(group, length, anchor)
                row = np.array([x[0] for x in group])[part]
                keep = np.zeros(len(at), bool)
                edge = np.searchsorted(part, np.arange(len(group) + 1))
                for i, x in enumerate(group):
                    a, b = edge[i], edge[i + 1]
                    if a < b:
                        keep[a:b] = np.isin(signed(h[a:b]), np.asarray(wanted[x[0]].values))
                at, part, h, row = at[keep], part[keep], h[keep], row[keep]
                if not len(at):
                    continue
                start = np.maximum(begin[part], at - reach)
                end = np.minimum(begin[part + 1] - 1, at + anchor + reach)
                before, behind = at - start, end - at - anchor
                c = mix(span_hash(sums, start, end) + (before * 512 + behind).astype(U64))
                base = np.array([x[1] for x in group], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(h)),
                        pa.array(signed(c)),
                        pa.array(ids[row]),
                        pa.array(base[part] + at - begin[part]),
                        pa.array(before.astype(np.int32)),
                        pa.array(behind.astype(np.int32)),
                    ],
                    ["h", "c", "doc_id", "pos", "before", "behind"],
                )

    return run


def _cut(anchor: int) -> Callable:
    """(doc_id, text, places of (h, c, pos, before, behind)) -> (h, c, left, right): the bytes around the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            h, c, left, right = [], [], [], []
            for text, places in zip(texts, batch.column(2).to_pylist()):
                for x in places:
                    p = x["pos"]
                    h.append(x["h"])
                    c.append(x["c"])
                    left.append(text[p - x["before"] : p])
                    right.append(text[p + anchor : p + anchor + x["behind"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                ["h", "c", "left", "right"],
            )

    return run


def _ordered(length: int, anchor: int) -> Callable:
    """(h, c, left, right) -> (h, c, far, near): the first and last byte before the anchor at which a repeated string
    starts; contexts without one are left out. All contexts of an anchor are in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        h, c = (table.column(x).to_numpy() for x in ("h", "c"))
        left, right = (table.column(x).to_pylist() for x in ("left", "right"))
        found = far_near(h, c, left, right, length, anchor)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["h", "c", "far", "near"])

    return run


def far_near(h, c, left: list[bytes], right: list[bytes], length: int, anchor: int):
    m = len(h)
    columns = build(right, length)
    try:  # the right sides in order, and the common prefix of neighbours
        _, depth = columns.transform()
        order = np.argsort(columns.rows, kind="stable")
        rows = columns.rows[order]
        lcp = np.zeros(m, np.int64)
        lcp[1:] = range_min(depth, rows[:-1] + 1, rows[1:])
    finally:
        columns.close()
    by = np.argsort(h[order], kind="stable")  # by anchor, then right side
    first = np.concatenate(([True], h[order][by][1:] != h[order][by][:-1]))
    start = order[by]
    depths = np.zeros(m, np.int64)
    # neighbours of one anchor may have had strings of other anchors between them: take the least prefix of the stretch
    low = np.concatenate((by[:-1] + 1, [0]))
    inner = np.flatnonzero(~first)
    if len(inner):
        depths[inner] = anchor + range_min(lcp, low[inner - 1], by[inner])
    far, near = np.full(m, -1, np.int64), np.full(m, -1, np.int64)

    def mark(strings, k, before, after):
        hit = strings[np.maximum(before, after) >= length]
        far[start[hit]] = k
        near[start[hit]] = np.where(near[start[hit]] < 0, k, near[start[hit]])

    mark(np.arange(m), 0, depths, np.append(depths[1:], 0))
    build([left[i] for i in start], length, depths, each=mark).close()
    hit = far >= 0
    return h[hit], c[hit], far[hit].astype(np.int32), near[hit].astype(np.int32)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans of (s, e)) -> the result's rows."""
    for batch in batches:
        texts = as_bytes(batch.column(1))
        n_removed, n_spans, digests = [], [], []
        for text, spans in zip(texts, batch.column(2)):
            if not spans.is_valid:
                n_removed.append(0)
                n_spans.append(0)
                digests.append(hashlib.sha256(text).hexdigest())
                continue
            s, e = (np.sort(np.asarray(spans.values.field(i)).astype(np.int64)) for i in (0, 1))
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, s, 1)
            np.add.at(edge, e, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].data).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array(digests, pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, spans array of (s, e)): bytes of each document that repeated strings cover; spans may overlap."""
    anchors = docs.mapInArrow(_anchors(length, anchor), "h long, doc_id long, n int")
    repeated = anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    hits = hits_by_document(anchors.select("h", "doc_id"), repeated, "op2-hits")
    seen = only(docs, hits, "doc_id").join(hits, "doc_id").select("doc_id", "text", "hs")
    schema = "h long, c long, doc_id long, pos long, before int, behind int"
    seen = staged(seen.mapInArrow(_contexts(length, anchor), schema), "op2-seen")
    one = F.min(F.struct("doc_id", "pos", "before", "behind")).alias("x")
    contexts = staged(seen.groupBy("h", "c").agg(F.count("*").alias("n"), one), "op2-contexts")
    whole = contexts.where(f"n > 1 and x.before + x.behind >= {length - anchor}").select(
        "h", "c", F.col("x.before").alias("far"), F.greatest(F.lit(0), F.lit(length - anchor) - F.col("x.behind")).alias("near")
    )
    ways = contexts.groupBy("h").agg(F.count("*").alias("ways")).where("ways > 1")
    mixed = contexts.join(ways.select("h"), "h").select("h", "c", "x.*")
    places = mixed.groupBy("doc_id").agg(F.collect_list(F.struct("h", "c", "pos", "before", "behind")).alias("places"))
    cut = only(docs, places, "doc_id").join(places, "doc_id").select("doc_id", "text", "places")
    cut = cut.mapInArrow(_cut(anchor), "h long, c long, left binary, right binary")
    partial = cut.repartition("h").mapInArrow(_ordered(length, anchor), "h long, c long, far int, near int")
    single = contexts.where("n = 1").select("h", "c")
    partial = partial.join(single, ["h", "c"], "left_semi")
    decided = staged(whole.unionByName(partial), "op2-decided")
    marks = seen.join(decided, ["h", "c"]).select(
        "doc_id", (F.col("pos") - F.col("far")).alias("s"), (F.col("pos") - F.col("near") + length).alias("e")
    )
    return staged(marks.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "op2-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spans(docs, length, anchor)
    out = left_join_some(docs, found, "doc_id").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return out.mapInArrow(_removed, schema).dropDuplicates(["doc_id"])


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
