"""Substring removal by seeds and extension over words, and the query op3.

Seeds are winnowed word grams, joined across documents on their hash. A seed that occurs in two documents is extended
both ways: every way to split the missing words of a minimal window between its left and its right side gives one
extension, named by the hash of the window; equal extensions of one seed are equal windows. Their smallest document
decides, and adjacent windows merge into the maximal repeat. Occurrences with the same surroundings are one context,
extended once, so that copies of a passage, however many, meet as counts and never as pairs.

Defined cases: null and empty texts have no words, and the hash of their kept words is that of no bytes; a text
shorter than a window loses nothing; a window that repeats inside one document only stays; of equal documents the
one with the smallest doc_id keeps its words. Rows that repeat a doc_id are one document and must repeat its text;
one row is returned for it. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, chunks, documents, gram_hashes, joined, left_join_some, list_array, mix, only, signed, staged, word_hashes, word_spans
from .seeds import hits_by_document, window_starts, winnow

WINDOW, SEED = 13, 4


def _layout(texts: list[bytes], window: int, seed: int):
    """Word hashes of a chunk, first word of each text, positions of the anchors, and the grams."""
    buf, begin = joined(texts)
    starts, ends, hashes = word_hashes(buf)
    first = np.searchsorted(starts, begin)
    grams = gram_hashes(hashes, seed)
    valid = window_starts(first[:-1], np.diff(first), window, len(hashes))
    return hashes, first, grams, winnow(grams, valid, window - seed + 1)


def _anchors(window: int, seed: int) -> Callable:
    """(doc_id, text) -> (h, doc_id), once for each anchor hash of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), np.asarray(batch.column(0))
            for a, b in chunks(texts):
                _, first, grams, at = _layout(texts[a:b], window, seed)
                doc = np.searchsorted(first, at, "right") - 1
                keys = np.unique(np.rec.fromarrays([doc, grams[at]], names="d,h")) if len(at) else None
                if keys is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.ascontiguousarray(keys.h))), pa.array(ids[a:b][keys.d])], ["h", "doc_id"]
                    )

    return run


def _occurrences(window: int, seed: int, full: bool) -> Callable:
    """(doc_id, text, hs, at) -> the repeated anchors: (h, c, doc_id, pos, fits) with their context's name and a bit
    for each way in which a window fits around them; or, if full, only those that stand at the places `at`, as
    (h, c, x, exts) with their document and the hash of each of these windows (0: there is none)."""
    width = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), np.asarray(batch.column(0))
            wanted = batch.column(2)
            for a, b in chunks(texts):
                hashes, first, grams, at = _layout(texts[a:b], window, seed)
                doc = np.searchsorted(first, at, "right") - 1
                chosen = np.zeros(len(at), bool)
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(b - a):
                    x, y = edge[i], edge[i + 1]
                    if x < y:
                        own = np.asarray(wanted[a + i].values)
                        chosen[x:y] = np.isin(at[x:y] - first[i] if full else signed(grams[at[x:y]]), own)
                at, doc = at[chosen], doc[chosen]
                if not len(at):
                    continue
                whole = np.append(gram_hashes(hashes, window), np.zeros(1, np.uint64))
                exts = np.zeros((len(at), width), np.uint64)
                for j in range(width):
                    s = at - j
                    fits = (s >= first[doc]) & (s + window <= first[doc + 1])
                    exts[fits, j] = whole[s[fits]] | np.uint64(1)
                name = exts[:, 0].copy()
                for j in range(1, width):
                    name = mix(name + np.uint64(j)) ^ exts[:, j]
                h, c = pa.array(signed(grams[at])), pa.array(signed(mix(name)))
                if full:
                    lists = list_array(pa.array(signed(exts.reshape(-1))), np.full(len(at), width))
                    yield pa.RecordBatch.from_arrays([h, c, pa.array(ids[a:b][doc]), lists], ["h", "c", "x", "exts"])
                else:
                    bits = ((exts != 0) * (1 << np.arange(width))).sum(axis=1).astype(np.int32)
                    pos = pa.array((at - first[doc]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([h, c, pa.array(ids[a:b][doc]), pos, pa.array(bits)], ["h", "c", "doc_id", "pos", "fits"])

    return run


def _removed(window: int) -> Callable:
    """(doc_id, text, pos, mask) -> the result's rows; bit j of mask: the window that starts j words before pos goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pos, masks = as_bytes(batch.column(1)), batch.column(2), batch.column(3)
            n_words, n_removed, digests = [], [], []
            for a, b in chunks(texts):
                buf, begin = joined(texts[a:b])
                starts, ends = word_spans(buf)
                first = np.searchsorted(starts, begin)
                edge = np.zeros(len(starts) + 1, np.int32)
                for i in range(b - a):
                    if pos[a + i].is_valid and len(pos[a + i].values):
                        at, mask = np.asarray(pos[a + i].values), np.asarray(masks[a + i].values)
                        for j in range(int(mask.max()).bit_length()):
                            s = first[i] + at[(mask >> j) & 1 == 1] - j
                            np.add.at(edge, s, 1)
                            np.add.at(edge, s + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = ~gone
                out = np.append(buf, np.uint8(32))
                show = np.zeros(len(out) + 1, np.int8)
                show[starts[kept]] = 1
                show[ends[kept] + 1] -= 1
                out[ends] = 32
                shown = np.cumsum(show[:-1], dtype=np.int8).view(bool)
                lengths = np.concatenate(([0], np.cumsum(np.where(kept, ends - starts + 1, 0))))
                left, cut = out[shown], np.concatenate(([0], np.cumsum(gone)))
                for i in range(b - a):
                    x, y = lengths[first[i]], lengths[first[i + 1]]
                    n_words.append(int(first[i + 1] - first[i]))
                    n_removed.append(int(cut[first[i + 1]] - cut[first[i]]))
                    digests.append(hashlib.sha256(left[x : max(x, y - 1)].data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, pos, mask): for each document the seeds whose extensions repeat from a document with a smaller id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = window - seed + 1
    anchors = docs.mapInArrow(_anchors(window, seed), "h long, doc_id long")
    repeated = anchors.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("h")
    hits = hits_by_document(anchors, repeated, "op3-hits")
    found = only(docs, hits, "doc_id").join(hits, "doc_id").select("doc_id", "text", "hs")
    found = staged(found.mapInArrow(_occurrences(window, seed, False), "h long, c long, doc_id long, pos int, fits int"), "op3-seen")
    contexts = found.groupBy("h", "c").agg(F.min(F.struct("doc_id", "pos", "fits")).alias("x"))
    contexts = staged(contexts.select("h", "c", F.col("x.doc_id").alias("x"), "x.pos", "x.fits"), "op3-contexts")
    contexts = contexts.join(contexts.groupBy("h").agg(F.count("*").alias("ways")), "h")
    places = contexts.where("ways > 1").groupBy(F.col("x").alias("doc_id")).agg(F.collect_list("pos").alias("at"))
    named = only(docs, places, "doc_id").join(places, "doc_id").select("doc_id", "text", "at")
    named = named.mapInArrow(_occurrences(window, seed, True), "h long, c long, x long, exts array<long>")
    # one shuffle by the seed serves both groupings; what a seed has here are its distinct contexts, not its copies
    mixed = named.select("h", "c", "x", F.posexplode("exts").alias("j", "w")).where("w <> 0").repartition("h")
    mixed = mixed.withColumn("low", F.min("x").over(Window.partitionBy("h", "w")))
    met = mixed.groupBy("h", "c").agg(*[F.max(F.when(F.col("j") == j, F.col("low"))).alias(f"m{j}") for j in range(width)])
    alone = contexts.where("ways = 1").select(
        "h", "c", *[F.when(F.col("fits").bitwiseAND(1 << j) != 0, F.col("x")).alias(f"m{j}") for j in range(width)]
    )
    decided = staged(met.unionByName(alone), "op3-decided")
    mask = F.lit(0)
    for j in range(width):
        mask = mask + F.when(F.col(f"m{j}") < F.col("doc_id"), F.lit(1 << j)).otherwise(0)
    marks = found.select("h", "c", "doc_id", "pos").join(decided, ["h", "c"]).select("doc_id", "pos", mask.alias("mask"))
    marks = marks.where("mask <> 0").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "mask")).alias("marks"))
    return staged(marks.select("doc_id", "marks.pos", "marks.mask"), "op3-marks")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = repeats(docs, window, seed)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    out = left_join_some(docs, marks, "doc_id").select("doc_id", "text", "pos", "mask").mapInArrow(_removed(window), schema)
    return out.dropDuplicates(["doc_id"])


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
