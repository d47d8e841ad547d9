"""MinHash near-duplicate groups with odd sketches, and the query op10.

Word shingles are hashed to 64 bits on whole Arrow batches. Equal sets collapse first (exact copies never meet in a
bucket). The distinct sets get a MinHash signature, whose bands are the join keys, and an odd sketch: the samples
folded into a bitmap of parities. The population count of two sketches' XOR estimates a high similarity closely
(Mitzenmacher, Pagh, Pham, 2014); a candidate far below the threshold is set aside there, all others are confirmed
on the full sets.

Defined cases: null, empty and white-space texts have no shingles, are linked with nothing and are kept; a text with
fewer words than a shingle is one shingle; rows that repeat a doc_id are one document and must repeat its text; an empty table gives
no rows; other columns are ignored and never clash, as only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, as_bytes, chunks, documents, gram_hashes, joined, list_array, mix, only, signed, spread, staged, word_hashes
from .graph import bucket_components, sides, spanning, tiles


@dataclass(frozen=True)
class NearDup:
    """shingle: words; percent: 100 * |A and B| >= percent * |A or B| links; bands x rows MinHash samples: a pair at
    0.8 shares no band with probability (1 - 0.8**rows)**bands, 1.4e-7; bits: of the odd sketch; slack: how far below
    the threshold, in standard errors, an estimate must be to spare a pair the full comparison."""

    shingle: int = 4
    percent: int = 80
    bands: int = 52
    rows: int = 6
    bits: int = 512
    slack: float = 7.0

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_flips(self) -> int:
        """The largest XOR count that a pair at the threshold shows, slack standard errors included."""
        j, k, z = self.percent / 100, self.samples, self.bits
        low = max(0.0, j - self.slack * math.sqrt(j * (1 - j) / k))
        p = (1 - (1 - 2 / z) ** (2 * k * (1 - low))) / 2
        return min(z, math.ceil(z * p + self.slack * math.sqrt(z * p * (1 - p))))


PRODUCTION = NearDup()
#: Bounds of a tile of sets that are compared in one task.
TILE_SHINGLES, TILE_SETS, TILE_COLUMNS = 1_000_000, 2000, 4096


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased first."""
    for a, b in chunks(texts):
        buf, begin = joined(texts[a:b])
        starts, _, hashes = word_hashes(buf, lower=True)
        first = np.searchsorted(starts, begin)
        grams = gram_hashes(hashes, k)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= k:
                yield np.unique(grams[first[i] : first[i + 1] - k + 1])
            elif n:
                yield mix(gram_hashes(hashes[first[i] : first[i + 1]], int(n)) + U64(n))
            else:
                yield np.empty(0, U64)


class Sampler:
    """MinHash samples, band keys and odd sketch of a set."""

    def __init__(self, p: NearDup):
        rng = np.random.default_rng(1997)
        self.p = p
        self.mul = rng.integers(0, 2**32, p.samples, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, p.samples, dtype=np.uint32)
        self.salt = mix(np.arange(1, p.samples + 1, dtype=U64))
        self.band = mix(np.arange(101, p.bands + 101, dtype=U64))

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = np.full(self.p.samples, 0xFFFFFFFF, np.uint32)
        x = (shingles >> U64(32)).astype(np.uint32)
        for i in range(0, len(x), 256):
            block = np.multiply.outer(x[i : i + 256], self.mul)
            block += self.add
            np.minimum(low, block.min(axis=0), out=low)
        drawn = mix(low.astype(U64) ^ self.salt)
        keys = gram_keys(drawn.reshape(self.p.bands, self.p.rows)) ^ self.band
        odd = np.bincount((drawn % U64(self.p.bits)).astype(np.int64), minlength=self.p.bits) & 1
        return mix(keys), np.packbits(odd.astype(np.uint8)).tobytes()


def gram_keys(rows: np.ndarray) -> np.ndarray:
    out = rows[:, 0].copy()
    for j in range(1, rows.shape[1]):
        out = out * U64(0xC2B2AE3D27D4EB4F) + rows[:, j]
    return mix(out)


def _draw(p: NearDup) -> Callable:
    """(doc_id, text) -> (doc_id, n, s1, s2, keys, sketch): size of the set, a 128-bit name of it, bands, odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(p)
        for batch in batches:
            n, s1, s2, keys, sketches = [], [], [], [], []
            for s in shingle_sets(as_bytes(batch.column(1)), p.shingle):
                k, sketch = sampler(s) if len(s) else (np.empty(0, U64), b"")
                n.append(len(s))
                s1.append(int(s.sum(dtype=U64)))
                s2.append(int(mix(s + U64(7)).sum(dtype=U64)))
                keys.append(signed(k))
                sketches.append(sketch)
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            lists = list_array(flat, np.fromiter(map(len, keys), np.int64, len(keys)))
            two = [pa.array(signed(np.array(x, U64))) for x in (s1, s2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *two, lists, pa.array(sketches, pa.binary())],
                ["doc_id", "n", "s1", "s2", "keys", "sketch"],
            )

    return run


def _sets(p: NearDup) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), batch.column(0)
            done, held, counts = 0, [], []
            for s in shingle_sets(texts, p.shingle):
                held.append(signed(s))
                counts.append(len(s))
                if sum(counts) > 1 << 20:
                    yield _listed(ids.slice(done, len(counts)), held, counts)
                    done, held, counts = done + len(counts), [], []
            if counts:
                yield _listed(ids.slice(done, len(counts)), held, counts)

    return run


def _listed(ids: pa.Array, held: list[np.ndarray], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, list_array(pa.array(np.concatenate(held)), np.array(counts))], ["id", "shingles"]
    )


def _hopeful(p: NearDup) -> Callable:
    """Two tiles of (hub, id, c, tile, sketch) -> the (hub, id) whose sketch is near that of one of another group."""

    def run(table: pa.Table) -> pa.Table:
        ids, group, tile = (table.column(x).to_numpy() for x in ("id", "c", "tile"))
        words = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        x, y = sides(tile)
        hit = np.zeros(len(ids), bool)
        for i in range(0, len(x), 128):
            part = x[i : i + 128]
            flips_ = np.bitwise_count(words[part][:, None, :] ^ words[y][None, :, :]).sum(axis=2, dtype=np.int32)
            near = (flips_ <= p.most_flips()) & (group[part][:, None] != group[y][None, :])
            hit[part] |= near.any(axis=1)
            hit[y] |= near.any(axis=0)
        hub = table.column("hub").to_numpy()
        return pa.table({"hub": hub[hit], "id": ids[hit]})

    return run


def _compare(p: NearDup) -> Callable:
    """Two tiles of (id, c, tile, shingles) -> (a, b): links that connect all linked sets of different groups."""

    def run(table: pa.Table) -> pa.Table:
        ids, group, tile = (table.column(x).to_numpy() for x in ("id", "c", "tile"))
        lists = table.column("shingles").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), n)
        _, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        shared = np.bincount(column) > 1
        row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        x, y = sides(tile)
        both = np.zeros((len(x), len(y)), np.float32)
        for c in range(0, int(shared.sum()), TILE_COLUMNS):
            a, b = np.searchsorted(column, (c, c + TILE_COLUMNS))
            has = np.zeros((len(ids), TILE_COLUMNS), np.float32)
            has[row[a:b], column[a:b] - c] = 1
            both += has[x] @ has[y].T
        both = both.astype(np.int64)
        linked = (100 + p.percent) * both >= p.percent * (n[x][:, None] + n[y][None, :])
        linked &= group[x][:, None] != group[y][None, :]
        i, j = np.nonzero(linked)
        ends = spanning(group, x[i], y[j], lambda i, j: np.ones(len(i), bool))
        return pa.table({"a": ids[ends[:, 0]], "b": ids[ends[:, 1]]})

    return run


def flips(a: str, b: str, bits: int):
    """Population count of the XOR of two sketches (binary columns)."""
    word = lambda c, i: F.conv(F.hex(F.substring(c, 4 * i + 1, 4)), 16, 10).cast("long")
    total = F.lit(0)
    for i in range(bits // 32):
        total = total + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
    return total


def near_groups(docs: DataFrame, p: NearDup = PRODUCTION) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, s1 long, s2 long, keys array<long>, sketch binary"
    drawn = staged(docs.mapInArrow(_draw(p), schema), "op10-drawn")
    named = drawn.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n")).alias("s")).select("doc_id", "s.*")
    of_set = drawn.where("n > 0").groupBy("s1", "s2", "n").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    first = named.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"))
    first = staged(first.join(of_set, ["s1", "s2", "n"]), "op10-first")

    def full_sets(ids: DataFrame) -> DataFrame:
        texts = only(docs, ids, "doc_id").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return texts.mapInArrow(_sets(p), "id long, shingles array<long>")

    def across(open_: DataFrame) -> DataFrame:
        """The links between groups of a hub's members, by exact counts in tiles of bounded size: each two tiles of a
        hub's members meet in one task, which counts common shingles by a matrix product and gives out links only."""
        open_ = open_.select("hub", "id", "c", F.col("info").alias("n"))
        near = tiles(open_.join(first.select("id", "sketch"), "id"), F.lit(1), TILE_SETS, TILE_SETS)
        hopeful = spread(near, "hub", "p", "q").groupBy("hub", "p", "q").applyInArrow(_hopeful(p), "hub long, id long").distinct()
        hopeful = staged(hopeful, "op10-hopeful")  # others have no estimate near the threshold: their sets stay at home
        sets = full_sets(hopeful.select(F.col("id").alias("doc_id")).distinct())
        met = tiles(open_.join(hopeful, ["hub", "id"], "left_semi"), F.col("n"), TILE_SHINGLES, TILE_SETS).join(sets, "id")
        return spread(met, "hub", "p", "q").groupBy("hub", "p", "q").applyInArrow(_compare(p), "a long, b long").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.where(f"100 * least(ia, ib) >= {p.percent} * greatest(ia, ib)")
        x = first.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
        y = first.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
        near = near.join(x, "a").join(y, "b").where(flips("sa", "sb", p.bits) <= p.most_flips())
        near = staged(near.select("a", "b", F.col("ia").alias("na"), F.col("ib").alias("nb")), "op10-near")
        sets = staged(full_sets(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()), "op10-full")
        full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
        full = full.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
        full = full.withColumn("both", F.size(F.array_intersect("xa", "xb")).cast("long"))
        return full.where(f"100 * both >= {p.percent} * (na + nb - both)").select("a", "b")

    buckets = first.select(F.explode(F.array_distinct("keys")).alias("key"), "id", F.col("n").alias("info"))
    groups = bucket_components(buckets, verify, across, "op10")
    groups = first.select("s1", "s2", "n", "id").join(groups, F.col("id") == F.col("node"), "left")
    rep = groups.select("s1", "s2", "n", F.coalesce("component", "id").alias("component_id"))
    return named.join(rep, ["s1", "s2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
