"""What the training-data operators share: staged tables, the documents reader and vectorised word hashing.

Python stages work on whole Arrow batches: the UTF-8 bytes of many documents are one numpy buffer, words are
found and hashed without a loop over words, and buffers are cut so that a worker holds a few MB at a time.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step works on; temporaries take about 60 times as much.
CHUNK_BYTES = 1 << 17
#: The ASCII white space that ends a word.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEY = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = U64(0x9E3779B97F4A7C15)
_WORD_BASE = U64(0xC2B2AE3D27D4EB4F)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. Only on a local master (tests), where there is one machine, may the session
    name none; elsewhere that is an error, as tables in an executor's own folder would be lost."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestor-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/attestor/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the prefilter of `only`: 1024 bitmaps of 4 KB, 4 MB as numbers, whatever the data are.
FILTER_BITS = 1 << 25


def only(table: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table whose keys may be in ids; a prefilter for a join that would shuffle all of a large table.

    The ids are hashed into a bitmap of fixed size, which is broadcast. Rows whose bit is not set go before the
    shuffle; the exact join that follows removes those that share a bit by chance. With very many ids the bitmap fills
    up and the prefilter lets more through, but the result is the same."""
    return _marked(table, ids, *keys).where("_hit").select(*table.columns)


def _bitmaps(ids: DataFrame, bit: Column) -> DataFrame:
    """(_part, _map): the bitmaps as numbers of eight bytes, the first byte highest: then a bit is found without cutting
    out bytes, and the broadcast is no larger than the bits."""
    at = F.bitmap_bit_position(bit).cast("int")
    maps = ids.groupBy(F.bitmap_bucket_number(bit).alias("_part")).agg(F.bitmap_construct_agg(at).alias("_map"))
    number = lambda i: F.conv(F.hex(F.substring("_map", 8 * i + 1, F.lit(8))), 16, -10).cast("long")
    return maps.select("_part", F.transform(F.sequence(F.lit(0), F.lit(511)), number).alias("_map"))


def _marked(table: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """table with _hit: whether the keys' bit is set in the bitmap of ids."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1
    at = F.bitmap_bit_position(bit).cast("int")
    met = table.join(F.broadcast(_bitmaps(ids, bit)), F.bitmap_bucket_number(bit) == F.col("_part"), "left")
    shift = (F.lit(56) - F.shiftright(at, 3).bitwiseAND(F.lit(7)) * 8) + at.bitwiseAND(F.lit(7))
    hit = F.call_function("shiftright", F.get("_map", F.shiftright(at, 6)), shift).bitwiseAND(F.lit(1)) == 1
    return met.withColumn("_hit", F.coalesce(hit, F.lit(False)))


def left_join_some(table: DataFrame, some: DataFrame, *keys: str) -> DataFrame:
    """table.join(some, keys, "left") for a wide table of which some rows have a partner: the others, as far as the
    bitmap tells, are not shuffled."""
    marked, others = _marked(table, some, *keys), [c for c in some.columns if c not in keys]
    near = marked.where("_hit").select(*table.columns).join(some, list(keys), "left").select(*table.columns, *others)
    nulls = [F.lit(None).cast(some.schema[c].dataType).alias(c) for c in others]
    return near.unionByName(marked.where("not _hit").select(*table.columns, *nulls))


def anti_join_some(table: DataFrame, going: DataFrame, *keys: str) -> DataFrame:
    """table.join(going, keys, "left_anti"), with only the rows shuffled that the bitmap does not clear."""
    marked = _marked(table, going, *keys)
    near = marked.where("_hit").select(*table.columns).join(going.select(*keys), list(keys), "left_anti").select(*table.columns)
    return near.unionByName(marked.where("not _hit").select(*table.columns))


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ...: names that cannot clash with those of an operator."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by keys to as many tasks as a shuffle has: for few rows with much work, which AQE would put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them once the driver has dropped the plans, and a
    driver with little garbage would keep those of every step until the end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64 and of its inverse, n of them at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        up, down = np.full(size, _BASE), np.full(size, U64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash reads the hash of any byte string of buf."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE_KEY[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end], the same wherever the bytes stand."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word `[^\\x20\\x09-\\x0D]+`."""
    white = np.ones(len(buf) + 2, np.int8)
    white[1:-1] = _IS_WHITE[buf]
    edges = np.flatnonzero(np.diff(white))
    return edges[::2], edges[1::2]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of buf, in steps of CHUNK_BYTES that end at white space."""
    if lower:
        buf = _LOWER[buf]
    starts, ends = word_spans(buf)
    if len(buf) <= 2 * CHUNK_BYTES:
        return starts, ends, mix(span_hash(prefix_hash(buf), starts, ends) + (ends - starts).astype(U64))
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        s, e = starts[i:j], ends[i:j]
        out[i:j] = mix(span_hash(prefix_hash(buf[s[0] : e[-1]]), s - s[0], e - s[0]) + (e - s).astype(U64))
        i = j
    return starts, ends, out


def gram_hashes(words: np.ndarray, k: int, mixed: bool = True) -> np.ndarray:
    """Hash of words[i:i+k] for each i that has k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _WORD_BASE
        out += words[j : j + n]
    return mix(out) if mixed else out


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes], separator: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts with a separator byte between them, and where each text starts (one more than texts)."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=begin[1:])
    return np.frombuffer(separator.join(texts), np.uint8), begin


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
