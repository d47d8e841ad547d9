"""Whitening of embeddings by exact integer covariances, and the query op12.

An entry c becomes the integer y = floor(64 * c) (the contract's x is y plus a constant, which no centred figure sees).
The fit list is each distinct vector once. With its size n and sums S, the rows n*y - S are centred integers; they are
split into small signed limbs, so that float64 matrix products of limbs over a block of rows are exact, the products
are put together again as big integers, summed over blocks and tasks in pieces of 56 bits, and only the finished
covariance becomes a matrix of doubles, whose eigenvectors are the components.

What reaches the driver is one d x d matrix for vectors of d entries, whatever the number of rows.

Defined cases: rows with a null vector, or one with null or non-finite entries or with one whose x is no long, are
dropped; vectors of another length than most of the distinct ones (at a tie, the longest) are dropped as well; repeated
rows each get their rows; a null id stays; without a row, or with vectors of no entries, there are no rows; a
component without variance (e below d * 2**-52 of the largest) has whitened null and stays out of identity_error; a
deviation that is no long is null; with no variance at all, explained is null. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, staged

SCALE, COMPONENTS = 64, 16
#: Digits of a limb, and rows of a block: products of two limbs are 2**38 at most, 2**14 of them below 2**53.
LIMB_BITS, BLOCK_ROWS = 20, 1 << 14
#: A task's totals travel in pieces of so many bits, summed as decimals: room for 2**60 tasks.
PIECE_BITS = 56
#: Entries that one step of a scan takes.
STEP_ENTRIES = 1 << 20


def integers(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, y as a matrix) of the rows of a list column that count, for each length, or for one only."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    starts = np.asarray(column.offsets)[:-1]
    values = column.values
    null = np.asarray(values.is_null())
    values = np.asarray(values.fill_null(math.nan))
    for d in np.unique(sizes) if length is None else [length]:
        rows = np.flatnonzero(sizes == d)
        if d < 0 or not len(rows):
            continue
        step = max(1, STEP_ENTRIES // max(int(d), 1))
        for part in np.split(rows, range(step, len(rows), step)):
            at = starts[part][:, None] + np.arange(d)
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.floor(values[at] * SCALE)
                good = ((y >= -(2.0**63)) & (y <= 2.0**63 - 2.0**20) & ~null[at]).all(axis=1)
            yield part[good], y[good].astype(np.int64)


def packed(y: np.ndarray) -> list[bytes]:
    """A vector's name: its integers in 4 bytes each if all fit, else in 8, and a byte that says which."""
    narrow = (np.abs(y) < 2**31).all(axis=1) if y.shape[1] else np.ones(len(y), bool)
    short = y.astype(np.int32)
    return [b"\x04" + short[i].tobytes() if narrow[i] else b"\x08" + y[i].tobytes() for i in range(len(y))]


def unpacked(names: list[bytes], d: int) -> np.ndarray:
    if all(len(x) == 4 * d + 1 for x in names):
        bytes_ = np.frombuffer(b"".join(names), np.uint8).reshape(len(names), 4 * d + 1)
        return np.ascontiguousarray(bytes_[:, 1:]).view(np.int32).astype(np.int64)
    out = np.empty((len(names), d), np.int64)
    for i, x in enumerate(names):
        out[i] = np.frombuffer(x, np.int32 if x[0] == 4 else np.int64, offset=1)
    return out


def limbs(values: np.ndarray, count: int) -> list[np.ndarray]:
    """Signed digits of LIMB_BITS bits, the lowest first, as float64; values are int64 or, beyond it, Python integers."""
    half, out = 1 << (LIMB_BITS - 1), []
    for k in range(count):
        rest = (values + half) >> LIMB_BITS if k < count - 1 else values * 0
        out.append((values - (rest << LIMB_BITS)).astype(np.float64))
        values = rest
    return out


def limb_count(bound: int) -> int:
    """Limbs that hold every integer up to a bound: the highest digit stays under 2**(LIMB_BITS - 1)."""
    return max(1, -(-(bound.bit_length() + 1) // LIMB_BITS))


def gram(values: np.ndarray, bound: int) -> np.ndarray:
    """values' x values, exactly, as Python integers; |values| <= bound, BLOCK_ROWS rows at most."""
    parts, d = limbs(values, limb_count(bound)), values.shape[1]
    total = np.zeros((d, d), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[i:], i):
            product = (a.T @ b).astype(np.int64).astype(object)
            total += (product if i == j else product + product.T) << (LIMB_BITS * (i + j))
    return total


def pieces(value: int, count: int) -> list[int]:
    """Pieces of PIECE_BITS bits, the lowest first; the highest has the sign."""
    mask = (1 << PIECE_BITS) - 1
    return [(value >> (PIECE_BITS * k)) & mask if k < count - 1 else value >> (PIECE_BITS * k) for k in range(count)]


def summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    """(cell, kind) -> total of pieces (cell, kind, piece, value); the number of cells is bounded by the vectors' length."""
    totals = parts.groupBy("cell", "kind", "piece").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[tuple[int, int], int] = {}
    for r in totals.collect():
        out[r["cell"], r["kind"]] = out.get((r["cell"], r["kind"]), 0) + (int(r["value"]) << (PIECE_BITS * r["piece"]))
    return out


PARTS = "cell long, kind int, piece int, value long"


def _as_parts(totals: dict[tuple[int, int], int], count: int) -> pa.RecordBatch:
    rows = [(cell, kind, k, v) for (cell, kind), total in totals.items() for k, v in enumerate(pieces(total, count)) if v]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["cell", "kind", "piece", "value"])


@dataclass(frozen=True)
class Whitening:
    """n vectors with the sums S of y; components as columns, their eigenvalues and shares, and the audited error."""

    n: int
    sums: tuple[int, ...]
    bound: int
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    sound: np.ndarray
    identity_error: float

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n*y - S: int64 where no step can leave it, else Python integers."""
        if self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0) < 2**62:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        scaled = self.vectors[:, self.sound] / np.sqrt(self.values[self.sound])
        out = np.full((len(centred), len(self.values)), np.nan)
        out[:, self.sound] = (centred.astype(np.float64) / self.n) @ scaled
        return out

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype != object and len(self.sums) * self.bound**2 < 2**63 and int(np.abs(centred).max(initial=0)) <= self.bound:
            return (centred * centred).sum(axis=1).tolist()
        totals = [sum(int(v) ** 2 for v in row) for row in centred]
        return [t if t < 2**63 else None for t in totals]


def fit_list(table: DataFrame, column: str = "embedding") -> DataFrame:
    """(d, x): each distinct vector that counts once, as a name that holds its integers; d is its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y in integers(batch.column(0)):
                names = list(dict.fromkeys(packed(y)))
                yield pa.RecordBatch.from_arrays([pa.array([y.shape[1]] * len(names), pa.int32()), pa.array(names, pa.binary())], ["d", "x"])

    return table.select(F.col(column)).mapInArrow(run, "d int, x binary").distinct()


def fit(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The components of a table's vectors, or none if it has no vector with an entry."""
    whole_list = staged(fit_list(table, column), "op12-fit")
    lengths = whole_list.groupBy("d").agg(F.count("*").alias("vectors")).orderBy(F.desc("vectors"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    if not d:
        discard(whole_list)
        return None
    listed = whole_list.where(F.col("d") == d).select("x")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        step = max(1, min(BLOCK_ROWS, STEP_ENTRIES // d))
        for batch in batches:
            for a in range(0, len(batch), step):
                yield unpacked(batch.column(0).slice(a, step).to_pylist(), d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, low, high = 0, np.zeros(d, object), None, None
        for y in matrices(batches):
            rows += len(y)
            total += (y >> 32).sum(axis=0).astype(object) * 2**32 + (y & 0xFFFFFFFF).sum(axis=0).astype(object)
            low = y.min(axis=0) if low is None else np.minimum(low, y.min(axis=0))
            high = y.max(axis=0) if high is None else np.maximum(high, y.max(axis=0))
        if rows:
            cells = range(d)
            figures = [pa.array([rows] + [0] * (d - 1), pa.int64()), pa.array(low), pa.array(high)]
            lower, upper = zip(*(pieces(int(t), 2) for t in total))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *figures, pa.array(lower, pa.int64()), pa.array(upper, pa.int64())], ["cell", "rows", "low", "high", "lower", "upper"])

    seen = listed.mapInArrow(moments, "cell long, rows long, low long, high long, lower long, upper long").groupBy("cell")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    seen = seen.agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), whole("lower"), whole("upper"))
    seen = {r["cell"]: r for r in seen.collect()}
    n = seen[0]["rows"]
    sums = tuple(int(seen[i]["lower"]) + (int(seen[i]["upper"]) << PIECE_BITS) for i in range(d))
    bound = max(max(abs(n * seen[i]["low"] - sums[i]), abs(n * seen[i]["high"] - sums[i])) for i in range(d))
    centre = Whitening(n, sums, bound, np.empty((d, 0)), np.empty(0), [], np.empty(0, bool), 0.0)
    upper = np.triu_indices(d)
    count = -(-(2 * bound.bit_length() + 64) // PIECE_BITS)  # 2**63 rows at most

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for y in matrices(batches):
            total += gram(centre.centred(y), bound)
        yield _as_parts({(i * d + j, 0): total[i, j] for i, j in zip(*map(np.ndarray.tolist, upper)) if total[i, j]}, count)

    found = summed(listed.mapInArrow(products, PARTS))
    covariance = np.zeros((d, d))
    for (cell, _), total in found.items():
        covariance[cell // d, cell % d] = covariance[cell % d, cell // d] = total / n**3  # rounded once
    trace = sum(found.get((i * d + i, 0), 0) for i in range(d)) / n**3
    values, vectors = np.linalg.eigh(covariance)
    k = min(components, d)
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(k)] < 0, -1.0, 1.0)  # the largest entry is positive
    sound = values > d * 2.0**-52 * values[0]
    model = Whitening(n, sums, bound, vectors, values, [v / trace if trace else None for v in values.tolist()], sound, 0.0)
    error = _identity_error(listed, matrices, model)
    discard(whole_list)
    return Whitening(n, sums, bound, vectors, values, model.explained, sound, error)


def _identity_error(listed: DataFrame, matrices, model: Whitening) -> float:
    """The largest entry of the whitened fit list's own covariance minus the identity: the audit of the result."""
    k = int(model.sound.sum())
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for y in matrices(batches):
            w = model.whitened(model.centred(y))[:, model.sound]
            total += w.sum(axis=0)
            square += w.T @ w
        figures = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(figures)), pa.int32()), pa.array(figures)], ["cell", "value"])

    found = listed.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    figures = np.zeros(k + k * k)
    figures[[r["cell"] for r in found]] = [r["value"] for r in found]
    mean = figures[:k] / model.n  # zero but for rounding, as the rows are centred
    return float(np.abs(figures[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each component, numbered from 1."""
    table = table.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    if model is None:
        return table.limit(0).mapInArrow(lambda batches: iter(()), WHITENED)
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in integers(batch.column(1), d):
                centred = model.centred(y)
                whitened, m = model.whitened(centred), len(rows)
                ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
                deviation = pa.array(model.deviations(centred), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        deviation,
                        pa.array(whitened.ravel(), mask=~np.tile(model.sound, m)),
                        pa.array(model.explained * m, pa.float64()),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return table.mapInArrow(run, WHITENED)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = documents(spark, sf_dir, "embeddings")
    return whiten(table, fit(table))
