"""Exact dense search: vectors in blocks, a matrix product for each pair of a row block and a query block.

A pair of blocks gives out the best rows of each query only, so that what is ranked in the end is bounded by depth times
the number of row blocks. Arrow batches are bounded in bytes by Spark, and a block has BLOCK_ROWS rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_ROWS = 1024
#: Queries up to which their blocks are broadcast: 2 MB each thousand at 256 dimensions.
BROADCAST_QUERIES = 20_000


def blocked(vectors: DataFrame, key: str, column: str, on: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """(on..., prefix + d, prefix + ids, prefix + matrix): up to BLOCK_ROWS vectors of one length that agree in `on`. Rows
    with a null vector or a null entry have no score and are left out."""
    kind = vectors.schema[key].dataType.simpleString()
    own = "".join(f"{c} {vectors.schema[c].dataType.simpleString()}, " for c in on)
    schema = f"{own}{prefix}d int, {prefix}ids array<{kind}>, {prefix}matrix binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).cast(pa.list_(pa.float64()))
            sizes = np.asarray(held.value_lengths().fill_null(-1))
            starts, values = np.asarray(held.offsets)[:-1], held.values
            gaps = np.asarray(values.is_null())
            values = np.asarray(values.fill_null(0.0))
            groups: dict[tuple, list[int]] = {}
            for i, names in enumerate(zip(sizes.tolist(), *(batch.column(2 + j).to_pylist() for j in range(len(on))))):
                if names[0] > 0:
                    groups.setdefault(names, []).append(i)
            for (d, *names), rows in groups.items():
                for i in range(0, len(rows), BLOCK_ROWS):
                    part = np.array(rows[i : i + BLOCK_ROWS])
                    at = starts[part][:, None] + np.arange(d)
                    part, at = part[whole := ~gaps[at].any(axis=1)], at[whole]
                    if len(part):
                        ids = batch.column(0).take(pa.array(part)).to_pylist()
                        yield pa.RecordBatch.from_pylist([{**dict(zip(on, names)), f"{prefix}d": d, f"{prefix}ids": ids, f"{prefix}matrix": values[at].tobytes()}], schema=arrow)

    return vectors.select(key, column, *on).mapInArrow(run, schema)


def best(scores: np.ndarray, depth: int) -> np.ndarray:
    """Columns of the highest `depth` scores, and those that tie with the last of them."""
    if len(scores) <= depth:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, -depth)[-depth])


def dense_top(vectors: DataFrame, queries: DataFrame, depth: int, on: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, score): candidates that hold the best `depth` rows of each query by dot product, to six digits; equal
    scores at the edge all stay. vectors (id, embedding, on...), queries (qid, embedding, on...). on: columns that both
    have to agree in, a label filter: then only blocks of one label meet, by an equality join."""
    if on:  # rows of one label side by side; ranges split a label that has many
        vectors = vectors.repartitionByRange(*on, "id").sortWithinPartitions(*on)
    mine = blocked(vectors, "id", "embedding", on)
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    asked = blocked(queries.repartitionByRange(*on, "qid").sortWithinPartitions(*on) if on else queries, "qid", "embedding", on, "q_")
    asked = F.broadcast(asked) if few else asked
    pairs = mine.join(asked, list(on)) if on else mine.crossJoin(asked)
    kinds = [(c, frame.schema[c].dataType.simpleString()) for c, frame in (("qid", queries), ("id", vectors))]
    schema = ", ".join(f"{c} {k}" for c, k in kinds) + ", score double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                d, ids, matrix, q_d, q_ids, q_matrix = (batch.column(c)[i].as_py() for c in range(6))
                if d != q_d:
                    continue
                scores = np.frombuffer(q_matrix).reshape(-1, d) @ np.frombuffer(matrix).reshape(-1, d).T
                scores = np.round(scores, 6) + 0.0
                chosen = [best(row, depth) for row in scores]
                counts, flat = [len(c) for c in chosen], np.concatenate(chosen)
                row = np.repeat(np.arange(len(q_ids)), counts)
                columns = [pa.array(q_ids, arrow.field(0).type).take(pa.array(row)), pa.array(ids, arrow.field(1).type).take(pa.array(flat)), pa.array(scores[row, flat])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pairs.select("d", "ids", "matrix", "q_d", "q_ids", "q_matrix").mapInArrow(run, schema)
