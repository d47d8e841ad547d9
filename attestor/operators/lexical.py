"""Exact lexical search by blocks: postings of some thousand chunks, terms of some thousand queries, the sums of each pair.

A term's weight in a chunk does not depend on the query, so it is worked out once a posting. A pair of blocks adds up the
weights and gives out the best chunks of each query only, ties by id: what is ranked in the end is bounded by depth times
the number of blocks, and not by the pairs of queries and chunks that share a term. A chunk lies in one block as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows (postings, query terms) and ids (chunks, queries) of a block at most, unless one id has more; cells of one sum.
BLOCK_POSTINGS, BLOCK_IDS, CELLS = 1 << 19, 4096, 1 << 21
#: Chunks by the number of which those of one filter are dealt over tasks.
DEALT = 1 << 16


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value equals the one before it; nulls are equal."""
    if not len(column):
        return np.zeros(0, bool)
    here, before = column[1:], column[:-1]
    return np.r_[False, np.asarray(pc.or_(pc.equal(here, before).fill_null(False), pc.and_(here.is_null(), before.is_null())))]


def blocked(rows: DataFrame, key: str, on: tuple[str, ...], prefix: str = "") -> DataFrame:
    """(on..., ids, at, term, x): rows (key, term, x, on...) that lie in order of on and key, cut between keys; at: which
    of the ids a row is of, x: its number. A block's rows are in order of their terms."""
    kind = lambda c: rows.schema[c].dataType.simpleString()
    own = "".join(f"{c} {kind(c)}, " for c in on)
    schema = f"{own}{prefix}ids array<{kind(key)}>, {prefix}at binary, {prefix}term binary, {prefix}x binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        fresh = ~_same(part.column(0).combine_chunks())
        ids, at = part.column(0).filter(pa.array(fresh)), np.cumsum(fresh) - 1
        term, x = part.column(1).to_numpy(), part.column(2).to_numpy()
        order = np.argsort(term, kind="stable")
        columns = [part.column(3 + j).slice(0, 1).combine_chunks() for j in range(len(on))]
        held = [pa.array([v.tobytes()], pa.binary()) for v in (at[order].astype(np.int32), term[order], x[order])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([ids.to_pylist()], arrow.field(len(on)).type), *held], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            starts = {name: ~_same(table.column(i).combine_chunks()) for i, name in [(0, key), *((3 + j, c) for j, c in enumerate(on))]}
            cut = np.zeros(len(table), bool)
            for c in on:
                cut |= starts[c]
            first = 0
            fresh = np.flatnonzero(cut | starts[key])  # where an id begins
            n = 0
            for i in fresh.tolist():
                if i > first and (cut[i] or n >= BLOCK_IDS or i - first >= BLOCK_POSTINGS):
                    yield block(table.slice(first, i - first))
                    first, n = i, 0
                n += 1
            rest = table.slice(first)
        if rest is not None and len(rest):
            yield block(rest)

    return rows.select(key, "term", "x", *on).mapInArrow(run, schema)


def best(row: np.ndarray, depth: int) -> np.ndarray:
    """Columns of the highest positive values, `depth` at most; of equal ones those that come first."""
    found = np.flatnonzero(row > 0)
    if len(found) > depth:
        values = row[found]
        found = found[values >= np.partition(values, -depth)[-depth]]
        found = found[np.argsort(-row[found], kind="stable")[:depth]]
    return found


def lexical_top(postings: DataFrame, queries: DataFrame, depth: int, n_chunks: int, on: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, list, score, weight): for each query the candidates that hold its best `depth` chunks by the sum of the
    weights (list bm25) and by the sum for numbers, then that of all (list number). postings (id, term long, x, on...),
    queries (qid, term long, x: what a number term counts, else 0, on...); on: columns that have to agree."""
    several = F.pmod(F.xxhash64("id"), F.lit(-(-n_chunks // DEALT) or 1)).alias("_b")
    postings = postings.select("id", "term", "x", *on, several)
    for c in on:  # null agrees with no filter
        postings = postings.where(F.col(c).isNotNull())
    mine = blocked((postings.repartition(*on, "_b") if on else postings.repartition("id")).sortWithinPartitions(*on, "id"), "id", on)
    asked = queries.select("qid", "term", "x", *on, F.pmod(F.xxhash64("qid"), F.lit(64)).alias("_b"))
    asked = blocked((asked.repartition(*on) if on else asked.repartition("_b")).sortWithinPartitions(*on, "qid"), "qid", on, "q_")
    pairs = mine.join(asked, list(on)) if on else mine.crossJoin(asked)
    kinds = [(c, frame.schema[c].dataType.simpleString()) for c, frame in (("qid", queries), ("id", postings))]
    schema = ", ".join(f"{c} {k}" for c, k in kinds) + ", list string, score double, weight double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def pair(ids, at, term, x, q_ids, q_at, q_term, q_x) -> Iterator[pa.RecordBatch]:
        at, q_at = np.frombuffer(at, np.int32), np.frombuffer(q_at, np.int32)
        term, q_term, x, q_x = np.frombuffer(term, np.int64), np.frombuffer(q_term, np.int64), np.frombuffer(x), np.frombuffer(q_x)
        by_query = np.argsort(q_at, kind="stable")
        q_at, q_term, q_x = q_at[by_query], q_term[by_query], q_x[by_query]
        low, high = np.searchsorted(term, q_term), np.searchsorted(term, q_term, side="right")
        n, step = len(ids), max(1, CELLS // len(ids))
        for first in range(0, len(q_ids), step):
            some = min(step, len(q_ids) - first)
            a, b = np.searchsorted(q_at, [first, first + some])
            counts = high[a:b] - low[a:b]
            total = int(counts.sum())
            if not total:
                continue
            place = np.repeat(low[a:b] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
            cell = np.repeat(q_at[a:b].astype(np.int64) - first, counts) * n + at[place]
            scores = np.round(np.bincount(cell, x[place], some * n), 6).reshape(some, n)
            chosen = [("bm25", r, best(scores[r], depth)) for r in np.unique(q_at[a:b] - first).tolist()]
            weights = np.zeros((0, n))
            if numbers := np.unique(q_at[a:b][q_x[a:b] > 0] - first).tolist():
                weights = np.round(np.bincount(cell, np.repeat(q_x[a:b], counts), some * n), 6).reshape(some, n)
                for r in numbers:
                    tied = np.where(weights[r] > 0, np.round(weights[r] + 1e-6 * scores[r], 9), 0.0)
                    chosen.append(("number", r, best(tied, depth)))
            rows = np.repeat([r for _, r, _ in chosen], [len(c) for *_, c in chosen])
            columns = np.concatenate([c for *_, c in chosen]).astype(np.int64)
            lists = pa.array([name for name, _, c in chosen for _ in range(len(c))], pa.string())
            w = pa.array(weights[rows, columns], mask=weights[rows, columns] <= 0) if len(weights) else pa.nulls(len(rows), pa.float64())
            q, d = pa.array(q_ids, arrow.field(0).type), pa.array(ids, arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([q.take(pa.array(rows + first)), d.take(pa.array(columns)), lists, pa.array(scores[rows, columns]), w], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from pair(*(batch.column(c)[i].as_py() for c in range(8)))

    return pairs.select("ids", "at", "term", "x", "q_ids", "q_at", "q_term", "q_x").mapInArrow(run, schema)
