"""Ranked lists, reciprocal-rank fusion, pins for exact figures and section routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms
from .dense import dense_top
from .index import NUMBER_TERM, LexicalIndex, okapi  # noqa: F401  the store takes all three from here

# Fixed values ---------------------------------------------------------------------------------------------------
RRF_K, DEPTH, PINS = 60, 50, 2
ROUTED, PRESENT, EXCERPTS = 2, 4, 6
ROUTES = {
    "indication": ["34067-9"],
    "safety": ["34066-1", "34070-3", "43685-7"],
    "dosing": ["34068-7", "43678-2"],
    "comparative": ["34092-7"],
    "efficacy": ["34067-9", "34092-7"],
}
CONFIGS = {
    "dense": {"bm25": False, "numbers": False},
    "bm25": {"dense": False, "numbers": False},
    "hybrid": {"numbers": False},
    "hybrid+figures": {},
}
# -----------------------------------------------------------------------------------------------------------------


def top(scored: DataFrame, score: str, depth: int = DEPTH, rank: str = "rank") -> DataFrame:
    """The best `depth` rows of each query, ties by id; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= depth)


def terms_of(queries: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    return queries.select(F.col(key).alias("qid"), F.explode(query_terms(F.col(text))).alias("term"))


def pair_scores(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score) by dot product of stated pairs (qid, id)."""
    met = pairs.select("qid", "id").join(vectors, "id").join(queries.select("qid", F.col("embedding").alias("q")), "qid")
    score = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
    return met.select("qid", "id", F.round(score, 6).alias("score")).where("score is not null")


def fuse(dense: DataFrame | None, bm25: DataFrame | None, figures: DataFrame | None, k: int, pin: bool = True, ties: DataFrame | None = None) -> DataFrame:
    """(qid, id, rank, score, dense_rank, bm25_rank, number_rank, pinned): sum of 1 / (60 + rank) over the lists; if a
    query has a rare number, the first two of the number list come before all others. ties: the lexical scores that
    order equal numbers, if bm25 is no list of its own; figures may bring them as a column score."""
    ties = bm25 if ties is None else ties
    lists = []
    if dense is not None:
        lists.append(top(dense, "score").select("qid", "id", F.lit("dense").alias("list"), "rank", F.lit(False).alias("rare")))
    if bm25 is not None:
        lists.append(top(bm25.where("score > 0"), "score").select("qid", "id", F.lit("bm25").alias("list"), "rank", F.lit(False).alias("rare")))
    if figures is not None:
        tied = figures if "score" in figures.columns else figures.join(ties, ["qid", "id"], "left") if ties is not None else figures.withColumn("score", F.lit(0.0))
        tied = tied.withColumn("tied", F.round(F.col("weight") + 1e-6 * F.coalesce("score", F.lit(0.0)), 9))
        lists.append(top(tied, "tied").select("qid", "id", F.lit("number").alias("list"), "rank", "rare"))
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    of = lambda name: F.max(F.when(F.col("list") == name, F.col("rank")))
    fused = every.groupBy("qid", "id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"),
        of("dense").alias("dense_rank"), of("bm25").alias("bm25_rank"), of("number").alias("number_rank"), F.max("rare").alias("rare"),
    )
    pinned = F.col("rare") & (F.col("number_rank") <= PINS) if pin else F.lit(False)
    fused = fused.withColumn("pinned", F.coalesce(pinned, F.lit(False)))
    last = F.asc_nulls_last
    order = [F.when(F.col("pinned"), F.col("number_rank")).otherwise(99), F.desc("score"), last("dense_rank"), last("bm25_rank"), last("number_rank"), "id"]
    w = Window.partitionBy("qid").orderBy(*order)
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rare")


def hybrid(index: LexicalIndex, vectors: DataFrame | None, queries: DataFrame, query_vectors: DataFrame | None, k: int = 8, allowed: DataFrame | None = None, **switches) -> DataFrame:
    """Hybrid search of queries (qid, text). allowed: (id) or (qid, id), applied to scores, never to statistics."""
    on = {"dense": True, "bm25": True, "numbers": True} | switches
    terms = terms_of(queries)
    keep = (lambda df: df.join(allowed, [c for c in ("qid", "id") if c in allowed.columns], "left_semi")) if allowed is not None else (lambda df: df)
    bm25 = keep(index.scores(terms)) if on["bm25"] or on["numbers"] else None
    figures = keep(index.figure_scores(terms)) if on["numbers"] else None
    dense = None
    if on["dense"] and vectors is not None:
        asked = query_vectors.withColumnRenamed("id", "qid")
        dense = dense_top(keep(vectors), asked, DEPTH) if allowed is None or "qid" not in allowed.columns else pair_scores(allowed, vectors, asked)
    return fuse(dense, bm25 if on["bm25"] else None, figures, k)


def gather(hits: DataFrame, governed: DataFrame, kinds: DataFrame, k: int = 5) -> DataFrame:
    """(qid, id, rank, routed): excerpts of each claim. hits: (qid, id, rank); governed: (qid, id, code, rank, score) the
    ranked chunks of every section; kinds: (qid, kind).

    For each section that governs the claim's kind its best three chunks are looked at, less those among the first four
    hits: the best left is taken, in route order, two at most before filling by score; then the hits; six in all. Claims of other kinds keep their k hits."""
    routes = governed.sparkSession.createDataFrame([(kind, code, i) for kind, codes in ROUTES.items() for i, code in enumerate(codes)], "kind string, code string, ord int")
    wanted = kinds.join(F.broadcast(routes), "kind")
    shown = hits.where(F.col("rank") <= PRESENT).select("qid", "id")
    nth = F.row_number().over(Window.partitionBy("qid", "code").orderBy("rank", "id"))
    best = governed.join(wanted, ["qid", "code"]).withColumn("nth", nth).where(F.col("nth") <= ROUTED + 1)
    best = best.join(shown, ["qid", "id"], "left_anti").withColumn("nth", nth)
    order = Window.partitionBy("qid").orderBy(F.when(F.col("nth") == 1, 0).otherwise(1), F.when(F.col("nth") == 1, F.col("ord")), F.desc("score"), "id")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ROUTED).select("qid", "id", "r", F.lit(True).alias("routed"))
    rest = hits.join(best.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", (F.col("rank") + 100).alias("r"), F.lit(False).alias("routed"))
    both = best.unionByName(rest)
    most = both.join(wanted.select("qid").distinct().withColumn("most", F.lit(EXCERPTS)), "qid", "left")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("r", "id"))
    return most.withColumn("rank", rank).where(F.col("rank") <= F.coalesce("most", F.lit(k))).select("qid", "id", "rank", "routed")


def point_lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids, key)
