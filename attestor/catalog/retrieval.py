"""Tokens, indexes, search, fusion, routing and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from ..functions.text import folded, tokenize
from ..operators import index as ix
from ..operators import search as se
from ..operators.dense import dense_top
from ..sources.shared import staged
from .store import code_of, kind_of, shown, store_of
from .tables import SQL_INDEX, read, sql_tokens


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def index_of(spark: SparkSession, d: str, asked: DataFrame | None = None) -> ix.LexicalIndex:
    return ix.LexicalIndex.build(read(spark, d, "documents"), terms=None if asked is None else se.terms_of(asked))


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select(F.size(tokenize(F.col("text"))).cast("long").alias("n"))
    return t.agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("avgdl"), F.max("n").alias("longest"), F.sum("n").alias("n_tokens"))


def postings_top_terms(spark: SparkSession, d: str) -> DataFrame:
    post = index_of(spark, d).postings
    out = post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return out.orderBy(F.desc("df"), "term").limit(50)


def term_idf(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_top5(spark: SparkSession, d: str) -> DataFrame:
    _, scored, _ = store_of(spark, d).lists(queries_of(spark, d), dense=False, numbers=False)
    return se.top(scored, "score", 5).select("qid", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "score")


def number_match_rare(spark: SparkSession, d: str) -> DataFrame:
    """The figures of conversation turns looked for in the documents."""
    asked = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")
    scored = index_of(spark, d, asked).figure_scores(se.terms_of(asked))
    return scored.select("qid", F.col("id").alias("doc_id"), "weight", "rare")


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    v = ix.embed(read(spark, d, "documents")).select("id", F.posexplode("embedding").alias("dim", "x"))
    return v.where("x > 0").select(F.col("id").alias("doc_id"), F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("weight"))


def dense_top10(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    scored = dense_top(v, v.where("id % 50 = 0").withColumnRenamed("id", "qid"), 10)
    return se.top(scored, "score", 10).select("qid", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "score")


def dense_filtered_top5(spark: SparkSession, d: str) -> DataFrame:
    """The same within the rows of the query's label: an equality join, not a product."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    scored = dense_top(v, v.where("id % 50 = 0").withColumnRenamed("id", "qid"), 5, ("label",))
    return se.top(scored, "score", 5).select("qid", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "score")


def _lists(spark: SparkSession, d: str):
    return store_of(spark, d).lists(queries_of(spark, d))


def rrf_hybrid_top5(spark: SparkSession, d: str) -> DataFrame:
    dense, bm25, _ = _lists(spark, d)
    return shown(se.fuse(dense, bm25, None, 5))


def rrf_pinned_top5(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: dense, lexical and figure lists fused, rare figures pinned."""
    return shown(se.fuse(*_lists(spark, d), 5))


def ablation_overlap(spark: SparkSession, d: str) -> DataFrame:
    """For each configuration, how many of its top 5 the full configuration has, on average over the queries."""
    dense, bm25, figures = _lists(spark, d)
    full = se.fuse(dense, bm25, figures, 5).select("qid", "id").withColumn("both", F.lit(1))
    out = None
    for name, off in se.CONFIGS.items():
        use = {"dense": True, "bm25": True, "numbers": True} | off
        part = se.fuse(dense if use["dense"] else None, bm25 if use["bm25"] else None, figures if use["numbers"] else None, 5, pin=True)
        part = part.select(F.lit(name).alias("config"), "qid", "id")
        out = part if out is None else out.unionByName(part)
    return out.join(full, ["qid", "id"], "left").groupBy("config").agg(F.count("*").alias("n_hits"), F.count("both").alias("n_shared"))


def routed_gather(spark: SparkSession, d: str) -> DataFrame:
    """Documents play chunks, their source the section, the item's number the kind of claim."""
    held = store_of(spark, d)
    _, scored, _ = held.lists(queries_of(spark, d), dense=False, numbers=False, full=True)
    hits = se.top(scored, "score", 5)
    governed = scored.withColumn("code", code_of(F.col("id")))
    governed = governed.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "code").orderBy(F.desc("score"), "id"))).where("rank <= 8")
    kinds = queries_of(spark, d).select("qid", kind_of(F.col("qid")).alias("kind"))
    out = se.gather(hits, governed, kinds)
    return out.select("qid", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "routed")


def hit_at_k_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Items that stand word for word in a document are the relevant pairs; the lexical ranks are scored."""
    docs, asked = read(spark, d, "documents"), queries_of(spark, d)
    truth = relevant_pairs(docs, asked)
    ranked = se.top(index_of(spark, d, queries_of(spark, d)).scores(se.terms_of(asked)), "score", se.DEPTH)
    return retrieval_metrics(ranked, truth)


#: Items up to which they are broadcast: some 10 MB at 500 bytes each.
BROADCAST_ITEMS = 20_000


def relevant_pairs(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, id): a document that contains the item, both folded. A folded text has single blanks only, so all words of an
    item but its first and last one are words of the document: the longest of them finds the documents that are looked
    through; items of fewer than three words are compared with every document, as a stated set of queries."""
    q = asked.select("qid", folded(F.col("text")).alias("item")).where("item <> ''")
    words = F.split("item", " ")
    inner = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))["word"]
    q = staged(q.select("qid", "item", longest.alias("word")), "asked")
    few = q.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    near, far = q.where("word is null").select("qid", "item"), q.where("word is not null")
    table = docs.select(F.col("doc_id").alias("id"), folded(F.col("text")).alias("held"))
    inside = F.contains("held", F.col("item"))
    table = table if few else staged(table, "folded")
    seen = table.select("id", *(["held"] if few else []), F.explode(F.array_distinct(F.split("held", " "))).alias("word"))
    if few:  # the text stays where it is: nothing is shuffled
        met = seen.join(F.broadcast(far), "word").where(inside).select("qid", "id")
    else:
        met = seen.join(far.select("qid", "word"), "word").select("qid", "id").join(table, "id").join(far.select("qid", "item"), "qid").where(inside).select("qid", "id")
    if near.isEmpty():
        return met
    return met.unionByName(table.crossJoin(F.broadcast(near) if few else near).where(inside).select("qid", "id"))


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: hit@k with their intervals and MRR@10, over the queries that have a relevant row; misses count as none."""
    best = truth.join(ranked, ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("r"))
    hits = [F.count_if(F.col("r") <= k).alias(f"h{k}") for k in ks]
    agg = best.agg(F.count("*").alias("n"), *hits, F.round(F.avg(F.when(F.col("r") <= 10, 1.0 / F.col("r")).otherwise(0.0)), 6).alias("mrr_at_10"), F.count_if(F.col("r").isNull()).alias("n_missed"))
    out = [F.col("n"), F.col("n_missed"), F.col("mrr_at_10")]
    for k in ks:
        low, high = wilson(F.col(f"h{k}"), F.col("n"))
        out += [F.round(F.col(f"h{k}") / F.col("n"), 6).alias(f"hit_at_{k}"), low.alias(f"low_{k}"), high.alias(f"high_{k}")]
    return agg.select(*out)


_TOP = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)"
_EMB = """
w AS (SELECT key, kind, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM
      (SELECT doc_id AS key, 'd' AS kind, text FROM documents UNION ALL SELECT item_id, 'q', text FROM benchmark)),
c AS (SELECT key, kind, ('0x' || right(md5(word), 2))::INT % 64 AS dim, count(*)::DOUBLE AS x FROM w GROUP BY ALL),
e AS (SELECT key, kind, dim, x / sqrt(sum(x * x) OVER (PARTITION BY key, kind)) AS x FROM c)"""
_LISTS = f"""
dn AS (SELECT q.key AS qid, d.key AS id, round(sum(q.x * d.x), 6) AS score FROM e q JOIN e d USING (dim) WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
dz AS (SELECT item_id AS qid, doc_id AS id, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN dn ON qid = item_id AND id = doc_id),
dr AS (SELECT qid, id, {_TOP} AS r FROM dz QUALIFY r <= 50),
br AS (SELECT qid, id, {_TOP} AS r FROM bm WHERE score > 0 QUALIFY r <= 50),
nm AS (SELECT qid, id, round(sum(idf), 6) AS weight FROM hit WHERE regexp_matches(term, '^\\d+(?:[.,]\\d+)*$') GROUP BY ALL),
ra AS (SELECT qid, max(df <= 10) AS rare FROM qt JOIN terms USING (term) WHERE regexp_matches(term, '^\\d+(?:[.,]\\d+)*$') GROUP BY qid),
nr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(weight + 1e-6 * coalesce(score, 0), 9) DESC, id) AS r FROM nm LEFT JOIN bm USING (qid, id) QUALIFY r <= 50)"""


def _fused(dense: bool, bm25: bool, numbers: bool, name: str) -> str:
    parts = [f"SELECT qid, id, '{n}' AS l, r FROM {t}" for n, t, on in (("d", "dr", dense), ("b", "br", bm25), ("n", "nr", numbers)) if on]
    rare = "coalesce(rare, false) AND nrank <= 2" if numbers else "false"
    return f"""
{name}0 AS (SELECT qid, id, round(sum(1.0 / (60 + r)), 9) AS score, max(r) FILTER (l = 'd') AS drank, max(r) FILTER (l = 'b') AS brank, max(r) FILTER (l = 'n') AS nrank
  FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL),
{name}1 AS (SELECT *, coalesce({rare}, false) AS pinned FROM {name}0 LEFT JOIN ra USING (qid)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN pinned THEN nrank ELSE 99 END, score DESC, drank NULLS LAST, brank NULLS LAST, nrank NULLS LAST, id) AS rank
  FROM {name}1 QUALIFY rank <= 5)"""


_SHOW = "SELECT qid, id AS doc_id, rank, drank AS dense_rank, brank AS bm25_rank, nrank AS number_rank, score, pinned FROM"
_CODES = sorted({c for v in se.ROUTES.values() for c in v})
_KINDS = sorted(se.ROUTES)
_ROUTE_ROWS = ", ".join(f"('{k}', '{c}', {i})" for k, v in se.ROUTES.items() for i, c in enumerate(v))

QUERIES = {
    "tokenize_counts": (tokenize_counts, f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)"),
    "doc_length_stats": (doc_length_stats, f"SELECT count(*) AS n_docs, round(avg(n), 6) AS avgdl, max(n) AS longest, sum(n)::BIGINT AS n_tokens FROM (SELECT len({sql_tokens('text')})::BIGINT AS n FROM documents)"),
    "postings_top_terms": (postings_top_terms, f"WITH {SQL_INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term ORDER BY df DESC, term LIMIT 50"),
    "term_idf": (term_idf, f"WITH {SQL_INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms"),
    "bm25_top5": (bm25_top5, f"WITH {SQL_INDEX} SELECT qid, id AS doc_id, {_TOP} AS rank, score FROM bm QUALIFY rank <= 5"),
    "number_match_rare": (
        number_match_rare,
        "WITH " + SQL_INDEX.replace("SELECT item_id AS qid,", "SELECT conv_id || '-' || turn AS qid,").replace("FROM benchmark", "FROM conversations")
        + ", num AS (SELECT * FROM qt WHERE regexp_matches(term, '^\\d+(?:[.,]\\d+)*$')), ra AS (SELECT qid, max(df <= 10) AS rare FROM num JOIN terms USING (term) GROUP BY qid) "
        "SELECT qid, id AS doc_id, round(sum(idf), 6) AS weight, rare FROM num JOIN terms USING (term) JOIN post USING (term) JOIN ra USING (qid) GROUP BY qid, id, rare",
    ),
    "hash_embed": (hash_embed, f"WITH {_EMB} SELECT key AS doc_id, dim::BIGINT AS dim, round(x, 6) AS weight FROM e WHERE kind = 'd'"),
    "dense_top10": (dense_top10, f"SELECT qid, id AS vec_id, {_TOP} AS rank, score FROM (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10"),
    "dense_filtered_top5": (dense_filtered_top5, f"SELECT qid, id AS vec_id, {_TOP} AS rank, score FROM (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 50 = 0) QUALIFY rank <= 5"),
    "rrf_hybrid_top5": (rrf_hybrid_top5, f"WITH {SQL_INDEX}, {_EMB}, {_LISTS}, {_fused(True, True, False, 'f')} {_SHOW} f"),
    "rrf_pinned_top5": (rrf_pinned_top5, f"WITH {SQL_INDEX}, {_EMB}, {_LISTS}, {_fused(True, True, True, 'f')} {_SHOW} f"),
    "ablation_overlap": (
        ablation_overlap,
        f"WITH {SQL_INDEX}, {_EMB}, {_LISTS}, {_fused(True, True, True, 'f')}, {_fused(True, False, False, 'fd')}, {_fused(False, True, False, 'fb')}, {_fused(True, True, False, 'fh')}, "
        "u AS (SELECT 'dense' AS config, qid, id FROM fd UNION ALL SELECT 'bm25', qid, id FROM fb UNION ALL SELECT 'hybrid', qid, id FROM fh UNION ALL SELECT 'hybrid+figures', qid, id FROM f) "
        "SELECT config, count(*) AS n_hits, count(f.id) AS n_shared FROM u LEFT JOIN f ON u.qid = f.qid AND u.id = f.id GROUP BY config",
    ),
    "routed_gather": (
        routed_gather,
        f"WITH {SQL_INDEX}, routes AS (SELECT * FROM (VALUES {_ROUTE_ROWS}) AS t(kind, code, ord)), codes AS (SELECT {_CODES} AS c, {_KINDS} AS k), "
        f"hits AS (SELECT qid, id, {_TOP} AS rank FROM bm QUALIFY rank <= 5), "
        "gov0 AS (SELECT qid, id, score, c[id % 7 + 1] AS code FROM bm, codes), "
        "gov AS (SELECT *, row_number() OVER (PARTITION BY qid, code ORDER BY score DESC, id) AS rank FROM gov0 QUALIFY rank <= 8), "
        "wanted AS (SELECT item_id AS qid, code, ord FROM benchmark, codes JOIN routes ON kind = k[item_id % 6 + 1]), "
        "top3 AS (SELECT gov.*, ord FROM gov JOIN wanted USING (qid, code) WHERE rank <= 3), "
        "best AS (SELECT qid, id, score, ord, row_number() OVER (PARTITION BY qid, code ORDER BY rank, id) AS nth FROM top3 "
        "  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = top3.qid AND h.id = top3.id AND h.rank <= 4)), "
        "two AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN nth = 1 THEN 0 ELSE 1 END, CASE WHEN nth = 1 THEN ord END NULLS FIRST, score DESC, id) AS r FROM best QUALIFY r <= 2), "
        "every AS (SELECT qid, id, r, true AS routed FROM two UNION ALL SELECT qid, id, rank + 100, false FROM hits h WHERE NOT EXISTS (SELECT 1 FROM two t WHERE t.qid = h.qid AND t.id = h.id)) "
        "SELECT qid, id AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY r, id) AS rank, routed FROM every "
        "QUALIFY rank <= CASE WHEN qid IN (SELECT qid FROM wanted) THEN 6 ELSE 5 END",
    ),
    "hit_at_k_mrr": (hit_at_k_mrr, None),
}
