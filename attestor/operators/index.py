"""Lexical and dense indexes as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_bucket, tokenize

K1, B = 1.2, 0.75
NUMBER_TERM = r"^\d+(?:[.,]\d+)*$"


def okapi(idf: Column, tf: Column, doc_len: Column, avgdl: Column) -> Column:
    """The weight of one term in one document."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avgdl))


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, id, tf, doc_len), terms(term, df, idf), corpus(n_docs, avgdl): one row."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> LexicalIndex:
        """Statistics are those of the whole corpus: filters of a search never reach them. With terms (term) the
        postings hold only these, for a search that is run once: other tokens go before they are shuffled."""
        tokens = docs.select(F.col(key).alias("id"), tokenize(F.col(text)).alias("tokens"))
        tokens = tokens.withColumn("doc_len", F.size("tokens"))
        corpus = tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.nullif(F.avg("doc_len"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
        # outer: else a filter on the tokens' number goes down to the texts and takes them apart once more
        every = tokens.select("id", "doc_len", F.explode_outer("tokens").alias("term")).where("term is not null")
        if terms is not None:
            every = every.join(terms.select("term").distinct(), "term", "left_semi")
        postings = every.groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf"))
        known = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(corpus.select("n_docs")))
        known = known.select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        return cls(postings, known, corpus)

    def save(self, path: str) -> None:
        for name in ("postings", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus")))

    def matches(self, queries: DataFrame) -> DataFrame:
        """(qid, id, term, w): the weight of each query term in each document that has it. queries: (qid, term).

        The side of the query terms is small or not as the session's statistics say; postings are read by term."""
        known = queries.join(self.terms, "term").join(F.broadcast(self.corpus.select("avgdl")))
        w = okapi(F.col("idf"), F.col("tf"), F.col("doc_len"), F.col("avgdl"))
        return self.postings.join(known, "term").select("qid", "id", "term", "df", "idf", w.alias("w"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(qid, id, score), Okapi BM25, every query term once; documents without a term are left out."""
        return self.matches(queries).groupBy("qid", "id").agg(F.round(F.sum("w"), 6).alias("score"))

    def figure_scores(self, queries: DataFrame) -> DataFrame:
        """(qid, id, weight, rare) for the numeric terms: sum of idf; rare: one of the query's numbers is in at most
        RARE documents of the corpus."""
        numeric = queries.where(F.col("term").rlike(NUMBER_TERM))
        hits = self.matches(numeric)
        rare = numeric.join(self.terms, "term").groupBy("qid").agg(F.max(F.col("df") <= RARE).alias("rare"))
        return hits.groupBy("qid", "id").agg(F.round(F.sum("idf"), 6).alias("weight")).join(rare, "qid")


RARE = 10


def embed(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 64) -> DataFrame:
    """(id, embedding): bag of words hashed to dim buckets, of length 1; a text without words has the zero vector.

    The deterministic stand-in for a model; any other source of (id, embedding) can take its place."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    counts = docs.select(F.col(key).alias("id"), F.explode_outer(words).alias("w")).groupBy("id", hash_bucket(F.col("w"), dim).alias("b")).agg(F.count("w").cast("double").alias("x"))
    held = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "x")))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0))
    return held.select("id", values.alias("embedding"))


def embed_text(drug: Column, ingredient: Column, path: Column, context: Column, text: Column) -> Column:
    """Header, context and text of a chunk, blanks skipped."""
    header = F.concat(drug, F.lit(" ("), ingredient, F.lit(") | "), path)
    return F.concat_ws("\n", *[F.when(c != "", c) for c in (header, context, text)])
