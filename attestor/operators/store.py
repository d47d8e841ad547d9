"""A search index on disk: chunks with their vectors, postings and statistics in one layout, partitioned by label.

    path/chunks    label_key=.../  rows sorted by top_code, then id: text, length in tokens, embedding, all other columns
    path/postings  label_key=.../  a file has the postings of a range of chunks, sorted by term: term, chunk_id, top_code, tf, doc_len
    path/terms     term, df, idf over all chunks
    path/meta      one row, written last: counts, schemas, what the caller adds; without it an index does not open

A search under labels reads their folders only; a filter on top_code is pushed to the files, whose row groups are sorted
by it. Statistics are those of the whole corpus whatever the filter, so that a score does not depend on it. A label with
very many chunks is split over tasks by ranges of its rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import tokenize
from ..sources.shared import staged
from . import search as se
from .dense import dense_top
from .encode import HashModel, Model, encoded
from .index import RARE, LexicalIndex
from .lexical import lexical_top

BOXED_WARNING = "34066-1"
#: Bytes of a row group: small enough that a sorted column's ranges prune.
GROUP_BYTES = 4 << 20
#: Labels of a search that are written into its plan; beyond it the filter is a join only.
PLANNED_LABELS = 500
#: Query terms of a search up to which they are broadcast: some 20 MB at 100 bytes each.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class LabelStore:
    spark: SparkSession
    path: str

    @classmethod
    def write(cls, chunks: DataFrame, path: str, model: Model | None = None, text: str = "text", **extra: str) -> LabelStore:
        """chunks: chunk_id, label_key, top_code, the text that is searched, and columns that are kept. extra goes to meta.
        A null label or code is a label or code of its own, found by no filter; a null text has no token."""
        model = model or HashModel()
        spark, out = chunks.sparkSession, lambda df, name: df.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("label_key").parquet(f"{path}/{name}")
        clash = {"doc_len", "embedding", "tf", "term"} & set(chunks.columns)
        if clash:
            raise ValueError(f"columns of the index's own: {sorted(clash)}")
        order = ["label_key", "top_code", "chunk_id"]
        # only texts are dealt out, once a table: a chunk's vector and its postings are made where its text has gone
        dealt = chunks.repartitionByRange(*order)
        rows = encoded(dealt.withColumn("doc_len", F.size(tokenize(F.col(text)))), model, text)
        out(rows.sortWithinPartitions(*order), "chunks")
        tokens = dealt.select(*order, tokenize(F.col(text)).alias("t")).withColumn("doc_len", F.size("t"))
        # outer: else a filter on the tokens' number goes down to the texts and takes them apart once more
        postings = tokens.select("label_key", "chunk_id", "top_code", "doc_len", F.explode_outer("t").alias("term")).where("term is not null")
        postings = postings.groupBy("label_key", "term", "chunk_id", "top_code", "doc_len").agg(F.count("*").alias("tf"))
        out(postings.sortWithinPartitions("label_key", "term", "chunk_id"), "postings")
        schemas = {"chunks": rows.schema.json(), "postings": postings.schema.json()}
        written = {name: spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f"{path}/{name}") for name, s in schemas.items()}
        corpus = written["chunks"].agg(F.count("*").alias("n_docs"), F.coalesce(F.nullif(F.avg("doc_len"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"), F.countDistinct("chunk_id").alias("n_ids")).first()
        df = written["postings"].groupBy("term").agg(F.count("*").alias("df"))
        terms = df.select("term", "df", F.log(1 + (F.lit(corpus["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        meta = [(corpus["n_docs"], corpus["n_ids"], corpus["avgdl"], model.dim, text, schemas, {k: str(v) for k, v in extra.items()})]
        meta = spark.createDataFrame(meta, "n_docs long, n_ids long, avgdl double, dim int, text string, schemas map<string,string>, extra map<string,string>")
        meta.withColumn("built_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return cls(spark, path)

    @cached_property
    def meta(self):
        return self.spark.read.parquet(f"{self.path}/meta").first()

    def _table(self, name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.meta["schemas"][name]))  # label_key keeps its type, whatever it looks like
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def chunks(self, labels: list[str] | None = None, top_codes: list[str] | None = None) -> DataFrame:
        """Chunks under a filter; none or an empty list means all."""
        return self._filtered(self._table("chunks"), labels, top_codes)

    @staticmethod
    def _filtered(table: DataFrame, labels: list[str] | None, top_codes: list[str] | None) -> DataFrame:
        if labels:
            table = table.where(F.col("label_key").isin(*labels))
        return table.where(F.col("top_code").isin(*top_codes)) if top_codes else table

    def lexical(self, labels: list[str] | None = None, top_codes: list[str] | None = None) -> LexicalIndex:
        postings = self._filtered(self._table("postings"), labels, top_codes).withColumnRenamed("chunk_id", "id")
        corpus = self.spark.range(1).select(F.lit(self.meta["n_docs"]).alias("n_docs"), F.lit(self.meta["avgdl"]).alias("avgdl"))
        return LexicalIndex(postings, self.spark.read.parquet(f"{self.path}/terms"), corpus)

    def get(self, ids: list[str]) -> DataFrame:
        return self.chunks().where(F.col("chunk_id").isin(*ids))

    def boxed_warning(self, labels: list[str]) -> DataFrame:
        """The boxed warnings of labels: two folders' worth of pruned row groups, no search."""
        return self.chunks(labels, [BOXED_WARNING])

    def lists(self, queries: DataFrame, model: Model | None = None, labels: list[str] | None = None, top_codes: list[str] | None = None, depth: int = se.DEPTH, dense: bool = True, bm25: bool = True, numbers: bool = True, full: bool = False):
        """The three scored lists (qid, id, score; of figures also weight and rare) of queries (qid, text); a list that is off is
        None. They hold the best `depth` of each query, and maybe others; full: the lexical ones hold all that share a term.

        A query's own filter stands in columns label_keys or top_codes (arrays; null or empty: all)."""
        queries = staged(queries, "queries")
        own = [(c, a) for c, a in (("label_key", "label_keys"), ("top_code", "top_codes")) if a in queries.columns]
        for column, array in own:
            every = F.array(F.lit(None).cast("string"))
            queries = queries.withColumn(column, F.explode(F.when(F.size(array) > 0, F.array_distinct(array)).otherwise(every)))
        if own and own[0][0] == "label_key" and not labels:
            asked = [r[0] for r in queries.select("label_key").distinct().limit(PLANNED_LABELS + 1).collect()]
            labels = asked if len(asked) <= PLANNED_LABELS and None not in asked else None
        keys = [c for c, _ in own]
        agree = lambda a, b: [a[c].eqNullSafe(b[c]) | b[c].isNull() for c in keys]
        scored = weighed = near = None
        if bm25 or numbers:
            index = self.lexical(labels, top_codes)
            terms = queries.select("qid", *keys, F.explode(se.query_terms(F.col("text"))).alias("term"))
            known = terms.join(index.terms, "term").join(F.broadcast(index.corpus.select("avgdl"))).withColumn("number", F.col("term").rlike(se.NUMBER_TERM))
            known = staged(known, "known")
            # postings stay where they are for as many query terms as a broadcast holds
            known = F.broadcast(known) if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else known
            rare = known.where("number").groupBy("qid").agg(F.max(F.col("df") <= RARE).alias("rare"))
            if full or self.meta["n_ids"] < self.meta["n_docs"]:
                posts, idf = index.postings, F.when(F.col("number"), F.col("idf"))
                met = posts.join(known, [posts["term"] == known["term"], *agree(posts, known)])
                w = se.okapi(F.col("idf"), F.col("tf"), F.col("doc_len"), F.col("avgdl"))
                sums = met.groupBy("qid", "id").agg(F.round(F.sum(w), 6).alias("score"), F.round(F.sum(idf), 6).alias("weight"))
                scored, weighed = sums.select("qid", "id", "score"), sums.where("weight is not null")
            else:
                found = self._met(index, known, keys, depth)
                scored, weighed = (found.where(F.col("list") == name) for name in ("bm25", "number"))
                scored = scored.select("qid", "id", "score")
            weighed = weighed.select("qid", "id", "weight", "score").join(rare, "qid") if numbers else None
        if dense:
            vectors = self.chunks(labels, top_codes).select(F.col("chunk_id").alias("id"), "embedding", *keys)
            asked = staged(encoded(queries, model or HashModel()).select("qid", "embedding", *keys), "vectors")
            near = self._near(vectors, asked, keys, depth)
        return near, scored, weighed

    def _met(self, index: LexicalIndex, known: DataFrame, keys: list[str], depth: int) -> DataFrame:
        """The two lexical lists of lexical_top, of queries by the filters of their own that they have."""
        words = staged(known.select("term", "idf").distinct().withColumn("word", F.monotonically_increasing_id()), "words")
        asked = known.join(words.select("term", "word"), "term").select("qid", F.col("word").alias("term"), F.when(F.col("number"), F.col("idf")).otherwise(0.0).alias("x"), *keys)
        few = words.count() <= BROADCAST_TERMS
        w = se.okapi(F.col("idf"), F.col("tf"), F.col("doc_len"), F.lit(self.meta["avgdl"]))
        posts = index.postings.join(F.broadcast(words) if few else words, "term").select("id", F.col("word").alias("term"), w.alias("x"), *keys)
        out, asked = None, staged(asked, "terms")
        given = [F.col(c).isNotNull().alias(c) for c in keys]
        for mask in (asked.select(*given).distinct().collect() if keys else []) or [[True] * len(keys)]:  # four kinds at most
            on = tuple(c for c, yes in zip(keys, mask) if yes)
            part = asked
            for c in keys:
                part = part.where(F.col(c).isNotNull() if c in on else F.col(c).isNull())
            found = lexical_top(posts, part, depth, self.meta["n_docs"], on)
            out = found if out is None else out.unionByName(found)
        return staged(out, "met")

    def _near(self, vectors: DataFrame, asked: DataFrame, keys: list[str], depth: int) -> DataFrame:
        """Queries without a filter of their own meet all rows, the others those that agree."""
        if not keys:
            return dense_top(vectors, asked, depth)
        out, given = None, [F.col(c).isNotNull().alias(c) for c in keys]
        for mask in asked.select(*given).distinct().collect() or [[True] * len(keys)]:  # four kinds at most
            on = tuple(c for c, yes in zip(keys, mask) if yes)
            part = asked
            for c in keys:
                part = part.where(F.col(c).isNotNull() if c in on else F.col(c).isNull())
            found = dense_top(vectors.select("id", "embedding", *on), part.select("qid", "embedding", *on), depth, on)
            out = found if out is None else out.unionByName(found)
        return out.dropDuplicates(["qid", "id"])

    def search(self, queries: DataFrame, k: int = 8, model: Model | None = None, labels: list[str] | None = None, top_codes: list[str] | None = None, dense: bool = True, bm25: bool = True, numbers: bool = True) -> DataFrame:
        """Hybrid search: (qid, id, rank, score, dense_rank, bm25_rank, number_rank, pinned)."""
        near, scored, weighed = self.lists(queries, model, labels, top_codes, dense=dense, bm25=bm25, numbers=numbers)
        return se.fuse(near, scored if bm25 else None, weighed, k, ties=scored)

    def production(self, claims: DataFrame, k: int = 5, model: Model | None = None, labels: list[str] | None = None) -> DataFrame:
        """What a reviewer's judge is shown: hits of the full search, after the best chunks of the sections that govern a
        claim's kind. claims: qid, text, kind, and filters of their own as in lists."""
        hits = staged(self.search(claims, k, model, labels), "hits")
        routes = claims.sparkSession.createDataFrame([(kind, codes) for kind, codes in se.ROUTES.items()], "kind string, codes array<string>")
        routed = claims.join(F.broadcast(routes), "kind").withColumn("code", F.explode("codes"))
        named = routed.withColumn("qid_code", F.to_json(F.struct("qid", "code")))
        asked = named.select(F.col("qid_code").alias("qid"), "text", F.array("code").alias("top_codes"), *(["label_keys"] if "label_keys" in claims.columns else []))
        governed = staged(self.search(staged(asked, "asked"), se.ROUTED + 1, model, labels), "governed").withColumnRenamed("qid", "qid_code")
        governed = governed.join(named.select("qid_code", "qid", "code"), "qid_code").select("qid", "id", "code", "rank", "score")
        return se.gather(hits.select("qid", "id", "rank"), governed, claims.select("qid", "kind"), k)
