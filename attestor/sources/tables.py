"""Readers and writers around the tables: manifests, answer caches, benchmark lines, reports, audits, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CACHE = "key string, model_key string, prompt_version string, schema string, response string, usage struct<prompt_tokens:int,completion_tokens:int>, _damaged string"
JUDGE = "reasoning string, verdict string, violations array<string>, evidence array<struct<chunk_id:string,quote:string>>"
VIOLATIONS_OF = {"JudgeOutput": JUDGE, "Rewrite": "rewrite string", "ClaimList": "claims array<struct<text:string,kind:string>>"}


def answer_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached model answers, one JSON file each, sharded by the first two digits of the key; any damage is a miss."""
    df = spark.read.schema(CACHE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").option("recursiveFileLookup", True).json(path)
    usable = F.col("_damaged").isNull() & (F.length("key") == 64)
    return df.where(usable).select("key", "model_key", "prompt_version", "schema", "response", "usage")


def answers(cache: DataFrame, schema: str) -> DataFrame:
    """The cached answers of one schema, parsed; an answer that does not fit is none."""
    parsed = F.from_json("response", VIOLATIONS_OF[schema], {"mode": "PERMISSIVE"})
    return cache.where(F.col("schema") == schema).withColumn("answer", parsed).where(F.col("answer").isNotNull())


def put_answers(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after an upsert: one row a key, the new one if there is one."""
    both = cache.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    w = Window.partitionBy("key").orderBy(F.desc("_age"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_age")


def write_cache(cache: DataFrame, path: str) -> None:
    cache.withColumn("shard", F.substring("key", 1, 2)).write.partitionBy("shard").mode("overwrite").json(path)


def pick(listing: DataFrame, specs: DataFrame) -> DataFrame:
    """Of a drug's listing (key, title, manufacturer, set_id, spl_version) the hit to load: the maker's own, titles
    that begin with the query before others, the latest version."""
    met = listing.join(F.broadcast(specs.withColumnRenamed("manufacturer", "maker")), "key")
    met = met.where(F.contains(F.upper("title"), F.upper("maker")))
    branded = F.startswith(F.lower("title"), F.lower("query"))
    w = Window.partitionBy("key").orderBy(F.desc(branded), F.desc("spl_version"), "set_id")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_hit(listing: DataFrame, specs: DataFrame) -> DataFrame:
    """(key, message) of drugs for which pick finds nothing, with the titles that were listed: a loader stops at these."""
    lost = specs.select("key", "manufacturer").join(pick(listing, specs).select("key"), "key", "left_anti")
    titles = listing.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("title")), ", ").alias("titles"))
    message = F.concat(F.col("key"), F.lit(": no label from "), "manufacturer", F.lit(": ["), F.coalesce("titles", F.lit("")), F.lit("]"))
    return lost.join(titles, "key", "left").select("key", message.alias("message"))


def drift(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """(label_key, state): new, gone, changed, newer or same, by digest and version against the pinned manifest."""
    a, b = (df.select("label_key", F.col("xml_sha256").alias(f"sha_{n}"), F.col("version").alias(f"v_{n}")) for df, n in ((found, "now"), (pinned, "pin")))
    state = F.when(F.col("sha_pin").isNull(), "new").when(F.col("sha_now").isNull(), "gone").when(F.col("v_now") > F.col("v_pin"), "newer").when(F.col("sha_now") != F.col("sha_pin"), "changed").otherwise("same")
    return a.join(b, "label_key", "full_outer").select("label_key", state.alias("state"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest (one JSON object of entries by label key) as rows; a missing file is an empty manifest."""
    entry = "map<string,struct<set_id:string,version:int,effective_time:string,products:array<string>,generic:string,ingredient:string,role:string,xml_sha256:string,n_sections:int,fetched_on:string>>"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        text = spark.createDataFrame([], "value string")
    else:
        text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", entry)).alias("label_key", "e")).select("label_key", "e.*")


def write_manifest(entries: DataFrame, path: str) -> None:
    """Sorted by key, one object a line."""
    entries.orderBy("label_key").coalesce(1).write.mode("overwrite").json(path)


def benchmark(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """Benchmark lines of a split; none or "all" means every line. The filter is pushed to the scan."""
    df = spark.read.schema(schema).json(path)
    return df if split in (None, "all") else df.where(F.col("split") == split)


def reports(spark: SparkSession, pattern: str) -> DataFrame:
    """(stem, value): report files by their name without the ending."""
    df = spark.read.option("wholetext", True).text(pattern)
    return df.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("stem"), "value")


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A report as JSON rows and as a Markdown table beside it."""
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    names = rows.columns
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in names])
    head = rows.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(names) + " |"), (3, "|" + "---|" * len(names))], "n int, value string")
    body = rows.select(F.lit(4).alias("n"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(f"{path}/md")


def text_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)
