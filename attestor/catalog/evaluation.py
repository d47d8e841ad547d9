"""Evaluation aggregates over the driver's tables; labels play the verdicts of a judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from .tables import read, values


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labels as evaluated claims: quality is the truth, toxicity and the id shape the answers."""
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    gold = F.when(F.col("quality") == 1, "supported").otherwise("contradicted")
    model = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 3 == 0, "supported").when(F.col("toxic") == 1, "contradicted").otherwise(gold)
    status = F.when(F.col("doc_id") % 7 == 0, "needs_human_review").otherwise(F.coalesce(model, F.lit("needs_human_review")))
    array = lambda c: F.array(c)
    return rows.select(
        "doc_id", "lang", "source", "n_chars", gold.alias("gold"), model.alias("model_verdict"), status.alias("status"), array(gold).alias("accept"),
        F.when(F.col("toxic") == 1, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("violations"), F.array(F.when(F.col("doc_id") % 2 == 0, "t").otherwise("u")).alias("tags"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "faithful").otherwise("junk").alias("op"),
    )


def rates_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return ev.rates(_rows(spark, d), ["lang"], guards=True)


def rates_without_guards(spark: SparkSession, d: str) -> DataFrame:
    return ev.rates(_rows(spark, d), ["lang"], guards=False)


def op_pivot(spark: SparkSession, d: str) -> DataFrame:
    return ev.by_op(_rows(spark, d))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(_rows(spark, d))


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return ev.upper_median(_rows(spark, d), ["lang"], "n_chars")


def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    k = _rows(spark, d).groupBy("source").agg(F.count_if(F.col("gold") == "supported").alias("k"), F.count("*").alias("n"))
    return ev.with_interval(k, "k", "n")


WILSON = [(55, 132), (0, 42), (0, 78), (0, 0), (10, 10)]


def wilson_goldens(spark: SparkSession, d: str) -> DataFrame:
    return ev.with_interval(values(spark, WILSON, "k long, n long"), "k", "n")


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("hit", F.col("gold") == F.col("status"))
    return ev.cluster_bootstrap(rows, ["lang"], "source", "hit")


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    return r.groupBy("source").agg(F.sum("n_chars").alias("tokens"), F.round(F.avg("n_chars"), 6).alias("mean"), F.count_if(F.col("model_verdict").isNull()).alias("unanswered"), F.count_if(F.col("n_chars") > 1000).alias("live"))


def redteam_layers(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("guard_status", F.when(F.col("doc_id") % 5 == 0, "needs_human_review").otherwise(F.coalesce("model_verdict", F.lit("needs_human_review"))))
    return ev.layers(rows).select("layer", "k", "n", "low", "high")


def detector_table(spark: SparkSession, d: str) -> DataFrame:
    """Labelled texts as attacks (toxic) and benign ones, a score from the length as the classifier."""
    r = _rows(spark, d).select((F.col("op") == "toxic").alias("attack"), (F.col("doc_id") % 4 == 0).alias("pattern"), (F.col("n_chars") > 3000).alias("scored"))
    return r.groupBy("attack").agg(F.count("*").alias("n"), F.count_if("pattern").alias("patterns"), F.count_if(F.col("pattern") | F.col("scored")).alias("both"), F.count_if("scored").alias("alone"))


def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks on a line of their source, items as spans."""
    docs = read(spark, d, "documents").select("doc_id", F.expr("cast(substring(source, 4) as int)").alias("g"), (F.col("doc_id") * 10).alias("start"), (F.col("doc_id") * 10 + F.col("n_chars") % 100).alias("end"))
    spans = read(spark, d, "benchmark").select(F.expr("cast(item_id % 20 as int)").alias("g"), (F.col("item_id") * 100).alias("lo"), (F.col("item_id") * 100 + 37).alias("hi"))
    return ev.overlapping(docs, spans, "g").select("doc_id")


def grouping_sets_report(spark: SparkSession, d: str) -> DataFrame:
    _rows(spark, d).createOrReplaceTempView("_rows")
    return spark.sql("SELECT coalesce(lang, '*') AS lang, coalesce(op, '*') AS op, count(*) AS n, count_if(status = 'supported') AS k FROM _rows GROUP BY GROUPING SETS ((), (lang), (op))")


def outcome_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells op x status with their shade in five steps of the largest, and whether they are a false approval."""
    from pyspark.sql import Window

    c = _rows(spark, d).groupBy("op", "status").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.lit(0)))  # op x status rows
    return c.select("op", "status", "n", F.least(F.lit(5), F.ceil(5 * F.col("n") / most)).cast("long").alias("shade"), ((F.col("op") != "faithful") & (F.col("status") == "supported")).alias("bad"))


def false_approvals(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    kind = F.when((F.col("gold") != "supported") & (F.col("status") == "supported"), "false approval").when((F.col("gold") != "supported") & (F.col("model_verdict") == "supported"), "stopped by guards").when((F.col("gold") == "supported") & (F.col("status") != "supported"), "faithful missed")
    return r.select("doc_id", kind.alias("kind")).where("kind is not null")


CARDS = [("c1", "a"), ("c2", "b")]
CLAIMS = [("c1-1", "c1", "faithful"), ("c1-1", "c1", "inflate"), ("c2-1", "c2", "nonsense"), ("c9-1", "c9", "faithful")]


def benchmark_problems(spark: SparkSession, d: str) -> DataFrame:
    return ev.problems(values(spark, CARDS, "card string, label string"), values(spark, CLAIMS, "id string, card string, op string"), list(ev.EXPECTED))


def benchmark_expected(spark: SparkSession, d: str) -> DataFrame:
    return ev.expected(spark).select("op", "gold", F.array_join("accept", ",").alias("accept"), F.array_join("violations", ",").alias("violations"))


_ROWS = """r AS (SELECT l.doc_id, lang, source, n_chars, quality, toxic, CASE WHEN quality = 1 THEN 'supported' ELSE 'contradicted' END AS gold FROM labels l JOIN documents USING (doc_id)),
m AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'supported' WHEN toxic = 1 THEN 'contradicted' ELSE gold END AS model_verdict,
  CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'faithful' ELSE 'junk' END AS op FROM r),
x AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'needs_human_review' ELSE coalesce(model_verdict, 'needs_human_review') END AS status FROM m)"""


def _rates(o: str) -> str:
    return f"""WITH {_ROWS}, y AS (SELECT *, {o} AS o FROM x) SELECT lang, count(*) AS n, count(*) FILTER (gold <> 'supported') AS n_violative,
 count(*) FILTER (gold <> 'supported' AND o = 'supported') AS n_false_approved, round(avg((o = 'supported')::INT) FILTER (gold <> 'supported'), 6) AS false_approval,
 round(avg((o = 'supported')::INT) FILTER (gold = 'supported'), 6) AS recall, round(avg((o = gold)::INT), 6) AS named, round(avg((o = 'needs_human_review')::INT), 6) AS human,
 round(avg((doc_id % 2 = 0)::INT) FILTER (toxic = 1), 6) AS tag_match FROM y GROUP BY lang"""


_LOW = "CASE WHEN n > 0 THEN round(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 3) ELSE 0.0 END AS low"
_HIGH = "CASE WHEN n > 0 THEN round(least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 3) ELSE 0.0 END AS high"
_STATUSES = ("supported", "contradicted", "needs_qualifier", "off_label", "unsupported", "needs_human_review")

QUERIES = {
    "rates_by_lang": (rates_by_lang, _rates("status")),
    "rates_without_guards": (rates_without_guards, _rates("coalesce(model_verdict, 'needs_human_review')")),
    "op_pivot": (op_pivot, f"WITH {_ROWS} SELECT op, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _STATUSES) + " FROM x GROUP BY op"),
    "confusion": (confusion, f"WITH {_ROWS} SELECT op || ' -> ' || status AS pair, count(*) AS n FROM x GROUP BY 1"),
    "upper_median": (upper_median, f"WITH {_ROWS} SELECT lang, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM x GROUP BY lang"),
    "wilson_ci": (wilson_ci, f"WITH {_ROWS}, w AS (SELECT source, count(*) FILTER (gold = 'supported') AS k, count(*) AS n FROM x GROUP BY source) SELECT source, k, n, {_LOW}, {_HIGH} FROM w"),
    "wilson_goldens": (wilson_goldens, "SELECT * FROM (VALUES (55, 132, 0.336, 0.502), (0, 42, 0.0, 0.084), (0, 78, 0.0, 0.047), (0, 0, 0.0, 0.0), (10, 10, 0.722, 1.0)) AS t(k, n, low, high)"),
    "cluster_bootstrap": (cluster_bootstrap, None),
    "token_totals": (token_totals, f"WITH {_ROWS} SELECT source, sum(n_chars)::BIGINT AS tokens, round(avg(n_chars), 6) AS mean, count(*) - count(model_verdict) AS unanswered, count(*) FILTER (n_chars > 1000) AS live FROM x GROUP BY source"),
    "redteam_layers": (redteam_layers, f"WITH {_ROWS}, g AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'needs_human_review' ELSE coalesce(model_verdict, 'needs_human_review') END AS gs FROM x), u AS (SELECT unnest(['model', 'guards', 'final']) AS layer, unnest([model_verdict, gs, status]) AS s FROM g), w AS (SELECT layer, count(*) FILTER (s = 'supported') AS k, count(*) AS n FROM u GROUP BY layer) SELECT layer, k, n, {_LOW}, {_HIGH} FROM w"),
    "detector_table": (detector_table, f"WITH {_ROWS} SELECT op = 'toxic' AS attack, count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS patterns, count(*) FILTER (doc_id % 4 = 0 OR n_chars > 3000) AS \"both\", count(*) FILTER (n_chars > 3000) AS alone FROM x GROUP BY 1"),
    "interval_overlap_join": (interval_overlap_join, "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE item_id % 20 = substring(source, 4)::INT AND doc_id * 10 < item_id * 100 + 37 AND doc_id * 10 + n_chars % 100 > item_id * 100)"),
    "grouping_sets_report": (grouping_sets_report, f"WITH {_ROWS} SELECT coalesce(lang, '*') AS lang, coalesce(op, '*') AS op, count(*) AS n, count(*) FILTER (status = 'supported') AS k FROM x GROUP BY GROUPING SETS ((), (lang), (op))"),
    "outcome_grid": (outcome_grid, f"WITH {_ROWS}, c AS (SELECT op, status, count(*) AS n FROM x GROUP BY ALL) SELECT op, status, n, least(5, ceil(5 * n / max(n) OVER ()))::BIGINT AS shade, op <> 'faithful' AND status = 'supported' AS bad FROM c"),
    "false_approvals": (false_approvals, f"WITH {_ROWS}, k AS (SELECT doc_id, CASE WHEN gold <> 'supported' AND status = 'supported' THEN 'false approval' WHEN gold <> 'supported' AND model_verdict = 'supported' THEN 'stopped by guards' WHEN gold = 'supported' AND status <> 'supported' THEN 'faithful missed' END AS kind FROM x) SELECT * FROM k WHERE kind IS NOT NULL"),
    "benchmark_problems": (benchmark_problems, "SELECT * FROM (VALUES ('duplicate id', 'c1-1'), ('unknown op', 'c2-1'), ('missing card', 'c9-1')) AS t(problem, id)"),
    "benchmark_expected": (benchmark_expected, None),
}
