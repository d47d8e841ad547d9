"""Aggregates over evaluated claims: rates with and without guards, confusion, intervals, bootstrap, reports."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from .guards import VERDICTS

# Fixed values ---------------------------------------------------------------------------------------------------
RESAMPLES, SEED, KEY = 2000, 7, "card"
DEV_INGREDIENTS = ("semaglutide", "tirzepatide")
#: Of each construction the true verdict, the verdicts that name its problem, and the violations it commits.
EXPECTED = {
    "faithful": ("supported", ["supported"], []),
    "drop_qualifier": ("needs_qualifier", ["needs_qualifier", "off_label", "unsupported"], ["omitted_qualifier", "broadened_indication"]),
    "broaden": ("off_label", ["off_label", "contradicted", "unsupported"], ["broadened_indication"]),
    "inflate": ("contradicted", ["contradicted", "unsupported"], ["overstated_efficacy"]),
    "superiority": ("unsupported", ["unsupported", "contradicted"], ["unsubstantiated_superiority"]),
    "absolute": ("unsupported", ["unsupported", "contradicted", "needs_qualifier"], ["unsupported_absolute_claim", "overstated_efficacy"]),
    "deny_risk": ("contradicted", ["contradicted", "unsupported"], ["minimized_risk"]),
    "contradict": ("contradicted", ["contradicted", "off_label", "unsupported"], ["minimized_risk", "broadened_indication"]),
    "wrong_dose": ("contradicted", ["contradicted", "off_label", "unsupported"], []),
}
# -----------------------------------------------------------------------------------------------------------------


def outcome(status: Column, model: Column, guards: bool) -> Column:
    """With guards the final status; without, what the model said, and a silent model is a human's case."""
    return status if guards else F.coalesce(model, F.lit("needs_human_review"))


def rates(rows: DataFrame, by: list[str], guards: bool = True) -> DataFrame:
    """Counts, false-approval rate, recall of faithful claims, share named right and sent to a human, by group.

    rows: gold, accept array, violations array, status, model_verdict, tags array, and the columns of `by`."""
    x = rows.withColumn("o", outcome(F.col("status"), F.col("model_verdict"), guards)).withColumn("bad", F.col("gold") != "supported")
    approved, share = F.col("o") == "supported", lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    bad, good = F.when(F.col("bad"), F.when(approved, 1.0).otherwise(0.0)), F.when(~F.col("bad"), F.when(approved, 1.0).otherwise(0.0))
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("bad").alias("n_violative"), F.count_if(F.col("bad") & approved).alias("n_false_approved"),
        F.round(F.avg(bad), 6).alias("false_approval"), F.round(F.avg(good), 6).alias("recall"),
        share(F.array_contains("accept", F.col("o"))).alias("named"), share(F.col("o") == "needs_human_review").alias("human"),
        F.round(F.avg(F.when(F.size("violations") > 0, F.when(F.arrays_overlap("violations", "tags"), 1.0).otherwise(0.0))), 6).alias("tag_match"),
    )


def by_op(rows: DataFrame, op: str = "op", status: str = "status", verdicts: tuple[str, ...] = (*VERDICTS, "needs_human_review")) -> DataFrame:
    return rows.groupBy(op).pivot(status, list(verdicts)).count().na.fill(0)


def confusion(rows: DataFrame, op: str = "op", status: str = "status") -> DataFrame:
    return rows.groupBy(F.concat(F.col(op), F.lit(" -> "), F.col(status)).alias("pair")).agg(F.count("*").alias("n"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at n // 2 of each group in order, by a count and a rank: no group is collected."""
    w = Window.partitionBy(*by)
    ranked = rows.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    return ranked.where("r = floor(n / 2) + 1").select(*by, F.col(value).alias("median"))


def with_interval(df: DataFrame, k: str, n: str) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumns({"low": low, "high": high})


def bootstrap_bounds(clusters: list[tuple[float, float]], n: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """95 % bounds of sum(k) / sum(n) over resamples of whole clusters."""
    r, out = random.Random(seed), []
    for _ in range(n):
        drawn = [r.choice(clusters) for _ in clusters]
        total = sum(c[1] for c in drawn)
        out.append(sum(c[0] for c in drawn) / total if total else 0.0)
    out.sort()
    return out[int(0.025 * n)], out[int(0.975 * n) - 1]


def cluster_bootstrap(rows: DataFrame, by: list[str], cluster: str, hit: str, n: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(by, share, low, high). Clusters are summed before; what is resampled is one pair of numbers a cluster."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(F.when(F.col(hit), 1.0).otherwise(0.0)).alias("k"), F.count("*").cast("double").alias("n"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster, kind="stable")
        low, high = bootstrap_bounds(list(zip(pdf["k"], pdf["n"])), n, seed)
        return pd.DataFrame([[*key, round(pdf["k"].sum() / pdf["n"].sum(), 6), round(low, 6), round(high, 6)]], columns=[*by, "share", "low", "high"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by) + ", share double, low double, high double"
    return sums.groupBy(*by).applyInPandas(run, schema)


def layers(rows: DataFrame) -> DataFrame:
    """Attacks that end as supported after the model, after the guards and at the end, with intervals.
    rows: model_verdict, guard_status, status."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("layer"), (F.col(c) == "supported").alias("hit")) for i, (name, c) in enumerate((("model", "model_verdict"), ("guards", "guard_status"), ("final", "status")))])).alias("x")).select("x.*")
    return with_interval(long.groupBy("ord", "layer").agg(F.count_if("hit").alias("k"), F.count("*").alias("n")), "k", "n")


def guard_status(trace: Column, final: Column) -> Column:
    """The status of the first guards step of a trace (array of structs step, status), else the final one."""
    return F.coalesce(F.get(F.filter(trace, lambda t: t["step"] == "guards"), F.lit(0))["status"], final)


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose interval [start, end) meets one of b's with the same key (columns lo, hi there)."""
    return a.join(b, (a[key] == b[key]) & (a["start"] < b["hi"]) & (a["end"] > b["lo"]), "left_semi")


def problems(cards: DataFrame, claims: DataFrame, ops: list[str]) -> DataFrame:
    """(problem, id) of a benchmark that must not be built: repeated ids, unknown ops, claims without a card."""
    twice = claims.groupBy("id").count().where("count > 1").select(F.lit("duplicate id").alias("problem"), "id")
    odd = claims.where(~F.col("op").isin(ops)).select(F.lit("unknown op").alias("problem"), "id")
    lone = claims.join(cards.select("card"), "card", "left_anti").select(F.lit("missing card").alias("problem"), "id")
    return twice.unionByName(odd).unionByName(lone)


def expected(spark) -> DataFrame:
    rows = [(op, *x) for op, x in EXPECTED.items()]
    return spark.createDataFrame(rows, "op string, gold string, accept array<string>, violations array<string>")


def build_benchmark(cards: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (id, card, op, text) with what their construction makes of them and the split of their card's ingredient.

    Refuses to build if an id repeats, an op is unknown or a card is missing: says how often and names a hundred."""
    wrong = problems(cards, claims, list(EXPECTED))
    if n := wrong.count():
        named = sorted(f"{r['problem']}: {r['id']}" for r in wrong.orderBy("problem", "id").limit(100).collect())
        raise ValueError(f"{n} problems: " + "; ".join(named))
    split = F.when(F.col("ingredient").isin(*DEV_INGREDIENTS), "dev").otherwise("test")
    return claims.join(F.broadcast(expected(claims.sparkSession)), "op").join(cards, "card").withColumn("split", split)
