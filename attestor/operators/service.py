"""What a review service keeps in tables: events, queue, retention, quotas, model answers, decisions, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------
TERMINAL = ("done", "error")
KEEP_JOBS, TTL_SECONDS = 200, 3600
PER_HOUR, PER_DAY = 20, 300
HEADROOM, LEDGER_SECONDS = 0.88, 60
CLAIM_CHARS, COPY_CHARS, MAX_LABELS = (8, 600), (20, 4000), 5
# -----------------------------------------------------------------------------------------------------------------


def event_log(events: DataFrame, job: str, order: list[str], event: str = "event") -> DataFrame:
    """events with dense ids from 0 in each job; what comes after a terminal event is dropped."""
    w = Window.partitionBy(job).orderBy(*order)
    ended = F.count_if(F.col(event).isin(*TERMINAL)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = events.withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0").drop("_ended")
    return numbered.withColumn("id", (F.row_number().over(w) - 1).cast("long"))


def since(log: DataFrame, last_seen: Column) -> DataFrame:
    """What a client that has seen up to an id still has to get."""
    return log.where(F.col("id") > last_seen)


def fold(log: DataFrame, job: str, kind: str = "event", value: str = "data") -> DataFrame:
    """(job, state, last_id, n_claims, error): the state that a client folds the events into; an error stays."""
    return log.groupBy(job).agg(
        F.max_by(kind, "id").alias("last_event"), F.max("id").alias("last_id"),
        F.count_if(F.col(kind) == "claim").alias("n_claims"),
        F.when(F.count_if(F.col(kind) == "error") > 0, "error").when(F.count_if(F.col(kind) == "done") > 0, "done").when(F.count_if(F.col(kind) == "start") > 0, "running").otherwise("queued").alias("state"),
        F.min_by(value, F.when(F.col(kind) == "error", F.col("id"))).alias("error"),
    )


def latest(log: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Last write wins for each key; a null value takes the entry away."""
    return log.groupBy(*keys).agg(F.max_by(value, order).alias(value)).where(F.col(value).isNotNull())


def queue_position(jobs: DataFrame, job: str, created: str, finished: str, blocks: int = 64) -> DataFrame:
    """jobs with ahead: how many earlier ones were not finished when it came. A single worker finishes in order, so
    that the finish times rise with the creation times and earlier minus finished-by-then is the answer.

    Running sums over the whole log: blocks of time between quantiles are summed apart, each from the totals of the
    blocks before it, which are as many rows as there are blocks."""
    marks = jobs.select(job, F.col(created).alias("at"), F.lit(1).alias("came"), F.lit(0).alias("left")).unionByName(
        jobs.where(F.col(finished).isNotNull()).select(F.lit(None).cast(jobs.schema[job].dataType).alias(job), F.col(finished).alias("at"), F.lit(0).alias("came"), F.lit(1).alias("left"))
    )
    cuts = marks.agg(F.percentile_approx(F.col("at").cast("double"), [(i + 1) / blocks for i in range(blocks - 1)]).alias("cuts"))
    block = F.size(F.filter("cuts", lambda c: c < F.col("at").cast("double")))
    marks = marks.join(F.broadcast(cuts)).withColumn("block", block).drop("cuts")
    totals = marks.groupBy("block").agg(F.sum(F.col("came") - F.col("left")).alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    w = Window.partitionBy("block").orderBy("at", F.desc("left"), job)
    ahead = F.col("before") + F.sum(F.col("came") - F.col("left")).over(w) - 1
    counted = marks.join(F.broadcast(totals), "block").withColumn("ahead", ahead)
    return jobs.join(counted.where("came = 1").select(job, F.greatest(F.lit(0), "ahead").cast("long").alias("ahead")), job)


def retained(jobs: DataFrame, created: str, finished: str, now: Column, job: str, keep: int = KEEP_JOBS) -> DataFrame:
    """Jobs that stay: not finished, or created no longer than the time to live ago, and of those the newest."""
    fresh = jobs.where(F.col(finished).isNull() | (now.cast("double") - F.col(created).cast("double") <= TTL_SECONDS))
    return fresh.orderBy(F.desc(created), F.desc(job)).limit(keep)


def trailing(events: DataFrame, keys: list[str], seconds_of: Column, seconds: int, value: Column, closed: bool) -> DataFrame:
    """events with `trailing`: the sum of value over the last seconds, itself included. closed: an event exactly that
    old still counts."""
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-seconds if closed else -seconds + 1, 0)
    return events.withColumn("_t", seconds_of.cast("long")).withColumn("_v", value).withColumn("trailing", F.sum("_v").over(w)).drop("_t", "_v")


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The last entry of X-Forwarded-For, which the nearest proxy wrote; without one the peer."""
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(F.nullif(last, F.lit("")), peer)


def request_problem(kind: Column, text: Column, labels: Column, known: list[str]) -> Column:
    """Why a request is refused, or null."""
    n = F.length(F.coalesce(text, F.lit("")))
    low, high = (F.when(kind == "claim", CLAIM_CHARS[i]).otherwise(COPY_CHARS[i]) for i in (0, 1))
    unknown = F.array_sort(F.array_except(labels, F.array(*[F.lit(k) for k in known])))
    return (
        F.when((n < low) | (n > high), F.concat(F.lit("length "), n.cast("string")))
        .when(F.size(labels) > MAX_LABELS, "too many labels")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown labels: "), F.array_join(unknown, ", ")))
    )


def first_accepted(attempts: DataFrame, key: str, order: str, answer: str, accepted: Column) -> DataFrame:
    """(key, answer, used, attempts): of a chain of models the first answer that is accepted; the ones before it count
    as attempts, what comes after was never asked."""
    ok = attempts.withColumn("_ok", accepted)
    best = ok.groupBy(key).agg(F.min(F.when(F.col("_ok"), F.col(order))).alias("used"), F.min_by(answer, F.when(F.col("_ok"), F.col(order))).alias("answer"))
    asked = ok.join(best, key).where(F.col("used").isNull() | (F.col(order) <= F.col("used")))
    return asked.groupBy(key, "used", "answer").agg(F.count("*").alias("attempts"))


def cached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked (key, ...) with response and hit; damaged entries, those without a response, are misses."""
    good = cache.where(F.col("response").isNotNull()).groupBy("key").agg(F.first("response").alias("response"))
    return asked.join(good, "key", "left").withColumn("hit", F.col("response").isNotNull())


def cache_key(*parts: Column) -> Column:
    """Name of a call: sha256 of its parts as a JSON array."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def segments(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, start, end, n): a text as its claims (n) and the stretches between them (n null), in reading order.
    spans: key, n, start, end, not overlapping; texts: key, length."""
    w = Window.partitionBy(key).orderBy("start")
    after = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = spans.withColumn("from", after).where("start > from").select(key, F.col("from").alias("start"), F.col("start").alias("end"), F.lit(None).cast("long").alias("n"))
    ends = texts.join(spans.groupBy(key).agg(F.max("end").alias("e")), key, "left").withColumn("e", F.coalesce("e", F.lit(0)))
    ends = ends.where("e < length").select(key, F.col("e").alias("start"), F.col("length").alias("end"), F.lit(None).cast("long").alias("n"))
    return spans.select(key, "start", "end", F.col("n").cast("long").alias("n")).unionByName(gaps).unionByName(ends)


def next_with_status(reviews: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """asked (key, from, status) with next: the next claim of the status after `from`, wrapping; else `from`."""
    met = asked.join(reviews.select(key, F.col("status").alias("_s"), "n"), (asked[key] == reviews[key]) & (asked["status"] == F.col("_s")), "left").drop(reviews[key])
    return met.groupBy(key, "from", "status").agg(F.coalesce(F.min(F.when(F.col("n") > F.col("from"), F.col("n"))), F.min("n"), F.first("from")).alias("next"))


def audit(reviews: DataFrame, key: str) -> DataFrame:
    """(key, audit): one JSON document a copy, its claims in order."""
    fields = [c for c in reviews.columns if c != key]
    claims = F.array_sort(F.collect_list(F.struct("n", *[c for c in fields if c != "n"])))
    return reviews.groupBy(key).agg(F.to_json(F.struct(F.first(key).alias(key), F.count("*").alias("n_claims"), claims.alias("claims"))).alias("audit"))


#: What a reader sees of a status, and its tone.
STATUS = {
    "supported": ("Traced to label", "traced"),
    "needs_qualifier": ("Needs a qualifier", "qualifier"),
    "unsupported": ("Not in the label", "absent"),
    "contradicted": ("Conflicts with label", "conflict"),
    "off_label": ("Off-label", "conflict"),
    "needs_human_review": ("Reviewer decides", "reviewer"),
}
PENDING, OTHER_TONE = ("Checking", "pending"), "reviewer"


def status_shown(status: Column) -> Column:
    """struct(label, tone) of a status; null is pending, an unknown one is shown as it is, for a reviewer."""
    pair = lambda label, tone: F.struct(label.alias("label"), F.lit(tone).alias("tone"))
    out = F.when(status.isNull(), pair(F.lit(PENDING[0]), PENDING[1]))
    for name, (label, tone) in STATUS.items():
        out = out.when(status == name, pair(F.lit(label), tone))
    return out.otherwise(pair(status, OTHER_TONE))


def tidy(text: Column) -> Column:
    """Label text as a reader expects it: no mark before a trademark sign, no blank lines; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\^([®™])", "$1"), r"\n\s*\n", "\n")


def label_name(products: Column, key: Column, drug: Column | None = None) -> Column:
    """The label's drug where it says one, else brands without their presentations (X PEN where X is there), the key's own
    first, joined by "and"; the key in capitals where there are none."""
    if drug is not None:
        return F.coalesce(F.nullif(drug, F.lit("")), label_name(products, key))
    named = F.filter(products, lambda p: p != "")
    names = F.when(F.size(named) > 0, named).otherwise(F.array(F.upper(key)))
    brands = F.filter(names, lambda p: ~F.exists(names, lambda q: (p != q) & F.startswith(p, F.concat(q, F.lit(" ")))))
    own = F.filter(brands, lambda p: F.lower(p) == F.lower(key))
    return F.array_join(F.concat(own, F.filter(brands, lambda p: F.lower(p) != F.lower(key))), " and ")


#: Words that stay small within a title.
SMALL_WORDS = ("and", "or", "of", "in", "with", "for", "the", "to", "a", "an", "on", "at", "by")


def caption(path: Column) -> Column:
    """Short name of a section: the last part of its path, title case if in capitals, at most 64 characters."""
    last = F.trim(F.element_at(F.split(path, " > "), -1))
    upper_first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))
    words = F.transform(F.split(F.lower(last), " "), lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(upper_first(w)))
    cased = F.when((last == F.upper(last)) & last.rlike("[A-Z]"), F.array_join(words, " ")).otherwise(last)
    return F.when(F.length(cased) > 64, F.concat(F.rtrim(F.substring(cased, 1, 63)), F.lit("…"))).otherwise(cased)


def long_date(day: Column) -> Column:
    return F.date_format(F.to_date(day, "yyyyMMdd"), "MMMM d, yyyy")
