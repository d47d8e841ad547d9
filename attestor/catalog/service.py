"""Events, queue, quotas, model answers, decisions and presentation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import percent
from ..operators import service as sv
from ..streaming import admission as ad
from .tables import read, sql_values, values

KINDS = ["queued", "start", "claims", "claim", "document", "done", "error"]


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The event table as job logs: a user is a job, the type stands for the event."""
    e = read(spark, d, "events")
    return sv.event_log(e.select("user_id", "event_id", "ts", F.when(F.col("event_id") % 97 == 0, "done").when(F.col("event_id") % 89 == 0, "error").when(F.col("event_id") % 7 == 0, "start").otherwise("claim").alias("event"), F.col("props").alias("data")), "user_id", ["ts", "event_id"])


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("user_id", "id", "event_id", "event")


def event_log_resume(spark: SparkSession, d: str) -> DataFrame:
    return sv.since(_log(spark, d), F.lit(5)).groupBy("user_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def event_fold(spark: SparkSession, d: str) -> DataFrame:
    return sv.fold(_log(spark, d), "user_id").select("user_id", "state", "last_event", "last_id", "n_claims", "error")


def delivery_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, kept once."""
    e = read(spark, d, "events").select("user_id", "event_id")
    return e.unionByName(e).dropDuplicates(["user_id", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


def queue_position(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs: created at their key, those of even keys done 225 keys later, the others never."""
    o = read(spark, d, "orders").select("o_orderkey")
    jobs = o.select(F.col("o_orderkey").alias("job"), F.col("o_orderkey").alias("created"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 225).alias("finished"))
    return sv.queue_position(jobs, "job", "created", "finished").select("job", "ahead")


def retention(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    jobs = e.select("event_id", "t", F.when(F.col("event_id") % 3 != 0, F.col("t") + 60).alias("fin"))
    now = e.agg(F.max("t")).first()[0]
    return sv.retained(jobs, "t", "fin", F.lit(now), "event_id").select("event_id")


def token_ledger_60s(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    out = sv.trailing(e, ["event_type"], F.unix_seconds(F.col("ts").cast("timestamp")), sv.LEDGER_SECONDS, F.lit(1), closed=False)
    return out.select("event_id", F.col("trailing").cast("long").alias("in_minute"))


def rate_limit_1h(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    out = sv.trailing(e, ["user_id"], F.unix_seconds(F.col("ts").cast("timestamp")), sv.TTL_SECONDS, F.lit(1), closed=True)
    return out.select("event_id", F.col("trailing").cast("long").alias("in_hour"))


def status_tones(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of each document's status."""
    q, t = F.col("quality"), F.col("toxic")
    status = F.when(q.isNull(), None).when(t == 1, "contradicted").when(F.col("doc_id") % 5 == 0, "off_label").when(F.col("doc_id") % 7 == 0, "odd").when(q == 1, "supported").otherwise("unsupported")
    met = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return met.select("doc_id", sv.status_shown(status).alias("s")).select("doc_id", "s.label", "s.tone")


def tidy_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents with blank lines and marked signs between their lines."""
    lines = F.replace("text", F.lit("\n"), F.lit("^®\n \t\n^2^™"))
    return read(spark, d, "documents").select("doc_id", F.md5(sv.tidy(lines)).alias("md5"), F.length(sv.tidy(lines)).cast("long").alias("n"))


def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return ad.day_quota(read(spark, d, "events"), "ts", F.lit(1)).select(F.col("day").cast("string").alias("day"), "used", "over")


def admission(spark: SparkSession, d: str) -> DataFrame:
    return ad.admission_batch(read(spark, d, "events"), "user_id", "event_id", "ts", limit=2)


def token_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("tokens", (F.col("event_id") % 5 * 400 + 200).cast("int"))
    return ad.ledger_batch(e, "event_type", "event_id", "ts", "tokens", 2000)


def judge_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A user's events are the chain: the first purchase-like answer is used."""
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    return sv.first_accepted(e, "user_id", "event_id", "value", F.col("value") > 50).select("user_id", "used", F.round("answer", 6).alias("answer"), "attempts")


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Documents ask, labels are the cache; toxic ones count as damaged entries."""
    asked = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "source")
    cache = read(spark, d, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 0, F.col("quality")).alias("response"))
    return sv.cached(asked, cache).groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark")
    return b.select("item_id", sv.cache_key(F.lit("model"), F.lit("v1"), F.col("item_id").cast("string")).alias("key"))


IPS = [(1, "1.1.1.1, 2.2.2.2", "p"), (2, "3.3.3.3", "p"), (3, None, "p"), (4, "", "p"), (5, "a,  b ", "p")]


def client_ip(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, IPS, "id long, f string, p string").select("id", sv.client_ip(F.col("f"), F.col("p")).alias("ip"))


REQUESTS = [(1, "claim", "short", ["a"]), (2, "claim", "a good claim text", ["a"]), (3, "copy", "x" * 19, ["a"]), (4, "copy", "x" * 4000, ["a", "zz", "b", "yy"]), (5, "copy", "x" * 30, ["a"] * 6), (6, "claim", None, [])]


def request_validation(spark: SparkSession, d: str) -> DataFrame:
    df = values(spark, REQUESTS, "id long, kind string, text string, labels array<string>")
    return df.select("id", sv.request_problem(F.col("kind"), F.col("text"), F.col("labels"), ["a", "b"]).alias("problem"))


SPANS = [("x", 1, 5, 9), ("x", 2, 9, 12), ("x", 3, 20, 30), ("y", 1, 0, 4)]
TEXTS = [("x", 40), ("y", 4), ("z", 7)]


def segments(spark: SparkSession, d: str) -> DataFrame:
    return sv.segments(values(spark, SPANS, "doc string, n long, start long, end long"), values(spark, TEXTS, "doc string, length long"), "doc")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of each source; documents without one are being checked."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    status = F.when(F.col("quality").isNull(), "checking").when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "supported").otherwise("unsupported")
    return docs.join(labels, "doc_id", "left").groupBy("source", status.alias("status")).agg(F.count("*").alias("n"))


def audit_json(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("n"), "role")
    return sv.audit(c, "conv_id")


def decision_log(spark: SparkSession, d: str) -> DataFrame:
    """The last decision of each user and type stays; a null takes it back."""
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 10).alias("choice"))
    return sv.latest(e, ["user_id", "event_type"], "event_id", "choice")


NAMES = [("ozempic", ["OZEMPIC", "OZEMPIC PEN"]), ("kwik", ["HUMALOG KWIKPEN", "HUMALOG", "LYUMJEV"]), ("lantus", ["TOUJEO", "LANTUS", "LANTUS SOLOSTAR"]), ("none", []), ("blank", [""])]


def label_names(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, NAMES, "key string, products array<string>").select("key", sv.label_name(F.col("products"), F.col("key")).alias("name"))


PATHS = [(1, "5 WARNINGS > 5.1 RISK OF TUMORS", "20260618"), (2, "Indications", "20250102"), (3, "A > " + "long words " * 9, "19991231"), (4, "5 WARNINGS > THE RISK OF THE HEART AND KIDNEY", "20200229"), (5, "12 > 12.1", "20200301")]


def captions(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, PATHS, "id long, path string, day string").select("id", sv.caption(F.col("path")).alias("caption"), sv.long_date(F.col("day")).alias("day"))


def next_claim(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("n"), F.col("role").alias("status"))
    asked = c.select("conv_id", F.col("n").alias("from"), F.lit("user").alias("status"))
    return sv.next_with_status(c, asked, "conv_id").select("conv_id", "from", "next")


def percents(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, [(1, 0.5), (2, None), (3, 0.126), (4, 1.0)], "id long, v double").select("id", percent(F.col("v")).alias("p"))


def pick_hit(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand the part whose name begins like it, else any, of the largest size."""
    p = read(spark, d, "part")
    branded = F.startswith(F.lower("p_name"), F.lower(F.substring("p_brand", 1, 1))).cast("int")
    return p.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(branded, "p_size", "p_partkey")).alias("p_partkey"))


def manifest_drift(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as the pinned manifest, customers as what is found: what is new, gone or changed."""
    pinned = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("pinned"))
    found = read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("found"))
    state = F.when(F.col("pinned").isNull(), "new").when(F.col("found").isNull(), "gone").when(F.col("pinned") != F.col("found"), "changed").otherwise("same")
    return pinned.join(found, "key", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def session_activity(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user with at most half an hour between events."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


_LOG = "WITH e AS (SELECT user_id, event_id, ts, props AS data, CASE WHEN event_id % 97 = 0 THEN 'done' WHEN event_id % 89 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'start' ELSE 'claim' END AS event FROM events), c AS (SELECT *, coalesce(count(*) FILTER (event IN ('done', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS id FROM c WHERE ended = 0)"

QUERIES = {
    "event_log": (event_log, f"{_LOG} SELECT user_id, id, event_id, event FROM g"),
    "event_log_resume": (event_log_resume, f"{_LOG} SELECT user_id, count(*) AS n, min(id) AS first_id FROM g WHERE id > 5 GROUP BY user_id"),
    "event_fold": (event_fold, f"{_LOG} SELECT user_id, CASE WHEN count(*) FILTER (event = 'error') > 0 THEN 'error' WHEN count(*) FILTER (event = 'done') > 0 THEN 'done' WHEN count(*) FILTER (event = 'start') > 0 THEN 'running' ELSE 'queued' END AS state, arg_max(event, id) AS last_event, max(id) AS last_id, count(*) FILTER (event = 'claim') AS n_claims, arg_min(data, id) FILTER (event = 'error') AS error FROM g GROUP BY user_id"),
    "delivery_dedupe": (delivery_dedupe, "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY user_id"),
    "queue_position": (queue_position, "WITH j AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 225 END AS fin FROM orders) SELECT a.job, count(b.job) AS ahead FROM j a LEFT JOIN j b ON b.job < a.job AND (b.fin IS NULL OR b.fin > a.job) GROUP BY a.job"),
    "retention": (retention, "WITH e AS (SELECT event_id, epoch(ts)::BIGINT AS t FROM events), j AS (SELECT event_id, t, CASE WHEN event_id % 3 <> 0 THEN t + 60 END AS fin FROM e) SELECT event_id FROM j WHERE fin IS NULL OR (SELECT max(t) FROM e) - t <= 3600 ORDER BY t DESC, event_id DESC LIMIT 200"),
    "token_ledger_60s": (token_ledger_60s, "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS in_minute FROM events"),
    "rate_limit_1h": (rate_limit_1h, "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM events"),
    "status_tones": (
        status_tones,
        "WITH s AS (SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'contradicted' WHEN doc_id % 5 = 0 THEN 'off_label' WHEN doc_id % 7 = 0 THEN 'odd' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS s FROM documents LEFT JOIN labels USING (doc_id)) "
        "SELECT doc_id, CASE s WHEN 'contradicted' THEN 'Conflicts with label' WHEN 'off_label' THEN 'Off-label' WHEN 'supported' THEN 'Traced to label' WHEN 'unsupported' THEN 'Not in the label' ELSE coalesce(s, 'Checking') END AS label, "
        "CASE s WHEN 'contradicted' THEN 'conflict' WHEN 'off_label' THEN 'conflict' WHEN 'supported' THEN 'traced' WHEN 'unsupported' THEN 'absent' ELSE CASE WHEN s IS NULL THEN 'pending' ELSE 'reviewer' END END AS tone FROM s",
    ),
    "tidy_text": (
        tidy_text,
        "WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), '^®' || chr(10) || ' ' || chr(9) || chr(10) || '^2^™'), '\\^([®™])', '\\1', 'g'), '\\n\\s*\\n', chr(10), 'g') AS x FROM documents) SELECT doc_id, md5(x) AS md5, length(x) AS n FROM t",
    ),
    "daily_quota": (daily_quota, "SELECT ts::DATE::VARCHAR AS day, count(*) AS used, count(*) > 300 AS over FROM events GROUP BY 1"),
    "admission": (admission, None),
    "token_ledger": (token_ledger, None),
    "judge_fallback": (judge_fallback, "WITH b AS (SELECT user_id, min(event_id) FILTER (value > 50) AS used, arg_min(value, event_id) FILTER (value > 50) AS answer FROM events GROUP BY user_id) SELECT user_id, used, round(answer, 6) AS answer, count(*) AS attempts FROM events JOIN b USING (user_id) WHERE used IS NULL OR event_id <= used GROUP BY ALL"),
    "cache_lookup": (cache_lookup, "SELECT source, count(l.doc_id) AS hits, count(*) - count(l.doc_id) AS misses FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0 AND quality IS NOT NULL) l USING (doc_id) GROUP BY source"),
    "cache_keys": (cache_keys, "SELECT item_id, sha256('[\"model\",\"v1\",\"' || item_id || '\"]') AS key FROM benchmark"),
    "client_ip": (client_ip, f"SELECT id, coalesce(nullif(trim(string_split(f, ',')[-1]), ''), p) AS ip FROM {sql_values(IPS, 'id, f, p')}"),
    "request_validation": (request_validation, f"SELECT id, CASE WHEN length(coalesce(text, '')) NOT BETWEEN CASE kind WHEN 'claim' THEN 8 ELSE 20 END AND CASE kind WHEN 'claim' THEN 600 ELSE 4000 END THEN 'length ' || length(coalesce(text, '')) WHEN len(labels) > 5 THEN 'too many labels' WHEN len(list_filter(labels, lambda x: x NOT IN ('a', 'b'))) > 0 THEN 'unknown labels: ' || array_to_string(list_sort(list_filter(labels, lambda x: x NOT IN ('a', 'b'))), ', ') END AS problem FROM {sql_values(REQUESTS, 'id, kind, text, labels')}"),
    "segments": (segments, f"WITH s AS (SELECT * FROM {sql_values(SPANS, 'doc, n, s, e')}), t AS (SELECT * FROM {sql_values(TEXTS, 'doc, length')}), g AS (SELECT doc, coalesce(lag(e) OVER (PARTITION BY doc ORDER BY s), 0) AS a, s AS b FROM s), z AS (SELECT t.doc, coalesce(max(e), 0) AS a, any_value(length) AS b FROM t LEFT JOIN s USING (doc) GROUP BY t.doc) SELECT doc, s AS start, e AS \"end\", n FROM s UNION ALL SELECT doc, a, b, NULL FROM g WHERE b > a UNION ALL SELECT doc, a, b, NULL FROM z WHERE b > a"),
    "status_counts": (status_counts, "SELECT source, CASE WHEN quality IS NULL THEN 'checking' WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"),
    "audit_json": (audit_json, None),
    "decision_log": (decision_log, "WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 4 <> 0 THEN event_id % 10 END AS choice FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) SELECT user_id, event_type, choice FROM e WHERE choice IS NOT NULL"),
    "label_names": (label_names, "SELECT * FROM (VALUES ('ozempic', 'OZEMPIC'), ('kwik', 'HUMALOG and LYUMJEV'), ('lantus', 'LANTUS and TOUJEO'), ('none', 'NONE'), ('blank', 'BLANK')) AS t(key, name)"),
    "captions": (captions, f"SELECT id, CASE WHEN length(c) > 64 THEN rtrim(substring(c, 1, 63)) || '…' ELSE c END AS caption, strftime(strptime(day, '%Y%m%d'), '%B %-d, %Y') AS day FROM (SELECT id, day, CASE id WHEN 1 THEN '5.1 Risk of Tumors' WHEN 4 THEN 'The Risk of the Heart and Kidney' ELSE trim(string_split(path, ' > ')[-1]) END AS c FROM {sql_values(PATHS, 'id, path, day')})"),
    "next_claim": (next_claim, "SELECT a.conv_id, a.turn AS \"from\", coalesce(min(b.turn) FILTER (b.turn > a.turn), min(b.turn), a.turn) AS next FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'user' GROUP BY a.conv_id, a.turn"),
    "percents": (percents, "SELECT * FROM (VALUES (1, '50%'), (2, 'n/a'), (3, '13%'), (4, '100%')) AS t(id, p)"),
    "pick_hit": (pick_hit, "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY starts_with(lower(p_name), lower(p_brand[1])) DESC, p_size DESC, p_partkey DESC) = 1"),
    "manifest_drift": (manifest_drift, "SELECT CASE WHEN s_suppkey IS NULL THEN 'new' WHEN c_custkey IS NULL THEN 'gone' WHEN s_nationkey <> c_nationkey THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON s_suppkey = c_custkey GROUP BY 1"),
    "session_activity": (session_activity, "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS new FROM events), s AS (SELECT user_id, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id"),
}
