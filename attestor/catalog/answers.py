"""Recorded answers: each turn of a conversation is an attempt, two a model, some of them damaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as an
from .tables import quote, read

#: Kinds of answers, by a turn's number; the first is valid, and its length of reasoning is the turn's own.
KINDS = (
    '{"reasoning":"@","verdict":"supported","violations":[],"evidence":[{"chunk_id":"c","quote":"q"}]}',
    '{"reasoning":"@","verdict":"supported"',
    '{"reasoning":"@","verdict":"fine","violations":["omitted_qualifier"],"evidence":[]}',
    '{"reasoning":5,"verdict":"off_label","violations":"none","evidence":[],"note":1}',
    '{"verdict":"unsupported","violations":["odd"],"evidence":[{"chunk_id":"c"}]}',
    '["@"]',
    '{"reasoning":"@","verdict":"contradicted","violations":["minimized_risk"],"evidence":[]}',
)


def attempts_of(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    turns = read(spark, d, "conversations")
    kind = F.element_at(kinds, (F.pmod(F.col("conv_id") * 3 + F.col("turn") * 5 + F.length("text"), F.lit(len(KINDS))) + 1).cast("int"))
    answer = F.when(F.col("role") == "system", F.lit(None)).otherwise(F.replace(kind, F.lit("@"), F.length("text").cast("string")))
    return turns.select("conv_id", "turn", F.concat(F.lit("m"), F.floor(F.col("turn") / 2).cast("string")).alias("model"), answer.alias("answer"))


def answer_problems(spark: SparkSession, d: str) -> DataFrame:
    return attempts_of(spark, d).select("conv_id", "turn", F.array_join(an.problems(F.col("answer")), "; ").alias("problems"))


def answers_settled(spark: SparkSession, d: str) -> DataFrame:
    out = an.settled(attempts_of(spark, d), "conv_id", "model", "turn", "answer")
    return out.select("conv_id", F.col("model").alias("used"), "repaired", "asked", F.array_join("reasons", " | ").alias("reasons"), an.parsed(F.col("answer"))["verdict"].alias("verdict"))


def _field(name: str, array: bool, check: str) -> str:
    kind, said = ("ARRAY", "an array") if array else ("VARCHAR", "a string")
    return f"CASE WHEN NOT list_contains(json_keys(answer), '{name}') THEN '{name}: missing' WHEN json_type(answer, '$.{name}') <> '{kind}' THEN '{name}: not {said}' {check} END"


_WORD = "json_extract_string(answer, '$.verdict') NOT IN " + str(an.VERDICTS)
_LIST = "len(list_filter(CAST(json_extract(answer, '$.violations') AS JSON[]), lambda x: json_type(x) {0})) > 0"
_ODD = f"len(list_filter(CAST(json_extract_string(answer, '$.violations') AS VARCHAR[]), lambda x: NOT list_contains({quote(an.VIOLATIONS)}, x))) > 0"
_ITEM = "len(list_filter(CAST(json_extract(answer, '$.evidence') AS JSON[]), lambda x: json_type(x) <> 'OBJECT' OR list_sort(json_keys(x)) <> ['chunk_id', 'quote'] OR json_type(x, '$.chunk_id') <> 'VARCHAR' OR json_type(x, '$.quote') <> 'VARCHAR')) > 0"
_PARTS = ", ".join([
    _field("reasoning", False, ""), _field("verdict", False, f"WHEN {_WORD} THEN 'verdict: not a known word'"),
    _field("violations", True, f"WHEN {_LIST.format(chr(60) + chr(62) + ' ' + quote('VARCHAR'))} THEN 'violations: a wrong item' WHEN {_ODD} THEN 'violations: not a known word'"),
    _field("evidence", True, f"WHEN {_ITEM} THEN 'evidence: a wrong item'"),
])
_MORE = "list_transform(list_sort(list_filter(json_keys(answer), lambda k: NOT list_contains(['reasoning', 'verdict', 'violations', 'evidence'], k))), lambda k: k || ': unknown')"
_SQL = f"""
WITH a AS (SELECT conv_id, turn, 'm' || (turn // 2) AS model, CASE WHEN role <> 'system' THEN replace({quote(KINDS)}[(conv_id * 3 + turn * 5 + length(text)) % {len(KINDS)} + 1], '@', length(text)::VARCHAR) END AS answer FROM conversations),
v AS (SELECT * FROM a WHERE answer IS NOT NULL AND json_valid(answer)),
o AS (SELECT conv_id, turn, list_concat(list_filter([{_PARTS}], lambda x: x IS NOT NULL), {_MORE}) AS p FROM v WHERE json_type(answer) = 'OBJECT'),
q AS (SELECT a.*, CASE WHEN answer IS NULL OR NOT json_valid(answer) THEN ['not JSON'] WHEN json_type(answer) <> 'OBJECT' THEN ['not an object'] ELSE o.p END AS p
      FROM a LEFT JOIN o ON a.conv_id = o.conv_id AND a.turn = o.turn)"""

QUERIES = {
    "answer_problems": (answer_problems, _SQL + " SELECT conv_id, turn, array_to_string(p, '; ') AS problems FROM q"),
    "answers_settled": (
        answers_settled,
        _SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, model ORDER BY turn) AS nth, lag(len(p)) OVER (PARTITION BY conv_id, model ORDER BY turn) AS b FROM q),
s AS (SELECT *, min(CASE WHEN len(p) = 0 THEN turn END) OVER (PARTITION BY conv_id) AS used FROM r WHERE nth = 1 OR (nth = 2 AND b > 0)),
t AS (SELECT * FROM s WHERE used IS NULL OR turn <= used)
SELECT conv_id, max(CASE WHEN turn = used THEN model END) AS used, max(CASE WHEN turn = used THEN nth = 2 END) AS repaired, count(*) AS asked,
       coalesce(string_agg(CASE WHEN len(p) > 0 THEN array_to_string(p, '; ') END, ' | ' ORDER BY turn), '') AS reasons,
       max(CASE WHEN turn = used THEN json_extract_string(answer, '$.verdict') END) AS verdict
FROM t GROUP BY conv_id""",
    ),
}
