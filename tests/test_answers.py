from pyspark.sql import functions as F

from attestor.operators import answers as an

GOOD = '{"evidence":[],"reasoning":"r","verdict":"supported","violations":[]}'
CASES = [
    (GOOD, ""),
    (None, "not JSON"),
    ("", "not JSON"),
    ("{", "not JSON"),
    ("3", "not an object"),
    ("[]", "not an object"),
    ("{}", "reasoning: missing; verdict: missing; violations: missing; evidence: missing"),
    (GOOD.replace('"r"', "null"), "reasoning: not a string"),
    (GOOD.replace('"supported"', '"Supported"'), "verdict: not a known word"),
    (GOOD.replace('"supported"', "[]"), "verdict: not a string"),
    (GOOD.replace('"violations":[]', '"violations":{}'), "violations: not an array"),
    (GOOD.replace('"violations":[]', '"violations":["minimized_risk",1]'), "violations: a wrong item"),
    (GOOD.replace('"violations":[]', '"violations":["minimized_risk","x"]'), "violations: not a known word"),
    (GOOD.replace('"evidence":[]', '"evidence":[{"chunk_id":"a","quote":"b"},{"quote":"b","chunk_id":"a"}]'), ""),
    (GOOD.replace('"evidence":[]', '"evidence":[{"chunk_id":"a","quote":"b","more":1}]'), "evidence: a wrong item"),
    (GOOD.replace('"evidence":[]', '"evidence":[null]'), "evidence: a wrong item"),
    (GOOD[:-1] + ',"b":1,"a":2}', "a: unknown; b: unknown"),
]


def test_problems_of_answers(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "id int, answer string")
    got = {r.id: r.p for r in df.select("id", F.array_join(an.problems(F.col("answer")), "; ").alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(CASES)}


def test_first_valid_answer_settles(spark):
    bad, useless = "{", GOOD.replace('"r"', '""')
    rows = [
        ("first", "a", 1, GOOD), ("first", "a", 2, bad),
        ("repaired", "a", 1, bad), ("repaired", "a", 2, GOOD), ("repaired", "b", 3, GOOD),
        ("one repair", "a", 1, bad), ("one repair", "a", 2, bad), ("one repair", "a", 3, GOOD), ("one repair", "b", 4, GOOD),
        ("rejected", "a", 1, useless), ("rejected", "a", 2, GOOD), ("rejected", "b", 3, GOOD),
        ("none", "a", 1, bad), ("none", "b", 2, None),
    ]
    df = spark.createDataFrame(rows, "k string, m string, o int, answer string")
    rejected = F.when(an.parsed(F.col("answer"))["reasoning"] == "", "no reasoning")
    got = {r.key: tuple(r)[1:] for r in an.settled(df.withColumnRenamed("k", "key"), "key", "m", "o", "answer", rejected=rejected).withColumnRenamed("m", "model").collect()}
    assert got == {
        "first": ("a", False, 1, [], GOOD),
        "repaired": ("a", True, 2, ["not JSON"], GOOD),
        "one repair": ("b", False, 3, ["not JSON", "not JSON"], GOOD),
        "rejected": ("b", False, 2, ["no reasoning"], GOOD),
        "none": (None, None, 2, ["not JSON", "not JSON"], None),
    }
