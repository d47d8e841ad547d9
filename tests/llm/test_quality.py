import re

import duckdb
import pytest

from attestor.llm.quality import RULES, SQL, View, cascade, estimate, figures, judged, ordered

ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\n"),
    (4, "one two three one two three four"),
    (5, "a\nb\na\n\n \na\nb "),
    (6, "é# *x $ü |<>&%"),
    (7, "word " * 30000),
    (8, " ".join(f"w{i}" for i in range(60))),
    (9, " ".join(f"W{i}".upper() + "AB" for i in range(60))),
    (10, "\n".join(f"word{i} is here and there on line {i}" for i in range(20))),
    (11, "\n".join(["this line is the same as all the others"] * 9 + [" ".join(f"x{i} yy" for i in range(80))])),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else set(range(len(words)))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_figures_equal_plain_python_and_sql(spark):
    df = spark.createDataFrame([(*r, True) for r in ROWS], "doc_id long, text string, kept boolean")
    got = {r[0]: tuple(r)[1:] for r in figures(df).collect()}
    assert {i: x[:5] for i, x in got.items()} == {i: plain(t) for i, t in ROWS}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    assert got == {r[0]: r[1:] for r in con.execute(SQL).fetchall()}


def test_order_does_not_change_the_verdict(spark):
    texts = [(t or "").encode() for _, t in ROWS]
    one, other = cascade(texts, RULES), cascade(texts, RULES[::-1])
    assert [x is None for x in one] == [x is None for x in other]


def test_estimate_orders_by_rejections_per_cost(spark):
    df = spark.createDataFrame([(i, "ABC DEF " * 40) for i in range(200)], "doc_id long, text string")
    seen = estimate(df, RULES, share=1.0)
    assert {x["rule"]: x["rejects"] for x in seen}["capitals"] == 1.0
    assert ordered(df, share=1.0)[0].name == "capitals"


def test_judged_keeps_columns_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'s' AS source")
    out = judged(df)
    assert out.columns == ["doc_id", "text", "source", "kept_by_rules"] and out.count() == len(ROWS)
    assert figures(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3])
def test_view_of_empty_texts(size):
    assert View([b""] * size).n_repeat_words.tolist() == [0] * size
