from pyspark.sql import functions as F

from attestor.catalog import text as texts
from attestor.functions.text import figures, numbers, plain, query_terms, tokenize
from attestor.operators import chunks as ch
from attestor.operators import claims as cl
from attestor.operators import evaluation as ev
from attestor.operators import ground as gr
from attestor.operators import guards as gu
from attestor.operators import injection as inj
from attestor.operators import present as pr
from attestor.operators import search as se
from attestor.operators import service as sv


def one(spark, column, *values, schema="x string"):
    return spark.createDataFrame([values], schema).select(column).first()[0]


def test_tokens_and_query_terms(spark):
    assert one(spark, tokenize(F.col("x")), "Lost 14.9% vs. the 2.4 – in 68 weeks") == ["lost", "14.9", "vs", "2.4", "68", "weeks"]
    assert one(spark, query_terms(F.col("x")), "It lowers A1C and A1C") == ["lowers", "a1c", "hba1c"]
    assert one(spark, tokenize(F.col("x")), None) == []


def test_figures_and_numbers(spark):
    for text, found in (
        ("lost 14.90% (1,306 patients) over 68 weeks in type 2 diabetes", {"14.9", "1306", "68"}),
        ("children as young as 8, aged 6, for 4 weeks, 2 mg, 10%", {"8", "6", "4", "2", "10"}),
        ("type 2 diabetes, MEN 2, phase 3, 2 doses", set()),
    ):
        assert set(one(spark, figures(F.col("x")), text)) == found
    assert one(spark, numbers(F.col("x")), "15.0 and 007, 1,000") == ["1000", "15", "7"]
    assert one(spark, plain(F.col("x")), " type  2 – x ") == "type 2 - x"


LADDER = [
    ("exact", "The dose is 2 mg once a week for adults", "2 mg once a week"),
    ("normalized", "Reduces the\n  risk of  “MACE” in adults", 'risk of "mace" in adults'),
    ("elided", "Patients lost weight over a period of 68 weeks in the trial", "Patients lost weight ... 68 weeks"),
    ("stitched", "DRUG is indicated:\n- to reduce the risk of events\n- to reduce excess weight", "DRUG is indicated: to reduce excess weight"),
    ("fuzzy", "store the medicine in a cold dry place away from light", "store the medicine in a cool dry place away from light"),
    ("failed", "a trial of 25 patients with some events in it", "a trial of 26 patients with some events in it"),
    ("failed", "short", "short"),
    ("failed", None, "there is no text at all"),
]


def test_ladder(spark):
    df = spark.createDataFrame([(i, t, q) for i, (_, t, q) in enumerate(LADDER)], "id int, text string, quote string")
    for r in gr.ground(df).collect():
        kind, text, quote = LADDER[r.id]
        assert r.match == kind, (r.id, r.match)
        if kind != "failed":
            assert text[r.start : r.end] == r.located and r.parts
    native = {r.id: r.match for r in gr.contains(df).collect()}
    assert native[0] == "exact" and native[1] == "normalized" and native[6] == "none"


def test_elided_and_stitched_limits():
    text = "alpha beta gamma " + "x" * 900 + " delta epsilon"
    assert gr.locate(text, "alpha beta ... delta epsilon")[0] == "failed"
    assert gr.locate("one two three four five", "one two ... zz five six")[0] == "failed"
    assert gr.locate("first line of words and more\nsecond line of words", "first line of words second line of words")[0] == "failed"


def test_guards(spark):
    got = {r.claim_id: (r.status, r.flags) for r in texts.guard_decision(spark, "").collect()}
    assert got["a1"] == ("supported", "")
    assert got["a2"] == ("needs_human_review", "claim_figures_not_in_quotes:15")
    assert got["a3"] == ("needs_human_review", "conditions_not_in_claim:diet and exercise")
    assert got["a4"] == ("needs_human_review", "supported_but_lists_violations")
    assert got["a5"] == ("needs_human_review", "cited_unknown_excerpt violation_without_grounded_quote")
    assert got["a6"] == ("supported", "quote_reattributed")
    assert got["a7"] == ("unsupported", "")
    assert got["a8"] == ("needs_human_review", "supported_without_grounded_quote")


def test_a_listed_violation_never_passes(spark):
    judged, shown = texts.guard_tables(spark)
    judged = judged.withColumn("violations", F.array(F.lit("any")))
    assert gu.guard(judged, shown).where("status = 'supported'").count() == 0


def test_checks_are_sentences(spark):
    rows = [r.text for r in texts.guard_checks(spark, "").where("claim_id = 'a2'").collect()]
    assert "1 of 1 quotes found word for word in the label." in rows
    assert any(x.startswith("Figures in the claim missing from every quote: 15") for x in rows)


def test_injection(spark):
    got = {r.id: r for r in inj.scan(texts._markup(spark), "id").collect()}
    assert {i for i, r in got.items() if r.flagged} == {1, 3, 5, 6}
    assert "base64-encoded text" in got[3].reasons and "text styled to be invisible" in got[1].reasons
    assert len(got[2].findings) == 1 and not got[2].findings[0].flags
    scored = inj.scan(texts._markup(spark), "id", scorer=lambda w: F.when(F.contains(w, F.lit("weight")), 0.9))
    assert {r.id: r.score for r in scored.where("score is not null").collect()} == {4: 0.9}


def test_sentences_keep_their_places(spark):
    text = "Drug lost 14.9% of weight. Ask your doctor about it now.\n\n  It “works” well for adults! Too short."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    rows = cl.sentences(df, "id").orderBy("n").collect()
    assert [r.claim for r in rows] == ["Drug lost 14.9% of weight.", "It “works” well for adults!"]
    assert all(text[r.start : r.end] == r.claim for r in rows)


def test_denials_and_risk(spark):
    rows = {r.id: (r.state, r.n_denied) for r in texts.risk_check(spark, "").collect()}
    assert rows[1] == ("denied", 1) and rows[2] == ("mentioned", 0) and rows[3] == ("missing", 0) and rows[4][0] == "denied"


def test_first_wins(spark):
    df = spark.sql("SELECT array(named_struct('start', 0, 'end', 5), named_struct('start', 4, 'end', 9), named_struct('start', 5, 'end', 7)) AS s")
    assert [tuple(x) for x in df.select(cl.first_wins(F.col("s"))).first()[0]] == [(0, 5), (5, 7)]


TABLE = "Intro text here\n\nTable 1. Weight\n\nname | Week 68\nunit | kg\nA | 1\nB | 2\nC | 3\n\nEnd of it."


def test_chunks_keep_their_places_and_contexts(spark):
    sections = spark.createDataFrame([("k", 1, 0, "first section"), ("k", 1, 1, TABLE), ("k", 1, 2, "")], "label_key string, version int, section_index int, text string")
    placed = ch.section_offsets(sections)
    doc = ch.label_document(sections).first().doc
    rows = ch.section_chunks(placed, 6).collect()
    for r in rows:
        text = {0: "first section", 1: TABLE}[r.section_index]
        assert text[r.start : r.end] == r.text == doc[r.doc_start : r.doc_end]
    rows = [r for r in rows if r.text.startswith(("B |", "C |"))]
    assert rows and all(r.context == "Table 1. Weight\nname | Week 68\nunit | kg" for r in rows)


def test_packs(spark):
    df = spark.sql("SELECT array(100, 90, 90, 200, 1) AS w")
    assert df.select(ch.pack_sizes(F.col("w"), 180)).first()[0] == [0, 1, 1, 2, 3]


def test_fusion_pins_and_scores(spark):
    dense = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8)], "qid int, id string, score double")
    bm25 = spark.createDataFrame([(1, "b", 3.0), (1, "z", 0.0)], "qid int, id string, score double")
    figs = spark.createDataFrame([(1, "c", 1.0, True)], "qid int, id string, weight double, rare boolean")
    rows = {r.id: r for r in se.fuse(dense, bm25, figs, 5).collect()}
    assert rows["c"].rank == 1 and rows["c"].pinned and "z" not in rows
    assert abs(rows["b"].score - (1 / 62 + 1 / 61)) < 1e-8


def test_bootstrap_and_medians(spark):
    low, high = ev.bootstrap_bounds([(1.0, 1.0), (0.0, 1.0), (1.0, 1.0)] * 5)
    assert 0.3 < low < 2 / 3 < high < 1
    rows = spark.createDataFrame([("x", v) for v in (4, 1, 3, 2)], "g string, v int")
    assert ev.upper_median(rows, ["g"], "v").first().median == 3


def test_evidence_tables_and_clips(spark):
    df = spark.createDataFrame([("A | 1\nB | 2", "Table 1\nname | n", 10, [(16, 18)])], "t string, c string, at int, parts array<struct<s:int,e:int>>")
    t = df.select(pr.table_of(F.col("t"), F.col("c"), F.col("at"), F.col("parts")).alias("t")).first().t
    assert (t.caption, t.header, t.rows, t.highlight) == ("Table 1", [["name", "n"]], [["A", "1"], ["B", "2"]], [1])
    clip = one(spark, pr.clip_before(F.col("x")), "word " * 100)
    assert clip.startswith("…word") and len(clip) <= 242
    assert pr.word_changes("a b c", "a c d") == [{"kind": "same", "text": "a"}, {"kind": "removed", "text": "b"}, {"kind": "same", "text": "c"}, {"kind": "added", "text": "d"}]


def test_names_and_keys(spark):
    names = {r.key: r.name for r in texts_service(spark)}
    assert names["lantus"] == "LANTUS and TOUJEO"
    assert len(one(spark, sv.cache_key(F.lit("m"), F.col("x")), "p")) == 64


def texts_service(spark):
    from attestor.catalog import service

    return service.label_names(spark, "").collect()
