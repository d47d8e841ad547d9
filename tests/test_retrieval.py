import pytest

from attestor.catalog import retrieval as rt

DOCS = [
    (1, "One 5mg dose [see Warnings] of insulin\na day, no more."), (2, "X5mg dose of INSULIN a daylight"), (3, "5mg dose of insulin  a\tday"), (4, "a 5mg dose of insulin and a day"),
    (5, None), (6, ""), (7, "the end"), (8, "- all ends well"),
]
ITEMS = [(1, "5mg dose of insulin a day"), (2, "End"), (3, "all  ends"), (4, ""), (5, None), (6, "nowhere to be found at all")]
PAIRS = [(1, 1), (1, 2), (1, 3), (2, 7), (2, 8), (3, 8)]


@pytest.mark.parametrize("few", [20_000, 0])
def test_relevant_pairs_are_all_documents_with_the_folded_item(spark, monkeypatch, few):
    """Broadcast or shuffled; a reference inside the quoted stretch and a word that goes on at its ends do not hide it."""
    monkeypatch.setattr(rt, "BROADCAST_ITEMS", few, raising=False)
    found = rt.relevant_pairs(spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "qid long, text string"))
    assert sorted(map(tuple, found.collect())) == PAIRS
