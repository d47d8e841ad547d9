import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import lexical as lx
from attestor.operators import search as se
from attestor.operators.store import LabelStore


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    r = random.Random(5)
    words = [f"w{i}" for i in range(25)] + ["7", "14.9", "300"]
    rows = [(i, f"l{i % 3}" if i % 11 else None, f"c{i % 2}", " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for i in range(150)]
    return LabelStore.write(spark.createDataFrame(rows, "chunk_id long, label_key string, top_code string, text string"), str(tmp_path_factory.mktemp("lexical")))


@pytest.mark.parametrize("own", [False, True])
def test_blocks_give_the_best_of_all_sums(spark, store, monkeypatch, own):
    """Small blocks, many ties, filters of four kinds: the lists that are cut in blocks rank as those of all pairs do."""
    monkeypatch.setattr(lx, "BLOCK_IDS", 7)
    monkeypatch.setattr(lx, "CELLS", 40)
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w3 7 {'14.9' if i % 2 else ''}", [None, ["l0"], ["l1", "l2"], []][i % 4], ["c1"] if i % 3 == 0 else None) for i in range(20)], "qid long, text string, label_keys array<string>, top_codes array<string>")
    asked = asked if own else asked.select("qid", "text")
    for depth in (4, 50):
        _, scored, weighed = store.lists(asked, depth=depth, dense=False)
        _, all_scored, all_weighed = store.lists(asked, depth=depth, dense=False, full=True)
        assert scored.count() < all_scored.count() or depth == 50
        tied = lambda df: se.top(df.withColumn("t", F.round(F.col("weight") + 1e-6 * F.col("score"), 9)), "t", depth)
        for a, b in ((se.top(scored, "score", depth), se.top(all_scored, "score", depth)), (tied(weighed), tied(all_weighed))):
            assert sorted(map(tuple, a.select("qid", "id", "rank", "score").collect())) == sorted(map(tuple, b.select("qid", "id", "rank", "score").collect()))


def test_ids_of_several_chunks_are_summed_over_all(spark, tmp_path):
    rows = [(1, "a", "c", "red fox"), (1, "b", "c", "red red"), (2, "a", "c", "fox")]
    store = LabelStore.write(spark.createDataFrame(rows, "chunk_id long, label_key string, top_code string, text string"), str(tmp_path / "s"))
    asked = spark.createDataFrame([(1, "red", ["a", "b"])], "qid long, text string, label_keys array<string>")
    assert store.lists(asked, dense=False)[1].collect() == store.lists(asked, dense=False, full=True)[1].collect()
