import random

import pytest

import corpus_pipeline as cp


def text(r, n, lines=3):
    words = [f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randrange(40)}" for _ in range(n)]
    step = n // lines
    return "\n".join(" ".join(words[i : i + step]) for i in range(0, n, step))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    path = str(tmp_path_factory.mktemp("sf"))
    clean = [text(r, 120) for _ in range(12)]
    item = " ".join(text(r, 24, 1).split())
    near = clean[0].split(" ")
    near[5] = "changed"
    shared = text(r, 30, 1)
    rows = list(enumerate(clean)) + [
        (100, clean[1]),
        (101, "too short"),
        (102, "*** ### " * 80),
        (103, " ".join(near)),
        (104, clean[2] + " " + item + " " + text(r, 40, 1)),
        (105, text(r, 90) + "\n" + shared),
        (106, text(r, 90) + "\n" + shared.upper()),
        (107, None),
    ]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = cp.staged(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        ids.append({x.doc_id for x in docs.select("doc_id").collect()})
    clean = set(range(12))
    assert clean | {100, 103, 104, 105, 106} == ids[0]
    assert 100 not in ids[1] and clean | {104, 105, 106} <= ids[1]
    assert clean | {104, 105, 106} <= ids[2]
    assert ids[3] == ids[2] - {104} and clean <= ids[3]


def test_run_equals_the_stages_one_by_one(spark, folder):
    rows = cp.run(spark, folder).collect()
    assert {x.doc_id for x in rows} >= set(range(12)) and all(x.round_trip and len(x.ids) == x.n_pieces for x in rows)
    again = {x.doc_id: x.ids_crc32 for x in cp.run(spark, folder).collect()}
    assert again == {x.doc_id: x.ids_crc32 for x in rows}
