from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import search as se
from attestor.operators.dense import BLOCK_ROWS, dense_top
from attestor.operators.encode import HashModel, OnnxModel, encoded
from attestor.operators.index import LexicalIndex, embed
from attestor.operators.store import LabelStore
from attestor.sources.shared import fingerprint, made_once

CHUNKS = [
    ("a1", "007", "34066-1", "WARNING: RISK OF TUMORS", "tumors were seen in 14.9 percent of rats"),
    ("a2", "007", "34067-9", "1 INDICATIONS", "lowers blood sugar in adults with diabetes"),
    ("b1", "x/y z", "34067-9", "1 INDICATIONS", "reduces weight in adults, 14.9 percent over 68 weeks"),
    ("b2", "x/y z", "34092-7", "14 STUDIES", ""),
    ("c1", None, None, "none", None),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, label_key string, top_code string, section_path string, text string")
    return LabelStore.write(chunks, str(tmp_path_factory.mktemp("store")), built="now")


def test_reads_back_what_was_written(spark, store):
    again = LabelStore(spark, store.path)
    assert again.meta["n_docs"] == 5 and again.meta["extra"] == {"built": "now"}
    rows = {r.chunk_id: r for r in again.chunks().collect()}
    assert [(r.chunk_id, r.label_key, r.top_code, r.section_path, r.text) for r in sorted(rows.values())] == CHUNKS
    assert rows["c1"].embedding == [0.0] * 64 and abs(sum(x * x for x in rows["a1"].embedding) - 1) < 1e-12
    assert {r.chunk_id for r in again.get(["a2", "b2", "zz"]).collect()} == {"a2", "b2"}
    assert [r.chunk_id for r in again.boxed_warning(["007"]).collect()] == ["a1"] and again.boxed_warning(["x/y z"]).count() == 0


def test_lexical_index_of_the_store_equals_one_built_in_memory(spark, store):
    chunks = spark.createDataFrame([(c[0], c[4]) for c in CHUNKS], "id string, text string")
    own = LexicalIndex.build(chunks, "id")
    terms = spark.createDataFrame([("q", t) for t in ("adults", "14.9", "percent", "tumors")], "qid string, term string")
    assert sorted(own.scores(terms).collect()) == sorted(store.lexical().scores(terms).collect())


def test_filters_prune_folders_and_reach_the_files(store):
    plan = store.chunks(["007"], ["34066-1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label_key" in plan and "(label_key" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(top_code,34066-1)" in plan.split("PushedFilters:")[1]
    read = store.lexical(["007"]).postings
    assert {p.split("label_key=")[1].split("/")[0] for p in read.where("label_key = '007'").inputFiles()} >= {"007"}
    assert "PartitionFilters: [isnotnull(label_key" in read._jdf.queryExecution().executedPlan().toString()


def test_search_under_filters_keeps_statistics_of_all(spark, store):
    asked = spark.createDataFrame([("q", "14.9 percent in adults")], "qid string, text string")
    every = {r.id: r for r in store.search(asked).collect()}
    assert every["b1"].pinned and every["a1"].pinned and set(every) >= {"a1", "a2", "b1"}
    one = {r.id: r for r in store.search(asked, labels=["x/y z"]).collect()}
    assert set(one) == {"b1", "b2"} and one["b1"].pinned
    scores = {r.id: r.score for r in store.lists(asked, dense=False)[1].collect()}
    under = {r.id: r.score for r in store.lists(asked, labels=["007"], dense=False)[1].collect()}
    assert under == {i: scores[i] for i in ("a1", "a2")}
    assert store.search(asked, labels=["nowhere"]).count() == 0
    own = spark.createDataFrame([("p", "14.9 percent", ["007"], None), ("q", "14.9 percent", None, ["34067-9"]), ("r", "adults", [], []), ("s", "adults", ["x/y z"], ["34092-7"])], "qid string, text string, label_keys array<string>, top_codes array<string>")
    found = {}
    for r in store.search(own).collect():
        found.setdefault(r.qid, set()).add(r.id)
    assert found["p"] == {"a1", "a2"} and found["q"] == {"a2", "b1"} and found["r"] >= {"a2", "b1", "c1"} and found["s"] == {"b2"}


def test_own_columns_and_incomplete_stores_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        LabelStore.write(spark.createDataFrame([("a", "l", "c", "t", 1)], "chunk_id string, label_key string, top_code string, text string, tf int"), str(tmp_path / "x"))
    with pytest.raises(Exception):
        LabelStore(spark, str(tmp_path / "nothing")).meta


@pytest.mark.parametrize("n", [3, BLOCK_ROWS + 7])
def test_dense_top_equals_all_products(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, r.normal(size=4).tolist(), int(i % 3)) for i in range(n)] + [(n, None, 0), (n + 1, [1.0, None, 0.0, 0.0], 1), (n + 2, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(3)
    asked = [(i, r.normal(size=4).tolist(), int(i % 3)) for i in range(5)]
    queries = spark.createDataFrame(asked, "qid long, embedding array<double>, label int")
    for on in ((), ("label",)):
        got = se.top(dense_top(table, queries, 3, on), "score", 3).collect()
        want = set()
        for q, v, label in asked:
            scored = sorted((-round(float(np.dot(v, w)), 6), i) for i, w, other in rows if w and len(w) == 4 and None not in w and (not on or other == label))
            want |= {(q, i, -s) for s, i in scored[:3]}
        assert {(x.qid, x.id, x.score) for x in got} == {(q, i, s + 0.0) for q, i, s in want}


def test_hash_model_equals_the_columns_and_no_batch_matters(spark):
    texts = ["one two two", "", None, "Ünï CODE words", " spaced\tout\nwords "] * 3
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.id: r.embedding for r in embed(table).collect()}
    for batch, at_once, parts in ((1, 1024, 1), (4, 2, 3)):
        got = {r.doc_id: r.embedding for r in encoded(table.repartition(parts), HashModel(), batch=batch, at_once=at_once).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in got)


def field(number, value):
    """One field of a protocol buffer: bytes and strings by length, integers as varints."""
    if isinstance(value, int):
        out = b""
        while True:
            out += bytes([value & 127 | (128 if value > 127 else 0)])
            value >>= 7
            if not value:
                return bytes([number << 3]) + out
    value = value.encode() if isinstance(value, str) else value
    return bytes([number << 3 | 2]) + field(0, len(value))[1:] + value


def tiny_model(weights):
    """An ONNX graph that looks up a row of weights for each id."""
    tensor = b"".join(field(1, n) for n in weights.shape) + field(2, 1) + field(8, "w") + field(9, weights.astype("<f4").tobytes())
    shape = lambda *dims: b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    value = lambda name, kind, *dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, shape(*dims))))
    node = field(1, "w") + field(1, "input_ids") + field(2, "states") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, tensor) + field(11, value("input_ids", 7, "b", "s")) + field(12, value("states", 1, "b", "s", weights.shape[1]))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_onnx_model_with_a_prefix(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {"[PAD]": 0, "[UNK]": 1, "low": 2, "high": 3, "ask": 4}
    tokenizer = Tokenizer(models.WordLevel(vocabulary, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "t.json"))
    weights = np.random.default_rng(1).normal(size=(5, 3))
    (tmp_path / "m.onnx").write_bytes(tiny_model(weights))
    unit = weights / np.linalg.norm(weights, axis=1, keepdims=True)
    model = OnnxModel(str(tmp_path / "m.onnx"), str(tmp_path / "t.json"), 3)
    table = spark.createDataFrame([(1, "low high"), (2, "high and then a long text"), (3, "other"), (4, None)], "id long, text string")
    got = {r.id: r.embedding for r in encoded(table.where("id < 4"), model, batch=2).collect()}
    assert np.allclose(got[1], unit[2], atol=1e-6) and np.allclose(got[2], unit[3], atol=1e-6) and np.allclose(got[3], unit[1], atol=1e-6)
    asked = OnnxModel(model.path, model.tokenizer, 3, prefix="ask ")
    assert np.allclose([r.embedding for r in encoded(table, asked).collect()], unit[4], atol=1e-6)
    options = model.options()
    assert options.intra_op_num_threads == 1 and not options.enable_cpu_mem_arena


def test_made_once_follows_the_files(spark, tmp_path):
    made, path = [], str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    first = made_once(spark, "x", [path], made.append)
    assert made_once(spark, "x", [path], made.append) == first and len(made) == 1
    before = fingerprint(spark, path)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert fingerprint(spark, path) != before and made_once(spark, "x", [path], made.append) != first


def test_writing_encodes_each_text_once(spark, tmp_path):
    """Sampling for the ranges of the files used to run the encoder over all texts a second time."""

    @dataclass(frozen=True)
    class CountingModel(HashModel):
        path: str = ""

        def load(self):
            encode = HashModel(self.dim).load()

            def noted(texts):
                with open(self.path, "a") as out:
                    out.write("x" * len(texts))
                return encode(texts)

            return noted

    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, label_key string, top_code string, section_path string, text string")
    LabelStore.write(chunks, str(tmp_path / "once"), CountingModel(64, str(tmp_path / "texts")))
    assert len((tmp_path / "texts").read_text()) == len(CHUNKS)
