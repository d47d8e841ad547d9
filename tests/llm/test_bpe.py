import hashlib
import os
import random
import unicodedata

import pytest

from attestor.llm import bpe as m

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def model():
    return m.parsed(m.specification())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def same(model, library, texts):
    for text, ids, want in zip(texts, model.encode_many(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert list(memoryview(ids).cast("I")) == want.ids, (text[:80], want.tokens[:20])
        assert model.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_every_character_alone_doubled_and_among_others(model, library):
    chars = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and (unicodedata.category(c) not in ("Cn", "Co") or ord(c) < 0x20000 or ord(c) % 101 == 0)]
    texts = [f"a{c}{c}1 {c}É'{c}s{c}" for c in chars]
    same(model, library, [" ".join(texts[i : i + 32]) for i in range(0, len(texts), 32)])


def test_marks_compose_and_move_as_in_the_library(model, library):
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    same(model, library, [f"a{c}̣bá{c} e{c}̣́{c}ͅ {c}̣̈́ ᾼ{c}́" for c in marks])
    same(model, library, ["".join(c for d in unicodedata.decomposition(chr(c)).split() if d[0] != "<" for c in chr(int(d, 16))) for c in range(0x110000) if unicodedata.decomposition(chr(c))])


def test_random_texts(model, library):
    r = random.Random(13)
    alphabet = ["the", "ing", "'s", "'ll", "'", "S", " ", "  ", "\n", "\t", "\x1c", "\u0085", " ", "7", "42", "é", "é", "ß", "ΑΣ", "Σ", "İ", "ﬁ", "漢字", "한", "🙂", "‍", "!!", "...", "_", "<|endoftext|>", "<|startoftext|>", "<|", "x", "Q", "\x00", "Ⅳ", "½", "̧"]
    same(model, library, ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(5000)])


def test_long_words_by_heap_and_scan(model, library, monkeypatch):
    r = random.Random(5)
    texts = ["a" * 5001, "ab" * 900, "漢字仮名" * 400, "".join(r.choice("etaoinshr") for _ in range(30_000)), "!" * 4000, "x " * 50_000]
    same(model, library, texts)
    every = {"".join(r.choice("etaoins") for _ in range(r.randint(1, 90))) for _ in range(300)}
    side = model.learn(every)
    monkeypatch.setattr(m, "SIDE", 7)
    assert model.learn(every) == side
    monkeypatch.setattr(m, "SHORT", 0)
    assert model.learn(every) == side


def test_bounded_table_forgets_without_changing_results(model, library, monkeypatch):
    monkeypatch.setattr(m, "REMEMBERED", 3)
    model.known.clear()
    for text in ["one two", "three", "four five six seven " + "long" * 30, "one two one", ""]:
        same(model, library, [text, text.upper()])
        assert len(model.known) <= 7


def test_query_equals_the_library_on_the_table(spark, library):
    rows = {x.doc_id: x for x in m.op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = library.encode(d.text or "", add_special_tokens=False).ids
        got = rows[d.doc_id]
        assert got.n_tokens == len(want)
        assert got.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(m, "STEP_CHARS", 10)
    rows = [(1, None, 9), (2, "", 9), (3, " \n\t ", 9), (4, "same text", 9), (4, "same text", 9), (5, "word " * 60_000, 9), (None, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(2)
    held = m.decode(m.encode(docs)).collect()
    assert sorted((x.doc_id or 0, x.n_tokens, x.decoded[:12]) for x in held) == [(0, 1, "x</w>"), (1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 2, "same</w> tex"), (4, 2, "same</w> tex"), (5, 60_000, "word</w> wor")]
    both = m.encode(docs, decoded=True)
    assert sorted(map(tuple, both.na.fill(0).collect())) == sorted((x.doc_id or 0, x.n_tokens, x.ids, x.decoded) for x in held)
    assert m.encode(docs.limit(0)).count() == 0
    with_more = docs.select("doc_id", "text", "ids", docs["ids"].alias("n_tokens"), docs["ids"].alias("decoded"))
    assert m.decode(m.encode(with_more)).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    with pytest.raises(ValueError):
        m.parsed(m.specification("/opt/tokenizers/byte_bpe_50k.json"))
