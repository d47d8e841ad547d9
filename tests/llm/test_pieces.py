import math
import os
import random

import numpy as np
import pytest

from attestor.llm.pieces import MARK, MODEL, Pieces, Trie, decode, encode, load


def small():
    words = [MARK, b"a", b"b", b"ab", MARK + b"a", MARK + b"ab", b"ba", b"aab", "é".encode(), MARK + MARK, b"bbb"]
    scores = np.full(300, -9.0)
    scores[: len(words)] = [-2.5, -2.0, -2.2, -3.1, -2.9, -4.0, -3.3, -4.4, -5.0, -3.0, -4.1]
    return Pieces([(w, i) for i, w in enumerate(words)], scores, list(range(40, 296))), words


def all_best(p, words, s):
    """Score of the best path by trying all of them (s: str with markers)."""
    known = {w.decode(): i for i, w in enumerate(words)}
    best = {len(s): 0.0}
    for i in range(len(s) - 1, -1, -1):
        options = [p.scores[known[s[i:j]]] + best[j] for j in range(i + 1, len(s) + 1) if s[i:j] in known]
        if s[i] not in known:
            options.append(p.unknown + best[i + 1])
        best[i] = max(options)
    return best[0]


def test_trie_finds_what_it_holds():
    r = random.Random(2)
    words = sorted({bytes(r.choice(b"abc\xc3\xa9\xff\x00") for _ in range(r.randint(1, 6))) for _ in range(500)})
    trie = Trie([(w, i) for i, w in enumerate(words)])
    assert [trie.find(w) for w in words] == list(range(len(words)))
    assert all(trie.find(w + b"z") == -1 for w in words)


def test_paths_equal_brute_force():
    p, words = small()
    r = random.Random(1)
    texts = ["".join(r.choice("aab éx \n▁") for _ in range(r.randint(0, 30))) for _ in range(400)]
    for text, ids in zip(texts, p.encode_many([t.encode() for t in texts])):
        assert p.decode(ids.tolist()) == text.encode()
        if text and "▁" not in text:
            runs, score = [], 0.0
            for i in ids.tolist():
                score += p.scores[i] if i < 40 else 0.0
            unknown = sum(c in "x\n" for c in text)
            assert math.isclose(score + unknown * p.unknown, all_best(p, words, ("▁" + text.replace(" ", "▁"))))


def test_many_at_once_equals_one_by_one():
    p, _ = small()
    r = random.Random(3)
    stretches = [(MARK * r.randint(0, 2) + "".join(r.choice("abéxß") for _ in range(r.randint(1, 9))).encode()) for _ in range(300)]
    assert p.best_of_many(stretches) == [p.best(s) for s in stretches]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_round_trip_of_texts(spark):
    texts = [None, "", " ", "  two  spaces ", "line\n\n end", "tab\tand\x0bnul\x00", "日本語 ▁▁ marker ▁", "é" * 5000, "x" * 3000, "emoji 🎉🏽 done", "word " * 9000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = encode(df)
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.round_trip for r in rows.values()) and rows[0].ids == [] and rows[1].n_pieces == 0
    assert {r.doc_id: r.text for r in decode(out).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode(df.limit(0)).count() == 0
    assert len(load().trie.check) < 1_000_000
