import hashlib
import random
import re

from attestor.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    low = {}
    for i in sorted(words):
        for j in range(len(words[i]) - n + 1):
            low.setdefault(tuple(words[i][j : j + n]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - n + 1):
            if low[tuple(w[j : j + n])] < i:
                gone |= set(range(j, j + n))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n=80, vocab=60):
    r = random.Random(seed)
    names = [f"wö{i}" for i in range(vocab)]
    passages = [[r.choice(names) for _ in range(r.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choice(passages) if r.random() < 0.5 else [r.choice(names) for _ in range(r.randint(1, 30))]
            if w and r.random() < 0.4:
                w[r.randrange(len(w))] = "edit"
        rows.append((i * 3, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (1003, "a " * 500), (1004, "a " * 40 + "b"), (1005, " \x0b ")]
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pos int")).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c"), (1, "a b c")]
    assert remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
