import random
import re

import pytest

from attestor.llm.near_dedup import PRODUCTION, near_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=3, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(2, 120))]
        rows.append((i, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "É a"), (n + 6, "é a"), (n + 7, "x " * 30000)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    got = near_groups(spark.createDataFrame([(*r, "src") for r in rows], "doc_id long, text string, component_id string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows)


def test_a_large_group_of_near_copies_meets(spark):
    r = random.Random(5)
    base = [f"v{r.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[r.randrange(150)] = f"z{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_empty_table_and_threshold(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert 100 < PRODUCTION.most_flips() < 300


@pytest.mark.parametrize("repeat", [2])
def test_repeated_rows_are_one_document(spark, repeat):
    rows = [(1, "a b c d e f")] * repeat + [(2, "a b c d e f")]
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1}
