import hashlib
import random

import numpy as np
import pytest

from attestor.llm.bwt import build
from attestor.llm.suffix_dedup import remove_repeats


def naive(strings, cap):
    """Sorted suffixes with end marks that follow the strings' order."""
    rows = sorted(([(1, c) for c in s[j:]] + [(0, i)], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
    b = [strings[i][j - 1] + 1 if j else 0 for _, i, j in rows]
    lcp = [0]
    for x, y in zip(rows, rows[1:]):
        n = 0
        while x[0][n] == y[0][n]:
            n += 1
        lcp.append(min(n, cap))
    return b, lcp


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_transform_equals_sorted_suffixes(block):
    r = random.Random(block)
    for _ in range(60):
        strings = [bytes(r.choice(b"ab\x00\xff" if r.random() < 0.3 else b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 9))]
        cap = r.choice([2, 100])
        columns = build(strings, cap, block=block)
        b, depth = columns.transform()
        columns.close()
        assert (b.tolist(), depth.tolist()) == naive(strings, cap)


def brute(rows, n):
    seen = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i, t in texts.items():
        for j in range(len(t) - n + 1):
            seen[t[j : j + n]] = seen.get(t[j : j + n], 0) + 1
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - n + 1):
            if seen[t[j : j + n]] > 1:
                gone[j : j + n] = True
        gone = gone[:-1]
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60, size=200):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdé \n") for _ in range(k))
    passages = [text(r.randint(size - 20, 3 * size)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages) if r.random() < 0.6 else text(r.randint(1, size))
            if r.random() < 0.4:
                k = r.randrange(len(p))
                p = p[:k] + "X" + p[k + r.randint(0, 2) :]
            t += p
        rows.append((i, t))
    rows += [(900, None), (901, ""), (902, "ab" * 300), (903, "z" * size), (904, "y" * (size + 1)), (905, rows[3][1])]
    return rows


@pytest.mark.parametrize("length,anchor", [(200, 144), (30, 20)])
def test_equals_brute_force(spark, length, anchor):
    rows = corpus(length, size=length)
    got = remove_repeats(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string"), length, anchor).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows, length)


def test_slices_of_a_long_text(spark, monkeypatch):
    rows = corpus(9, n=10)
    rows.append((2000, "".join(t or "" for _, t in rows) * 2))
    import attestor.llm.seeds as seeds
    from attestor.llm.suffix_dedup import _layout

    text = rows[-1][1].encode()
    places = set()
    for group in seeds.slices([text], 400, 1000):
        _, _, _, at, part, _ = _layout(group, 200, 128)
        _, begin = 0, np.concatenate(([0], np.cumsum([len(x[4]) + 1 for x in group])))
        places |= {int(group[p][1] + a - begin[p]) for a, p in zip(at, part)}
    whole = next(seeds.slices([text], 400, 1 << 20))
    assert places == set(_layout(whole, 200, 128)[3].tolist())


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
