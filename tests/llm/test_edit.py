import random

import numpy as np

from attestor.llm.edit import similar_pairs, within
from attestor.llm.graph import spanning


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def strings(r):
    out = ["", "a", "ab", "漢字の行", "x" * 64, "x" * 65, "y" * 64 + "x" * 64, "x" * 128, "é" + "x" * 127]
    for n in (5, 12, 40, 63, 64, 65, 100, 130, 200):
        for _ in range(5):
            base = [r.choice("abcdeé漢 ") for _ in range(n)]
            out.append("".join(base))
            for rate in (0.05, 0.15, 0.25):
                w = list(base)
                for _ in range(int(rate * n)):
                    k = r.randrange(len(w))
                    w[k : k + 1] = r.choice(([], [r.choice("abcdef")], [w[k], "q"]))
                    w = w or ["z"]
                out.append("".join(w))
    return out


def test_pairs_side_by_side_equal_the_distance_table():
    forms = strings(random.Random(5))
    r = np.random.default_rng(1)
    i, j = r.integers(0, len(forms), (2, 6000))
    near = np.arange(len(forms) - 1)
    i, j = np.append(i, near), np.append(j, near + 1)
    for percent in (80, 50):
        got = similar_pairs(forms, i, j, percent)
        for a, b, g in zip(i[-400:].tolist(), j[-400:].tolist(), got[-400:].tolist()):
            n = max(len(forms[a]), len(forms[b]))
            d = distance(forms[a], forms[b])
            assert g == (d <= (100 - percent) * n // 100) and within(forms[a], forms[b], d), (forms[a], forms[b])
        one = [within(forms[a], forms[b], (100 - percent) * max(len(forms[a]), len(forms[b])) // 100) for a, b in zip(i.tolist(), j.tolist())]
        assert got.tolist() == one and 100 < got.sum() < len(got)
    assert similar_pairs(forms, i[:0], j[:0], 80).tolist() == []


def test_pairs_side_by_side_at_the_edge_of_the_band():
    """Only added or only lost letters, as many as allowed: the path stands at the last rows that are computed."""
    r = random.Random(35)
    forms = []
    for n in (70, 93, 116, 141, 145, 200, 260, 400, 700, 2300):
        for _ in range(70):
            line = [r.choice("abcdefgh ") for _ in range(n)]
            start = r.choice((0, 0, r.randrange(n), n))
            for more in (n // 4, n // 4 + 1):
                forms += ["".join(line), "".join(line[:start] + [r.choice("abcd") for _ in range(more)] + line[start:])]
    i = np.arange(0, len(forms), 2)
    want = [within(forms[k], forms[k + 1], 20 * len(forms[k + 1]) // 100) for k in i.tolist()]
    assert similar_pairs(forms, i, i + 1, 80).tolist() == similar_pairs(forms, i + 1, i, 80).tolist() == want
    assert 300 < sum(want) < len(want) - 300


def test_spanning_links_connect_what_all_links_connect():
    r = np.random.default_rng(2)
    groups = r.integers(0, 400, 600)
    links = {tuple(x) for x in r.integers(0, 600, (500, 2)).tolist()}
    a, b = np.triu_indices(600, 1)
    got = spanning(groups, a, b, lambda x, y: np.array([(i, j) in links for i, j in zip(x.tolist(), y.tolist())], bool))

    def parts(pairs):
        root = {g: g for g in groups.tolist()}
        for i, j in pairs:
            s, t = root[groups[i]], root[groups[j]]
            root = {g: (s if c == t else c) for g, c in root.items()}
        return {frozenset(g for g in root if root[g] == c) for c in root.values()}

    assert parts(got.tolist()) == parts([(i, j) for i, j in links if i < j])
    assert len({tuple(sorted((groups[i], groups[j]))) for i, j in got.tolist()}) == len(got)
