import random

import numpy as np

from attestor.llm.line_dedup import PRODUCTION, WHOLE, dedup_lines, line_figures, normal, shared_bands


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, p=PRODUCTION):
    lines = [(i, k, normal(x.encode())) for i, t in rows for k, x in enumerate((t or "").split("\n")) if len(normal(x.encode()).split()) >= p.least]
    forms = sorted({f for _, _, f in lines})
    _, _, _, _, sim = line_figures([f.encode() for f in forms])
    parent = list(range(len(forms)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(forms)):
        for j in range(i):
            if bin(int(sim[i]) ^ int(sim[j])).count("1") <= p.flips:
                n = max(len(forms[i]), len(forms[j]))
                if distance(forms[i], forms[j]) <= (100 - p.percent) * n // 100:
                    parent[find(i)] = find(j)
    of = {f: find(i) for i, f in enumerate(forms)}
    first = {}
    for i, k, f in lines:
        first[of[f]] = min(first.get(of[f], (i, k)), (i, k))
    gone = {(i, k) for i, k, f in lines if first[of[f]] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_equals_brute_force(spark):
    r = random.Random(8)
    vocab = [f"wörd{chr(97 + i % 26)}{i}" for i in range(300)]
    pool = [[r.choice(vocab) for _ in range(r.randint(3, 60))] for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(pool)) if r.random() < 0.8 else [r.choice(vocab) for _ in range(20)]
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(["Word1,", "x", "7", w[0].upper()])
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "one two\none two"), (104, "a b c d e f\nA b, c d e f\na b c d e f"), (105, "z " * 60000)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, key string")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_removed"]
    got = {x.doc_id: x.text for x in out.collect()}
    assert got == brute(rows)
    assert got[104] == "a b c d e f" and got[103] == "one two\none two"


def test_empty_table_and_long_lines(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = ("w " * 70000).encode()
    _, _, n, _, sim = line_figures([one, b"w w w"])
    assert n.tolist() == [70000, 3] and sim[0] == sim[1] != np.uint64(0)


def variant(r, vocab, words):
    """A line with replaced, deleted and added words, as many as edit similarity 0.8 allows."""
    out, line = list(words), " ".join(words)
    for _ in range(200):
        w, k = list(out), r.randrange(len(out))
        w[k : k + 1] = r.choice(([r.choice(vocab)], [], [w[k], r.choice(vocab)]))
        if not w or distance(line, " ".join(w)) > 0.2 * max(len(line), len(" ".join(w))):
            break
        out = w
    return None if out == words else out


def test_recall_at_edit_similarity_alone(spark):
    """Lines as near to edit similarity 0.8 as word edits bring them: their SimHashes are mostly over 2 bits apart."""
    r = random.Random(80)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = []
    for n in (6, 8, 12, 16, 20, 40):
        for _ in range(60):
            words = [r.choice(vocab) for _ in range(n)]
            other = variant(r, vocab, words)
            if other and len(other) >= 5:
                rows.append((len(rows), " ".join(words), n))
                rows.append((len(rows), " ".join(other), n))
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    gone = {x.doc_id for x in dedup_lines(df, WHOLE).where("n_removed > 0").collect()}
    assert not any(i % 2 == 0 for i in gone)
    for n in (6, 8, 12, 16, 20, 40):
        of = [i for i, _, k in rows if k == n and i % 2]
        assert len(of) > 30 and sum(i in gone for i in of) >= 0.85 * len(of), n
    assert len(gone) >= 0.9 * len(rows) / 2


def test_equal_short_lines_are_one(spark):
    rows = [(1, "Menu\nhome\n\n漢字の行\n..."), (2, "\nmenu!\nShare this\n漢字の行\n..."), (3, "share THIS\nshare that")]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), WHOLE).collect()}
    assert got == {1: rows[0][1], 2: "\nShare this\n...", 3: "share that"}


def test_shared_band_keys_are_those_of_two_lines(spark):
    """Keys of 47 bits, the highest ones too; a line that comes twice, or has a key twice, does not share it."""
    r = random.Random(47)
    pool = [r.randrange(1 << 47) for _ in range(3000)] + [(1 << 47) - 1, (1 << 47) - 2, 0]
    rows = [(r.randrange(-(1 << 63), 1 << 63), [r.choice(pool) for _ in range(r.randint(0, 8))]) for _ in range(700)]
    rows += [(5, [(1 << 47) - 1] * 2), (6, [(1 << 47) - 1]), (7, [1, 1, 2]), (7, [1, 2]), (8, [])]
    held = {}
    for i, keys in rows:
        for k in keys:
            held.setdefault(k, set()).add(i)
    df = spark.createDataFrame(rows, "key long, bands array<long>").repartition(6)
    got = [x.key for x in shared_bands(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {k for k, ids in held.items() if len(ids) > 1}
    assert not {1, 2} & set(got)
    assert shared_bands(df.limit(0)).count() == 0


def test_band_keys_are_shuffled_as_blocks(spark):
    """A row for each key of each line took 634 MB of shuffle and 90 of 515 task seconds on 0.5 GB."""
    df = spark.createDataFrame([(i, [i % 7, 8, 9]) for i in range(4000)], "key long, bands array<long>").coalesce(1)
    plan = shared_bands(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Aggregate" not in plan
    assert {x.key for x in shared_bands(df).collect()} == {0, 1, 2, 3, 4, 5, 6, 8, 9}


def test_steps_leave_no_tables_behind(spark):
    import os

    from attestor.llm.common import shared_dir

    at = shared_dir(spark).removeprefix("file:") + "/attestor"
    names = lambda: {x for x in os.listdir(at) if x.startswith(("op1-near", "op1-forms", "op1-hopeful"))} if os.path.isdir(at) else set()
    before = names()
    rows = [(i, " ".join(["alpha beta gamma delta epsilon zeta eta theta", f"x{chr(97 + i % 26)}"])) for i in range(60)]
    assert dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), WHOLE).where("n_removed > 0").count() == 59
    assert names() == before


def test_texts_are_read_once_for_all_questions(spark, monkeypatch):
    """Normal forms came from a reading of the texts for each of four questions: 230 of 1374 task seconds on 0.5 GB."""
    from attestor.llm import line_dedup

    names, write = [], line_dedup.staged
    monkeypatch.setattr(line_dedup, "staged", lambda df, name: (names.append(name), write(df, name))[1])
    r = random.Random(3)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    base = [r.choice(vocab) for _ in range(20)]
    rows = []
    for i in range(80):
        words = list(base)
        for k in r.sample(range(20), 9):
            words[k] = r.choice(vocab)
        rows.append((i, " ".join(words)))
    dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), WHOLE).collect()
    assert names.count("op1-near") == 3 and names.count("op1-forms") == 1
