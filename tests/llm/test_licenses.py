import re

from attestor.llm.licenses import BASE, rules, scan

TEXTS = [
    None,
    "",
    "  ,,, ",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0. And CC BY; cc by",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.",
    "GNU General Public License v2.0 or later, GPL-3.0-or-later",
    "the gnu general publicé license is not one",
    "mit license " * 400,
    "Released under the MIT License version 2 of the Apache License, Version 2.0 or later",
    "gnu gpl version 3.0 bsd license apache license mit licensed under bsd 3 clause license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "BSD 3-Clause; Mozilla Public License 2.0; no apache",
    "É mit licensed work — apache license",
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = " " + " ".join(words) + " "
    found = []
    for i, r in enumerate(rules()):
        if r.keyword in low:
            for m in re.finditer(f" (?:{r.pattern})(?= )", joined):
                start = joined[: m.start()].count(" ")
                found.append((start, start + m[0].count(" "), r.priority, i, r))
    base = [f for f in found if f[3] < len(BASE)]
    order = sorted(found, key=lambda f: (f[0], -f[1], -f[2], f[3]))
    beaten = lambda k, f: any(g[2] > f[2] and g[0] < f[1] and f[0] < g[1] for g in order) or any(g[2] == f[2] and g[1] >= f[1] for g in order[:k])
    stays = [f for k, f in enumerate(order) if not beaten(k, f)]
    starts = [f[0] for f in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({f[4].label for f in base})), ",".join(sorted({f[4].label for f in base + stays})),
        max((f[4].score for f in stays), default=0.0), len(found), len(found) - len(stays),
    )


def test_equals_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[4:7], "doc_id long, text string, label string")
    got = {r[0]: tuple(r)[1:] for r in scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert got[4][5] == "cc-by,cc-by-nc-4.0" and got[5][5] == "gpl,gpl-3.0" and got[6][5] == "apache,apache-2.0"


def test_many_matches_in_a_long_text(spark):
    df = spark.createDataFrame([(1, "mit license " * 100_000)], "doc_id long, text string")
    row = scan(df).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (200_000, 100_000, 0, 199_998)


def test_rules_and_empty_table(spark):
    assert len(rules()) > 300 and all(re.compile(r.pattern) for r in rules())
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_usual_forms_are_reached(spark):
    texts = {
        "Common Development and Distribution License, version 1.0": "cddl-1.0",
        "under GPLv2.": "gpl-2.0",
        "GPLv3 applies": "gpl-3.0",
        "LGPLv2.1": "lgpl-2.1",
        "GPLv2 or later": "gpl-2.0-or-later",
        "GNU General Public License version 2 or (at your option) any later version": "gpl,gpl-2.0-or-later",
        "ASL 2.0": "apache",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {list(texts)[r.doc_id]: r.labels for r in scan(df).collect()} == texts


def test_keywords_stand_in_their_patterns():
    """But for "either version N of the license", where the keyword tells the family."""
    for r in rules():
        if not r.pattern.startswith("either version"):
            assert r.keyword in re.sub(r"\(\?:[^()]*\)\??", "", r.pattern), r
