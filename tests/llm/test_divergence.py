import os
import random
import re
from collections import Counter, defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from attestor.llm import divergence as m

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, least=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda x: x[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        for s in sources:
            whole.update(counts[lang, s])
        of, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(of[s][t], q[t]), t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= 10}
    return out


def made(r, n):
    vocab = ["the", "The", "éa", "É", "漢字", "漢", "zz", "z", "zzz", "don't", "x1y", "_", "\x00nul", "𝒜", "�", "Ab-cD"] + ["".join(r.choice("abé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = []
    for _ in range(n):
        text = r.choice([" ", "\n", "7"]).join(r.choice(vocab) for _ in range(r.randint(0, 40)))
        rows.append((r.choice([text] * 9 + [None]), r.choice(["en", "en", "en", "de", None]), r.choice(["a", "b", "c", "ä", None] + ["hot"] * 4)))
    return rows + [("rare words only", "xx", "a"), ("", "xx", "b"), (None, "xx", "c"), ("alone " * 30, "yy", "a")] + [("only", "zz", "one")] * 12


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    return m.audit(docs, **options).collect()


@pytest.mark.parametrize("bounds", [{}, {"COUNTERS": 5, "BLOCK": 3, "ENTRIES": 8, "STEP_TERMS": 40, "SLOTS": 64, "SLOT_BLOCK": 16, "BROADCAST_GROUPS": 0}, {"SUMMED_SOURCES": 1, "TERM_BYTES": 100}])
def test_equals_brute_force(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(m, k, v)
    rows = made(random.Random(11), 400)
    got = found(spark, rows)
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == brute(rows)


def test_query_equals_sql(spark):
    oracle.compare(spark, SF, m.op11_divergence, m.SQL)


def test_slots_rule_out_no_kept_term(spark):
    rows = made(random.Random(3), 200)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    slots = m.possible(docs, 7)
    seen = defaultdict(Counter)
    for text, lang, _ in rows:
        seen[lang or ""].update(set((text or "").encode().translate(m._TERMS).split()))
    for lang, counter in seen.items():
        ok = dict(zip(counter, slots[m._slots(lang, list(counter), len(slots))]))
        assert all(ok[t] for t, n in counter.items() if n >= 7) and sum(ok.values()) == sum(n >= 7 for n in counter.values())


def test_trie_holds_terms_in_order_and_merges():
    r = random.Random(4)
    terms = [bytes(r.choice(b"ab\xc3\xa9") for _ in range(r.randint(1, 7))) for _ in range(3000)]
    tries = [m.Trie(), m.Trie()]
    for i, t in enumerate(terms):
        tries[i % 2].add(t, {"s": 1, f"s{i % 3}": 2}, 1)
    for term, counts, docs in list(tries[1].leaves()):
        tries[0].add(term, counts, docs)
    leaves = list(tries[0].leaves())
    assert [t for t, _, _ in leaves] == sorted(set(terms))
    assert {t: (c["s"], d) for t, c, d in leaves} == {t: (n, n) for t, n in Counter(terms).items()}
    assert tries[0].counters == sum(len(c) for _, c, _ in leaves)


def test_probabilities_are_exact():
    import numpy as np

    r = random.Random(8)
    for _ in range(300):
        total = r.choice([r.randint(0, 50), r.randint(0, 10**15)])
        count, kept = r.randint(0, total), r.randint(1, 10**9)
        want = 1 + 1_000_000_000 * (count + 2) // (total + 2 * kept)
        assert m.probability(np.array([count]), np.array([total]), kept).tolist() == [want]
    assert m.distance(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18 // (10**9 + 2)]


def test_defined_cases(spark):
    docs = spark.createDataFrame([("a b", "en", "s"), ("b", "en", "t")], "text string, lang string, source string")
    clash = docs.withColumns({c: F.lit(1) for c in ("term", "sources", "counts", "item", "value", "rank", "part", "terms")})
    assert {tuple(x) for x in m.audit(clash, least=1).collect()} == brute([("a b", "en", "s"), ("b", "en", "t")], 1)
    assert m.audit(docs.limit(0)).collect() == []
    long = [("word " * 200_000 + "q" * 300_000, "en", s) for s in "ab"] + [("other", "en", "c")]
    assert {tuple(x) for x in found(spark, long, least=2)} == brute(long, 2)


def test_terms_enter_a_trie_in_order():
    """Sorted terms begin where they leave the one before; the leaves are those of single steps, in a filled trie too."""
    one, many = m.Trie(), m.Trie()
    steps = [[b"an", b"and", b"ander", b"b", b"bar", b"bat"], [b"a", b"anx", b"ba", b"bart", b"c"], [b"and", b"anderen", b"ank", b"c"]]
    for i, terms in enumerate(steps):
        for t in terms:
            one.add(t, {"s": len(t), f"s{i}": 1}, i + 1)
        many.add_sorted(terms, [{"s": len(t), f"s{i}": 1} for t in terms], [i + 1] * len(terms))
    assert list(many.leaves()) == list(one.leaves())
    assert [x[0] for x in many.leaves()] == sorted({t for terms in steps for t in terms})
    assert (many.counters, many.bytes) == (one.counters, one.bytes)
