import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import whitening as m

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """Exact figures in Python integers and, from the exact covariance, doubles."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    cov = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(d)] for i in range(d)])
    deviation = {tuple(x): sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for x in fit}
    values, vectors = np.linalg.eigh(cov)
    return kept, n, sums, cov, deviation, values[::-1], vectors[:, ::-1]


def check(got, rows, components):
    kept, n, sums, cov, deviation, values, vectors = brute(rows)
    assert len(got) == len(kept) * components
    names = {i: x for i, x in kept}
    assert {r.n for r in got} == {n}
    signs = {}
    for r in got:
        x, j = names[r.vec_id], r.component - 1
        assert r.deviation == (v if (v := deviation[tuple(x)]) < 2**63 else None)
        assert math.isclose(r.explained, values[j] / np.trace(cov), rel_tol=1e-9)
        assert r.identity_error < 1e-9
        want = float(np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors[:, j] / math.sqrt(values[j]))
        if abs(want) > 1e-3:
            sign = signs.setdefault(j, np.sign(want) * np.sign(r.whitened))
            assert math.isclose(r.whitened * sign, want, rel_tol=1e-6, abs_tol=1e-8)


@pytest.mark.parametrize("scale", [0.3, 4e4, 3e12])
def test_equals_exact_arithmetic(spark, scale):
    r = random.Random(int(scale))
    base = [[r.gauss(0, scale * (1 + j)) for j in range(6)] for _ in range(150)]
    rows = [(i, v) for i, v in enumerate(base + base[:40] + [base[0]] * 30)]
    if scale > 1e10:
        rows = [(i, [c + 1e15 for c in v]) for i, v in rows]  # far from zero: nothing may cancel
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    model = m.fit(table, components=4)
    got = m.whiten(table, model).collect()
    if scale > 1e10:
        kept, n, sums, cov, deviation, values, _ = brute(rows)
        assert model.n == n and np.allclose(model.values, values[:4], rtol=1e-12)
        for x in got:
            want = deviation[tuple(dict(kept)[x.vec_id])]
            assert x.deviation == (want if want < 2**63 else None)
        assert max(x.identity_error for x in got) < 1e-9
    else:
        check(got, rows, 4)


def test_products_of_limbs_are_exact():
    r = random.Random(3)
    for bits in (1, 18, 19, 20, 39, 40, 61, 62, 90, 200):
        bound = (1 << bits) - 1
        values = [[r.choice([-bound, bound, r.randint(-bound, bound), 0]) for _ in range(3)] for _ in range(50)]
        y = np.array(values, np.int64 if bits < 62 else object)
        total = sum(np.array(x) << (m.LIMB_BITS * k) for k, x in enumerate(z.astype(np.int64).astype(object) for z in m.limbs(y, m.limb_count(bound))))
        assert (total == np.array(values, object)).all()
        assert (np.abs(np.stack(m.limbs(y, m.limb_count(bound)))) <= 1 << (m.LIMB_BITS - 1)).all()
        want = [[sum(v[i] * v[j] for v in values) for j in range(3)] for i in range(3)]
        assert m.gram(y, bound).tolist() == want
    full = np.full((m.BLOCK_ROWS, 2), -(1 << 19), np.int64)
    assert m.gram(full, 1 << 19).tolist() == [[m.BLOCK_ROWS << 38] * 2] * 2


def test_pieces_and_names_round_trip():
    for v in (0, -1, 5, -(2**130) + 7, 2**150 - 1):
        assert sum(p << (m.PIECE_BITS * k) for k, p in enumerate(m.pieces(v, 3))) == v
    y = np.array([[1, -(2**31) + 1], [2**31, 0], [-(2**62), 5], [7, 7]])
    assert (m.unpacked(m.packed(y), 2) == y).all() and (m.unpacked(m.packed(y[:1]), 2) == y[:1]).all()


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.sin(i * 7.0 + j) for j in range(3)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 2.0]), (103, [1.0, inf, 2.0]), (104, [1e300, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [])]
    rows = good + bad + [(None, good[3][1]), (5, good[5][1])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "whitened": F.lit(1), "x": F.lit(2), "d": F.lit(3)})
    got = m.whiten(table, m.fit(table)).collect()
    assert sorted({x.component for x in got}) == [1, 2, 3] and {x.n for x in got} == {40}
    assert sorted([x.vec_id for x in got if x.component == 1], key=lambda v: -1 if v is None else v) == [None, *range(6), 5, *range(6, 40)]
    none = table.limit(0)
    assert m.fit(none) is None and m.whiten(none, None).columns == [x.strip().split()[0] for x in m.WHITENED.split(",")]
    assert m.whiten(none, None).count() == 0
    assert m.fit(table.where("embedding is null")) is None
    empty = spark.createDataFrame([(1, []), (2, [])], SCHEMA)
    assert m.whiten(empty, m.fit(empty)).count() == 0
    one = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], SCHEMA)
    assert [(x.vec_id, x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in m.whiten(one, m.fit(one)).orderBy("vec_id", "component").collect()] == [(i, c, 1, 0, None, None, 0.0) for i in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], SCHEMA)  # no variance in the second component
    got = m.whiten(line, m.fit(line)).collect()
    assert all((x.whitened is None) == (x.component == 2) and x.identity_error < 1e-9 for x in got)


def test_result_does_not_depend_on_partitions(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    one, many = spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame(rows, SCHEMA).repartition(23)
    a, b = m.fit(one), m.fit(many)
    assert a.sums == b.sums and (a.vectors == b.vectors).all() and (a.values == b.values).all() and a.explained == b.explained
