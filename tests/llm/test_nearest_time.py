import random

from isotwin.llm.nearest_time import nearest_in_time

L, R = "left_id bigint, entity string, time double, value double, lower string", "right_id bigint, entity string, time double, lower double, upper double, left_id string"


def pairs(spark, left, right, tol=0.05, **kw):
    out = nearest_in_time(spark.createDataFrame([(*x, "x") for x in left], L), spark.createDataFrame([(*x, "x") for x in right], R), tol, **kw)
    return {r["left_id"]: r["right_id"] for r in out.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(4)
    right = [(i, rnd.choice("ab"), rnd.randrange(0, 400) / 100, lo, lo + rnd.choice([20.0, 45.0, 300.0])) for i in range(500) for lo in [rnd.choice([400.0, 430.0, 460.0, 500.0])]]
    left = [(i, rnd.choice("abc"), rnd.randrange(-10, 420) / 100, rnd.uniform(390, 560)) for i in range(300)]
    want = {}
    for i, e, t, v in left:
        near = [(abs(t - s), r) for r, f, s, lo, up in right if f == e and lo <= v <= up and abs(t - s) <= 0.05]
        if near:
            want[i] = min(near)[1]
    assert pairs(spark, left, right + right[:100]) == want
    # Widths from nothing to very wide at once.
    odd = [(1000 + i, e, t, lo, lo + [0.0, 1e-6, 5000.0][i % 3]) for i, e, t, lo, _ in right[:90]]
    best = {}
    for i, e, t, v in left + [(900 + k, e, t, lo) for k, (_, e, t, lo, _) in enumerate(odd)]:
        near = [(abs(t - s), r) for r, f, s, lo, up in right + odd if f == e and lo <= v <= up and abs(t - s) <= 0.05]
        if near:
            best[i] = min(near)[1]
    assert pairs(spark, left + [(900 + k, e, t, lo) for k, (_, e, t, lo, _) in enumerate(odd)], right + odd) == best


def test_ties_nulls_and_edges(spark):
    nan = float("nan")
    right = [(5, "a", 1.0, 0.0, 9.0), (3, "a", 1.0, 0.0, 9.0), (2, "a", 1.5, 0.0, 9.0), (9, "a", 1.25, None, 9.0), (10, "a", nan, 0.0, 9.0), (11, "a", 1.26, nan, nan), (12, None, 1.0, 0.0, 9.0), (13, "a", None, 0.0, 9.0), (14, "a", 1.25, 9.0, 0.0)]
    left = [(1, "a", 1.25, 5.0), (2, "a", 1.0, 9.0), (3, "a", 1.0, 9.5), (4, None, 1.0, 5.0), (5, "a", None, 5.0), (6, "a", 1.0, None), (7, "a", 2.0, 5.0), (2, "a", 1.0, 9.0), (8, "a", 1.75, 0.0)]
    assert pairs(spark, left, right, tol=0.25) == {1: 2, 2: 3, 8: 2}
    assert pairs(spark, [], right) == {} and pairs(spark, left, []) == {}
