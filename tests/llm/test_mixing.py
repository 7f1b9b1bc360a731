import numpy as np
import pytest

from isotwin.llm.mixing import count_tokens, flight, landing, mix, mix_shares

C, T = "doc_id bigint, source string, tokens bigint, repeats bigint", "source string, target_share double, max_repeats int"


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(1)
    tokens = rng.integers(50, 900, 400)
    p = np.full(400, 0.37)
    out = flight(p, tokens, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * tokens).sum() == pytest.approx((p * tokens).sum())
    mean = np.mean([flight(np.array([0.2, 0.5, 0.7, 0.6, 0.4, 0.6]), np.array([1, 2, 3, 4, 5, 6]), np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.allclose(mean, [0.2, 0.5, 0.7, 0.6, 0.4, 0.6], atol=0.04)
    assert set(flight(np.array([0.5] * 4), np.array([7] * 4), rng)) <= {0.0, 1.0, 0.5}
    assert landing([0.9, 0.1], [10, 10]) == [1, 0] and landing([], []) == []


def test_shares_caps_and_whole_result(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "big" if i < 5000 else "small" if i < 5060 else "other" if i < 7000 else None, int(rng.integers(10, 500)), 0) for i in range(7100)]
    counted = spark.createDataFrame(rows, C)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 20), ("other", 0.3, 3), ("absent", 0.1, 9), (None, 0.1, 1)], T)
    chosen = mix(counted.drop("repeats"), targets, block=300).toPandas()
    assert chosen.doc_id.is_unique and set(chosen.source) == {"big", "small", "other"}
    assert all(chosen[chosen.source == s].repeats.max() <= cap for s, cap in (("big", 1), ("small", 20), ("other", 3)))
    sums = chosen.assign(t=chosen.tokens * chosen.repeats).groupby("source").t.sum()
    for s, share in (("big", 0.5), ("small", 0.1), ("other", 0.3)):
        assert sums[s] / sums.sum() == pytest.approx(share / 0.9, abs=0.001)
    again = mix(counted.drop("repeats"), targets, block=300).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, chosen.values.tolist()))
    shares = {r["source"]: r for r in mix_shares(spark, spark.createDataFrame(chosen), targets.where("source is not null")).collect()}
    assert shares["absent"]["tokens"] == 0 and sum(r["actual_share"] for r in shares.values()) == pytest.approx(1)
    few = mix(counted.drop("repeats"), targets, total_tokens=20_000).toPandas()
    assert (few.tokens * few.repeats).sum() == pytest.approx(20_000, rel=0.05)


def test_nothing(spark):
    none, targets = spark.createDataFrame([], C).drop("repeats"), spark.createDataFrame([("a", 1.0, 1)], T)
    assert mix(none, targets).count() == 0
    assert mix(spark.createDataFrame([(1, "a", 0, 0)], C).drop("repeats"), targets).count() == 0
    assert mix(spark.createDataFrame([(1, "a", 5, 0), (2, "a", 5, 0)], C).drop("repeats"), targets).count() == 2


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, "", "a"), (3, None, "a"), (4, "word " * 20000, None)], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in count_tokens(df).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] >= 20000
