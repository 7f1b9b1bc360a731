from pyspark.sql import functions as F

from isotwin.llm.splits import _combine, allocate, balanced_bins, components, peptide_chain, split_records

import numpy as np


def test_peptide_chains(spark):
    cases = {"_CNVAENYNEQTVNSTR_.3": "CNVAENYNEQTVNSTR", "[Acetyl]-LSEPYPLLVGEAWVM*QLFM*FNR": "LSEPYPLLVGEAWVMQLFMFNR", "Ac-LVDNQWK-NH2": "LVDNQWK", "R.DGAHDYC(unimod 4)NK.V": "DGAHDYCNK", "K.AAGR.-": "AAGR", "MAYCeGYHHk": "MAYCEGYHHK", "HNSWNQK[+8.014]": "HNSWNQK", "(UniMod:1)EEDIK2": "EEDLK", "PEPTLDE/2": "PEPTLDE", "FPY ADEEX\t": "FPYADEEX", "-.ACDR.K": "ACDR", "  ": None, "": None, None: None}
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", peptide_chain(F.col("s")).alias("p")).collect()
    assert {r["s"]: r["p"] for r in got} == cases


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, label boolean, peptide string, split string, component string").drop("split", "component").withColumn("weight", F.lit(1))


def test_together_and_near_targets(spark):
    rows = [(i, bool(i % 3), f"P{i % 400}" if i % 10 else "HOT", None, None) for i in range(6000)] + [(9001, None, "lone", None, None), (9002, True, None, None, None)]
    out = split_records(records(spark, rows), {"train": 0.8, "dev": 0.1, "test": 0.1, "none": 0.0}, ["peptide"]).toPandas()
    assert len(out) == 6001 and out.record_id.is_unique
    assert out.groupby("peptide").split.nunique().max() == 1
    shares = out.split.value_counts(normalize=True)
    assert abs(shares["train"] - 0.8) < 0.02 and set(shares.index) == {"train", "dev", "test"}
    true = out[out.label.notna()].groupby("split").label.apply(lambda x: x.astype(float).mean())
    assert true.max() - true.min() < 0.03


def test_empty_and_single(spark):
    assert split_records(records(spark, []), {"a": 1.0}, ["peptide"]).count() == 0
    assert split_records(records(spark, [(1, None, "P", None, None)] * 2), {"a": 0.5, "b": 0.5}, ["peptide"]).count() == 2


def test_components_through_several_keys(spark):
    rows = [(i, f"a{i}", f"b{(i + 1) // 2}") for i in range(40)] + [(100, "a1", None), (101, None, None), (102, "z", "z")]
    df = spark.createDataFrame(rows, "record_id bigint, k1 string, k2 string")
    got = {r["record_id"]: r["component"] for r in components(df, "record_id", ["k1", "k2"]).collect()}
    assert got[1] == got[2] == got[100] and got[3] == got[4] != got[1] and 101 not in got and got[102] not in (got[1], got[3])
    chain = spark.createDataFrame([(i, f"x{i}", f"x{i + 1}") for i in range(60)], "record_id bigint, k1 string, k2 string")
    both = chain.select("record_id", F.explode(F.array("k1", "k2")).alias("k"))
    # A long chain through one shared vocabulary of values is one component.
    pairs = both.groupBy("k").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b"))
    links = pairs.selectExpr("monotonically_increasing_id() as record_id", "concat('r', a) as k1", "concat('r', b) as k2")
    same = links.selectExpr("record_id", "least(k1, k2) as k1", "greatest(k1, k2) as k2")
    assert components(same, "record_id", ["k1", "k2"]).count() == 61


def test_differencing_keeps_all_and_balances(spark):
    rng = np.random.default_rng(0)
    w = rng.pareto(1.5, (20, 8))
    total, places = _combine(w)
    sums = np.zeros(8)
    for row, place in zip(w, places):
        assert sorted(place) == list(range(8))
        np.add.at(sums, place, row)
    assert np.allclose(sums, total) and np.ptp(total) < max(w.max(), 1) and total.sum() > 0
    df = spark.createDataFrame([(0, f"c{i}", int(x)) for i, x in enumerate(rng.integers(1, 50, 3000))], "stratum int, component string, weight bigint")
    bins = balanced_bins(df, 16).join(df, ["stratum", "component"]).groupBy("bin").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).toPandas()
    assert len(bins) == 16 and bins.n.sum() == 3000 and bins.w.max() - bins.w.min() <= 50


def test_allocation_moves_bins_to_their_targets():
    bins = [(s, b, 10.0, 10.0 * s, 10.0) for s in (0, 1) for b in range(50)]
    got = allocate(bins, {"x": 0.7, "y": 0.3})
    n = {k: sum(v == k for v in got.values()) for k in "xy"}
    assert n == {"x": 70, "y": 30} and sum(v == "y" and k[0] == 1 for k, v in got.items()) == 15
    assert allocate([], {"x": 1.0}) == {}


def test_a_peptide_with_a_third_of_the_rows(spark):
    """The hot peptide goes whole to one split, and the others fill up to their targets."""
    rows = [(i, bool(i % 2), "HOT" if i % 3 == 0 else f"P{i % 900}", None, None) for i in range(9000)]
    out = split_records(records(spark, rows), {"train": 0.6, "dev": 0.2, "test": 0.2}, ["peptide"]).toPandas()
    shares = out.split.value_counts(normalize=True)
    assert len(out) == 9000 and out.groupby("peptide").split.nunique().max() == 1
    assert abs(shares["train"] - 0.6) < 0.02 and abs(shares["dev"] - 0.2) < 0.02
