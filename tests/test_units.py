import math

from pyspark.sql import functions as F

from isotwin.functions.times import run_stem, time_text, unit_of
from isotwin.operators.units import common_units, note_unit, source_links


def test_time_texts(spark):
    cases = {"25.7": (25.7, None), "42 min 57.09 s": (2577.09, "s"), "1 337 580 ms": (1337580.0, "ms"), "00:57:58.26": (3478.26, "s"), "PT10M6.43S": (606.43, "s"), "rt=10.183m": (10.183, "min"), "0.05662e3 s": (56.62, "s"), "0.0261833 Std.": (0.0261833, "h"), "10,32 Min.": (10.32, "min"), "10,5": (10.5, None), "": (None, None), "later": (None, None), None: (None, None)}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", time_text(F.col("t")).alias("x")).collect()
    for r in got:
        value, unit = cases[r["t"]]
        assert (None if r["x"]["value"] is None else round(r["x"]["value"], 8), r["x"]["unit"]) == (value, unit), r


def test_units_and_notes(spark):
    units = {"Millisek.": "ms", "Std.": "h", "m": "min", "Sek.": "s", "hr": "h", "nl": None, None: None}
    assert {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in units], "u string").select("u", unit_of(F.col("u"))).collect()} == units
    notes = {"trap time 1500 ms / DIA-NN Export: Zeiten in Sekunden!": ("s", None), "rt in the AlphaDIA report = min  DIA-NN report gives rt as sec": ("s", "min"), "cycle time about 3 sec": (None, None), "DIA-NN report: RT [ms].": ("ms", None), "AlphaDIA Export: Dezimalstunden": (None, "h"), None: (None, None)}
    got = spark.createDataFrame([(n,) for n in notes], "n string").select("n", note_unit(F.col("n"), "diann"), note_unit(F.col("n"), "alphadia")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == notes
    stems = {"D:\\acq\\a.b.raw": "a.b", "/x/mix.lot3.run0005.mzML": "mix.lot3.run0005", "plain": "plain", None: None}
    assert {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in stems], "n string").select("n", run_stem(F.col("n"))).collect()} == stems


ROWS = "src_table string, psm_id bigint, run string, entity string, value double, stated string, noted string, own string"


def convert(spark, rows, runs):
    out = common_units(spark.createDataFrame(rows, ROWS), spark.createDataFrame(runs, "run string, gradient_min double"))
    return {(r["src_table"], r["psm_id"]): (r["unit"], None if r["rt_min"] is None else round(r["rt_min"], 4)) for r in out.collect()}


def test_order_of_evidence(spark):
    rows = [
        ("d", 1, "r", "P", 30.0, None, None, "min"), ("d", 2, "r", "P", 1800.0, None, None, "min"), ("d", 3, "r", "P", 0.5, None, None, "min"), ("d", 4, "r", "P", 30.0, None, "s", "min"), ("d", 5, "r", "P", 30.0, "h", "s", "min"),
        ("d", 6, None, "P", None, None, None, "min"), ("d", 7, "r", None, float("nan"), None, None, "min"), ("d", 8, "r", "P", 0.0, None, None, "min"),
    ]
    got = convert(spark, rows, [("r", 60.0), ("r", 60.0), ("q", None)])
    assert got["d", 1] == ("min", 30.0) and got["d", 2] == ("s", 30.0) and got["d", 3] == ("h", 30.0) and got["d", 4] == ("s", 0.5) and got["d", 5] == ("h", 1800.0)
    assert got["d", 6][1] is None and got["d", 7][1] is None and len(got) == 8


def test_unknown_gradient_is_linked_through_entities(spark):
    known = [("a", i, "r", f"P{i}", 10.0 + i, "min", None, "min") for i in range(20)]
    linked = [("b", i, "q", f"P{i}", (10.5 + i) * 60, None, None, "min") for i in range(20)]
    got = convert(spark, known + linked, [("r", 60.0), ("q", None)])
    assert all(got["b", i] == ("s", 10.5 + i) for i in range(20))


def test_empty(spark):
    assert convert(spark, [], []) == {}


def test_units_spread_along_a_chain_of_sources(spark):
    """Eight sources, each linked with the next alone, and only the first of known unit."""
    rows, k = [], 0
    for i in range(8):
        for e in range(20):
            for part in {i, i + 1} - {0}:
                true = 10.0 + 2 * e
                value = true if i == 0 else true * 60 * (1 + 0.01 * (i % 3))
                rows.append((f"s{i}", k, f"r{i}", f"P{part}.{e}", value, "min" if i == 0 else None, None, "min"))
                k += 1
    got = convert(spark, rows, [(f"r{i}", None) for i in range(8)])
    assert all(unit == ("min" if s == "s0" else "s") for (s, _), (unit, _) in got.items()) and len(got) == k


def test_scale_and_offset_between_sources(spark):
    """A clock in seconds that starts 300 minutes early: the ratio of the times says neither the unit nor the offset, their spread does."""
    known = [("a", i, "r", f"P{i}", 10.0 + i, "min", None, "min") for i in range(40)]
    late = [("b", i, "q", f"P{i}", (10.0 + i + 300.0) * 60, None, None, "min") for i in range(40)]
    rows, runs = spark.createDataFrame(known + late, ROWS), spark.createDataFrame([("r", None), ("q", None)], "run string, gradient_min double")
    links = source_links(rows.selectExpr("src_table as source", "entity", "value as time")).first()
    assert (links["a"], links["b"], links["n"]) == ("a", "b", 40) and abs(links["log_scale"] - math.log(60)) < 1e-6 and abs(links["shift"] - 18000) < 120
    got = {r["psm_id"]: (r["unit"], r["rt_min"]) for r in common_units(rows, runs, zeros=(0.0, -300.0, 300.0)).where("src_table = 'b'").collect()}
    assert all(u == "s" and abs(t - (10.0 + i)) < 1e-6 for i, (u, t) in got.items()) and len(got) == 40


def test_a_run_in_two_units(spark):
    known = [("a", i, "r", f"P{i}", 10.0 + i, "min", None, "min") for i in range(30)]
    mixed = [("b", i, "q", f"P{i}", (10.0 + i) * (60 if i % 5 else 1), None, None, "s") for i in range(30)]
    got = convert(spark, known + mixed, [("r", None), ("q", None)])
    assert all(got["b", i] == ("s" if i % 5 else "min", 10.0 + i) for i in range(30))


def test_a_peptide_of_many_sources_gives_few_links(spark):
    rows = [(f"s{i:03}", "hot", 10.0 + i % 7) for i in range(300)]
    links = source_links(spark.createDataFrame(rows, "source string, entity string, time double"))
    assert links.count() <= 600
