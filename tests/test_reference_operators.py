import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotwin.config import read_job
from isotwin.functions import chem
from isotwin.operators import traces
from isotwin.operators.matching import cycle_bounds, cycle_edges, matched_intensities, matched_intensity, ppm_join, window_of
from isotwin.operators.ordered import nearest, neighbour_ranks, parents, rank_within
from isotwin.schemas import FEATURE_COLUMNS
from isotwin.sources.mzml import read_mzml, scan_number
from isotwin.sources.sinks import staged, write_features


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_modifications(spark):
    lit = F.lit
    assert [tuple(m) for m in one(spark, chem.inline_mods(lit("(UniMod:1)AC(UniMod:4)DEM(UniMod:35)K")))] == [(0, 1), (2, 4), (5, 35)]
    assert [tuple(m) for m in one(spark, chem.listed_mods(lit("Oxidation@M;Acetyl@Protein_N-term"), lit("3;0")))] == [(2, 35), (-1, 1)]
    for mods, sites in (("", "1"), ("a@b", ""), ("Oxidation@M;Oxidation@M", "1"), (None, "1")):
        assert one(spark, chem.listed_mods(lit(mods).cast("string"), lit(sites))) == []


def test_masses(spark):
    assert one(spark, chem.heavy_mz(F.lit(500.0), F.lit(2), F.lit("ACK"))) == pytest.approx(504.007102)
    assert one(spark, chem.heavy_mz(F.lit(500.0), F.lit(2), F.lit("AKR"))) == pytest.approx(509.0112395)
    mods = F.array(F.struct(F.lit(2).alias("site"), F.lit(4).alias("unimod_id")))
    want = {"reference": [(71.03711, 71.03711), (174.0463, 174.0463), (203.12699, 211.14119), (306.13618, 314.15038)], "corrected": [(71.03711, 71.03711), (231.06776, 231.06776), (146.10552, 154.11973), (306.13618, 314.15038)]}
    for mode, masses in want.items():
        got = one(spark, chem.fragments(F.lit("ACK"), mods, site_mode=mode))
        assert [(g["light"], g["heavy"]) for g in got] == [pytest.approx(m, abs=2e-5) for m in masses]
    assert one(spark, chem.fragments(F.lit("K"), mods)) == []
    assert one(spark, chem.ion_mz(F.lit(146.1055247), F.lit(1))) == pytest.approx(147.112801) and one(spark, chem.ion_mz(F.lit(146.1055247), F.lit(2))) == pytest.approx(74.060039)


def test_windows_and_peaks(spark):
    edges = F.array(*[F.struct(F.lit(x).alias("lower"), F.lit(n).alias("n")) for x, n in ((400.0, 1), (410.0, 1), (420.0, 2))])
    assert [one(spark, window_of(edges, F.lit(v))) for v in (399.0, 400.0, 400.5, 410.0, 410.1, 421.0)] == [0, 0, 1, 1, 2, 4]
    mz, intensity = F.array(*map(F.lit, (499.99, 499.996, 500.0, 500.004, 500.02))), F.array(*map(F.lit, (1.0, 2.0, 4.0, 8.0, 16.0)))
    assert one(spark, matched_intensity(mz, intensity, F.lit(500.0), 10.0)) == 14.0
    assert one(spark, matched_intensity(mz, intensity, F.lit(600.0), 10.0)) == 0.0


def test_ppm_join_is_the_theta_join(spark):
    rng = np.random.default_rng(1)
    theory = rng.uniform(100, 2000, 300)
    near = np.concatenate([theory * (1 + d * 1e-6) for d in (-10.0, -9.999999, 0, 9.999999, 10.000001)])
    peaks = np.concatenate([near, rng.uniform(100, 2000, 500)])
    got = ppm_join(spark.createDataFrame([(i, float(t)) for i, t in enumerate(theory)], "probe_id bigint, theory double"), spark.createDataFrame([(float(p), 1.0) for p in peaks] + [(None, 1.0), (-1.0, 1.0)], "mz double, intensity double"), 10.0)
    want = [int((np.abs((peaks - t) / t * 1e6) <= 10).sum()) for t in theory]
    assert [r["n"] for r in got.orderBy("probe_id").collect()] == want


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    points = [("a", i, float(t)) for i, t in enumerate(np.sort(rng.integers(0, 60, 40)))] + [("b", 0, 5.0), (None, 0, 1.0), ("a", 99, None)]
    probes = [("a", i, float(t)) for i, t in enumerate(rng.integers(-20, 90, 80) / 2)] + [("b", 100, 1e6), ("c", 101, 1.0), ("a", 102, None)]
    p, q = spark.createDataFrame(points, "k string, rank bigint, time double"), spark.createDataFrame(probes, "k string, probe_id bigint, time double")
    times = np.array([t for k, _, t in points if k == "a" and t is not None])
    want = {}
    for k, i, t in probes[:80]:
        at = int(np.searchsorted(times, t))
        want[i] = 0 if at == 0 else len(times) - 1 if at == len(times) else at - 1 if t - times[at - 1] <= times[at] - t else at
    want[100] = 0
    for chunk in (1.0, 7.0, 1000.0):
        assert {r["probe_id"]: r["rank"] for r in nearest(q, p, ["k"], chunk).collect()} == want
    forward = {i: int(np.searchsorted(times, t)) for k, i, t in probes[:80] if t <= times.max()}
    assert {r["probe_id"]: r["rank"] for r in nearest(q, p, ["k"], 7.0, mode="forward").collect()} == forward


def test_ranks_neighbours_parents(spark):
    df = spark.createDataFrame([("a", i * 3) for i in range(50)] + [("b", 7), (None, 1), (None, 9)], "k string, i int")
    for chunk in (5, 1000):
        got = {(r["k"], r["i"]): r["rank"] for r in rank_within(df, ["k"], "i", chunk).collect()}
        assert got == {**{("a", i * 3): i for i in range(50)}, ("b", 7): 0, (None, 1): 0, (None, 9): 1}
    assert one(spark, neighbour_ranks(F.lit(1).cast("bigint"), 3)) == [0, 1, 2, 3, 4]
    scans = spark.createDataFrame([("a", 0, 10, -1), ("a", 1, 11, 10), ("a", 2, 12, 99)], "k string, idx int, scan bigint, parent bigint")
    assert [r["parent_index"] for r in parents(scans, scans, ["k"], "parent", "scan", "idx").orderBy("idx").collect()] == [0, 0, 0]


def test_scores_and_summaries(spark):
    def arr(xs):
        return F.array(*map(F.lit, xs)).cast("array<double>")

    score = lambda a, x, b, y: one(spark, traces.trace_score(arr(a), arr(x), arr(b), arr(y)))
    assert score([1, 2, 3], [1, 1, 1], [1, 2, 3], [1, 2, 3]) == 0 and score([1, 2], [1, 2], [5, 6], [1, 2]) == 0 and score([1], [1], [1], [2]) == 0 and score([], [], [1], [1]) == 0
    a, x, b, y = [1.0, 2, 3, 4], [1.0, 5, 2, 0], [1.5, 2.5, 4.5], [0.0, 4, 1]
    grid = np.linspace(1.5, 4.0, 100)
    assert score(a, x, b, y) == pytest.approx(np.corrcoef(np.interp(grid, a, x), np.interp(grid, b, y))[0, 1])
    df = spark.createDataFrame([(1, v) for v in (-0.4, 0.0, 0.5, 1.0, float("nan"))] + [(2, None)], "g int, v double")
    got = {r["g"]: tuple(r)[1:] for r in df.groupBy("g").agg(*traces.summary(F.col("v"), "v")).collect()}
    assert got[1] == pytest.approx((4, 0.0, 0.25, 0.625, 0.275)) and got[2] == (0, 0, 0, 0, 0)
    first = spark.createDataFrame([(1, 5.0, 10.0), (2, 9.0, 20.0), (3, 9.0, 30.0)], "i int, v double, t double")
    assert first.agg(traces.apex("t", "v", "i")).first()[0] == 20.0


def test_cycle(spark):
    rows = [("a", 0, -1, None), ("a", 1, 1, 400.0), ("a", 2, 1, 410.0), ("a", 3, -1, None), ("a", 4, 2, 400.0), ("b", 0, -1, None), ("b", 1, 1, 7.0), ("c", 0, 5, 1.0)]
    # A run with one MS1: its cycle lasts to the end, its windows come again and again, and a spectrum is stored twice.
    rows += [("d", 0, -1, None)] + [("d", i + 1, 1, 500.0 - 10 * (i % 3)) for i in range(5000)] + [("d", 2, 1, 490.0)]
    spectra = spark.createDataFrame(rows, "raw_title string, spec_idx int, precursor_scan_id bigint, iso_lower float")
    got = {k: [x["lower"] for x in cycle_bounds(spectra).where(F.col("raw_title") == k).orderBy("place").collect()] for k in "abcd"}
    assert got == {"a": [400.0, 410.0], "b": [7.0], "c": [], "d": [500.0 - 10 * (i % 3) for i in range(5000)]}
    edges = {r["raw_title"]: [tuple(e) for e in r["edges"]] for r in cycle_edges(spectra).collect()}
    assert edges == {"a": [(400.0, 1), (410.0, 1)], "b": [(7.0, 1)], "d": [(480.0, 1666), (490.0, 1667), (500.0, 1667)]}


def test_peaks_of_many_targets(spark, monkeypatch):
    """Against brute force: a spectrum with most of the targets, stored twice, peaks out of order, nulls, no peaks, no spectrum."""
    from isotwin.operators import matching

    monkeypatch.setattr(matching, "HOT_TARGETS", 500)
    rng = np.random.default_rng(7)
    spectra = {("a", i): (rng.permutation(np.round(rng.uniform(400, 401, 40), 3)).tolist(), rng.uniform(1, 9, 40).tolist()) for i in range(6)}
    spectra["a", 4] = ([], [])
    spectra["b", 0] = ([400.5, 400.5, 400.7], [1.0, None, 2.0])
    rows = [(r, i, m, n) for (r, i), (m, n) in spectra.items()]
    asked = [(k, "a" if k % 5 else "b", 2 if k % 3 else k % 8, None if k % 97 == 0 else [None if k % 7 == 0 else float(x) for x in np.round(rng.uniform(400, 401, 3), 3)]) for k in range(6000)]
    targets = spark.createDataFrame(asked, "id bigint, run string, idx int, masses array<double>")
    got = matching.matched_intensities(targets, spark.createDataFrame(rows + rows[:3], "run string, idx int, mz array<double>, intensity array<double>"), ["run", "idx"], 10.0)
    assert got.columns == ["id", "run", "idx", "found", "total"]
    got = {r["id"]: (r["found"], r["total"]) for r in got.collect()}
    want = {k: (m, spectra[run, idx]) for k, run, idx, m in asked if (run, idx) in spectra}
    assert set(got) == set(want) and len(want) < len(asked)
    for k, (masses, (mz, intensity)) in want.items():
        intensity = np.array([x or 0.0 for x in intensity])
        near = lambda m: 0.0 if m is None or not len(mz) else float(intensity[np.abs((np.array(mz) - m) / m * 1e6) <= 10].sum())
        assert np.allclose(got[k][0], [near(m) for m in masses or []]) and abs(got[k][1] - intensity.sum()) < 1e-9
    far = matching.matched_intensities(targets.withColumn("masses", F.transform("masses", lambda m: m + 900)), spark.createDataFrame(rows, "run string, idx int, mz array<double>, intensity array<double>"), ["run", "idx"], 10.0)
    assert far.where(F.exists("found", lambda x: x != 0)).count() == 0 and far.count() == len(want)
    none = targets.limit(0)
    assert matched_intensities(none, spark.createDataFrame(rows, "run string, idx int, mz array<double>, intensity array<double>"), ["run", "idx"], 10.0).count() == 0


def mzml(path, spectra):
    def params(**kv):
        return "".join(f'<cvParam name="{k.replace("_", " ")}" value="{v}"/>' for k, v in kv.items())

    def data(name, xs, wide, packed):
        raw = np.array(xs, "<f8" if wide else "<f4").tobytes()
        text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        return f'<binaryDataArray><cvParam name="{name}" value=""/><cvParam name="{"64-bit float" if wide else "32-bit float"}" value=""/><cvParam name="{"zlib compression" if packed else "no compression"}" value=""/><binary>{text}</binary></binaryDataArray>'

    out = ["<mzML><run><spectrumList>"]
    for i, (rt, pre, mz, inten) in enumerate(spectra):
        body = f'<scanList><scan><cvParam name="scan start time" value="{rt}"/></scan></scanList>' if rt is not None else ""
        if pre:
            ref, m, lo, up = pre
            body += f'<precursorList><precursor spectrumRef="scan={ref}"><isolationWindow><cvParam name="isolation window lower offset" value="{lo}"/><cvParam name="isolation window upper offset" value="{up}"/></isolationWindow><selectedIonList><selectedIon><cvParam name="selected ion m/z" value="{m}"/></selectedIon></selectedIonList></precursor></precursorList>'
        out.append(f'<spectrum index="{i}" id="controller=0 scan={i + 1}"><cvParam name="ms level" value="{2 if pre else 1}"/>{body}<binaryDataArrayList>{data("m/z array", mz, i % 2, i % 3 == 0)}{data("intensity array", inten, False, i % 2)}</binaryDataArrayList></spectrum>')
    path.write_text("".join(out) + "</spectrumList></run></mzML>")


def test_mzml(spark, tmp_path):
    mzml(tmp_path / "run.a.mzML", [(1.5, None, [100.0, 200.5], [1.0, 2.0]), (None, (1, 410.0, 10.0, 12.5), [50.25], [3.0]), (1.7, (1, 430.0, 10, 10), [], [])])
    got = read_mzml(spark, str(tmp_path / "run.a.mzML")).orderBy("spec_idx").collect()
    assert [(r["raw_title"], r["spec_idx"], r["scan_id"], r["precursor_scan_id"], r["rt"], r["iso_lower"], r["iso_upper"], r["mz"], r["intensity"]) for r in got] == [
        ("run.a", 0, 1, -1, 1.5, None, None, [100.0, 200.5], [1.0, 2.0]), ("run.a", 1, 2, 1, 0.0, 400.0, 422.5, [50.25], [3.0]), ("run.a", 2, 3, 1, pytest.approx(1.7), 420.0, 440.0, [], []),
    ]
    with pytest.raises(Exception, match="no scan number"):
        one(spark, scan_number(F.lit("foo")))


def test_sinks_and_config(spark, tmp_path):
    row = {c: 0.5 for c in FEATURE_COLUMNS} | {"label": True, "sequence": "ACK"}
    df = spark.createDataFrame([tuple(row[c] for c in FEATURE_COLUMNS)], FEATURE_COLUMNS)
    write_features(df, str(tmp_path / "out"), single_file=True)
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0] == ",".join(FEATURE_COLUMNS) and ",True," in text[1]
    write_features(df.where("false"), str(tmp_path / "none"), single_file=True)
    assert next((tmp_path / "none").glob("*.csv")).read_text().strip() == ",".join(FEATURE_COLUMNS)
    assert staged(spark, spark.range(3), str(tmp_path / "stage")).count() == 3
    assert staged(spark, spark.range(9), str(tmp_path / "stage")).count() == 9
    assert staged(spark, spark.range(2), str(tmp_path / "stage"), reuse=True).count() == 9
    assert staged(spark, spark.range(2).selectExpr("id as other"), str(tmp_path / "stage"), reuse=True).count() == 2
    assert staged(spark, spark.range(4), str(tmp_path / "fresh"), reuse=True).count() == 4
    (tmp_path / "c.ini").write_text("[input]\nraw_num = 1\nraw_path_1 = a.mzML\nlight_result_file = r.parquet\n[general]\nmass_tol_ppm = 10\n")
    job = read_job(str(tmp_path / "c.ini"))
    assert (job.raw_paths, job.engine, job.half_width, job.result) == (["a.mzML"], 1, 3, "result.csv")
    with pytest.raises(FileNotFoundError):
        read_job(str(tmp_path / "absent.ini"))
