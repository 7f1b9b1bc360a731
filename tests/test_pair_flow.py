"""The whole run against an independent NumPy calculation on a small planted data set."""

import numpy as np
import pytest

from isotwin.functions import chem
from isotwin.plans.pair_flow import pair_features
from isotwin.schemas import FEATURE_COLUMNS, PSM, SPECTRUM

TOL, K = 10.0, 2
BOUNDS = [400.0, 450.0, 500.0, 550.0]


def ions(seq, mods):
    mass = [chem.RESIDUES[r][0] for r in seq]
    up = [{"K": chem.SILAC_K, "R": chem.SILAC_R}.get(r, 0.0) for r in seq]
    mod = lambda end: sum(chem.MODIFICATIONS[u] for s, u in mods if s <= end)
    n = len(seq)
    b = [("b", sum(mass[:i]) + mod(i - 1), sum(up[:i])) for i in range(1, n)]
    y = [("y", sum(mass[n - i :]) + chem.WATER + mod(n) - mod(n - i - 1), sum(up[n - i :])) for i in range(1, n)]
    return [(t, m, m + u) for t, m, u in b + y]


def make(rng):
    psms, spectra = [], []
    for i, (seq, z, mods) in enumerate([("ACDEK", 1, []), ("GAVLR", 1, [(2, 35)]), ("PEPTK", 1, []), ("SSSSR", 1, []), ("AXK", 1, []), ("MMGK", 1, [])]):
        m = sum(chem.RESIDUES.get(r, (0,))[0] for r in seq) + chem.WATER
        psms.append((i, "run", seq, z, float(m + chem.PROTON) if i != 3 else None, 1.0 + 0.4 * i if i != 5 else None, mods, "P_HUMAN" if i % 2 else "Q_MOUSE"))
    psms.append((9, "other", "ACDEK", 1, 500.0, 1.0, [], None))
    idx = scan = 0
    for cycle in range(12):
        rt = 0.5 + 0.25 * cycle
        parent = scan + 1
        for w in (None, *BOUNDS):
            mz, inten = [], []
            for p in psms[:6]:
                if p[4] is None or p[5] is None or "X" in p[2]:
                    continue
                shape = np.exp(-((rt - p[5]) ** 2) / 0.2)
                heavy = p[4] + sum({"K": chem.SILAC_K, "R": chem.SILAC_R}.get(r, 0) for r in p[2])
                if w is None:
                    mz += [p[4] * (1 + 3e-6), heavy]
                    inten += [100 * shape + rng.random(), 80 * shape + rng.random()]
                else:
                    for t, a, b in ions(p[2], p[6]):
                        for c in (1, 2):
                            mz += [(a + c * chem.PROTON) / c, (b + c * chem.PROTON) / c]
                            inten += [10 * shape + rng.random(), 9 * shape + rng.random()]
            scan += 1
            lo, up = (None, None) if w is None else (w, w + 50)
            spectra.append(("run", idx, scan, -1 if w is None else parent, rt + 0.01 * (idx % 5), lo, up, [float(np.float32(x)) for x in mz], [float(np.float32(x)) for x in inten]))
            idx += 1
    return psms, spectra


def oracle(psms, spectra):
    f32 = np.float32
    win = lambda v: int(np.searchsorted(BOUNDS, v))
    ms1 = [s for s in spectra if s[3] == -1]
    ms2 = {}
    for s in spectra:
        if s[3] != -1:
            ms2.setdefault(win((s[5] + s[6]) / 2), []).append(s)

    def around(group, rt):
        if not group or rt is None:
            return []
        t = [float(f32(s[4])) for s in group]
        at = int(np.searchsorted(t, rt))
        mid = 0 if at == 0 else len(t) - 1 if at == len(t) else at - 1 if rt - t[at - 1] <= t[at] - rt else at
        return group[max(0, mid - K) : mid + K + 1]

    def match(s, theo):
        mz, i = np.array(s[7]), np.array(s[8])
        return float(i[np.abs((mz - theo) / theo * 1e6) <= TOL].sum()) if len(mz) else 0.0

    def score(a, b):
        if not a or not b:
            return 0.0
        (ta, xa), (tb, xb) = zip(*a), zip(*b)
        g = np.linspace(max(ta[0], tb[0]), min(ta[-1], tb[-1]), 100)
        u, v = np.interp(g, ta, xa), np.interp(g, tb, xb)
        return 0.0 if np.ptp(u) == 0 or np.ptp(v) == 0 else float(np.corrcoef(u, v)[0, 1])

    out = {}
    for pid, run, seq, z, mz, rt, mods, names in psms:
        if run != "run" or "X" in seq:
            continue
        shift = sum({"K": chem.SILAC_K, "R": chem.SILAC_R}.get(r, 0) for r in seq)
        heavy = None if mz is None else (mz * z + shift) / z
        xic = lambda group, m: [(float(f32(s[4])), m(s)) for s in group]
        near = around(ms1, rt)
        pp = score(xic(near, lambda s: match(s, mz)), xic(near, lambda s: match(s, heavy))) if mz is not None else 0.0
        by, num, den = {"b": [], "y": []}, 0.0, 1.0
        for t, a, b in ions(seq, mods):
            if abs(b - a) < 0.01 and (mz is None or win(mz) == win(heavy)):
                continue
            traces, totals = [], []
            for m, p in ((a, mz), (b, heavy)):
                group = [] if p is None else [s for s in around(ms2.get(win(p), []), rt) if s[5] <= p <= s[6]]
                traces.append(xic(group, lambda s: sum(match(s, (m + c * chem.PROTON) / c) for c in (1, 2))))
                totals.append(sum(sum(s[8]) for s in group))
            by[t].append(score(*traces))
            if traces[0] and traces[1] and max(x for _, x in traces[0]) > 0 and max(x for _, x in traces[1]) > 0:
                num += sum(x for _, x in traces[0] + traces[1])
                den = sum(totals)
        row = [seq, z, mz, run, names, len(seq), names and "human" in names.lower(), pp, len(by["b"]) + len(by["y"])]
        for v in (by["b"], by["y"], by["b"] + by["y"]):
            row += [len(v), *np.clip(np.percentile(v, [25, 50, 75]), 0, 1), np.mean(v)] if v else [0] * 5
        out[pid] = [*row, num / den]
    return out


def test_against_numpy(spark):
    psms, spectra = make(np.random.default_rng(3))
    p, s = spark.createDataFrame(psms, PSM), spark.createDataFrame(spectra + spectra[:7], SPECTRUM)
    got = {r["psm_id"]: [r[c] for c in FEATURE_COLUMNS] for r in pair_features(p, s, TOL, K).collect()}
    want = oracle(psms, spectra)
    assert set(got) == set(want)
    for k in want:
        assert got[k][:7] == want[k][:7]
        assert got[k][7:] == pytest.approx(want[k][7:], abs=1e-6), k
    assert max(got[k][7] for k in got) > 0.9 and max(got[k][-1] for k in got) > 0


def test_empty(spark):
    assert pair_features(spark.createDataFrame([], PSM), spark.createDataFrame([], SPECTRUM)).count() == 0


def test_command_line_from_files(spark, tmp_path):
    from test_reference_operators import mzml

    from isotwin import cli

    psms, spectra = make(np.random.default_rng(3))
    mzml(tmp_path / "run.mzML", [(s[4], None if s[3] == -1 else (s[3], s[5] + 25, 25, 25), s[7], s[8]) for s in spectra])
    names = ["Run.Index", "Run", "Channel", "Precursor.Id", "Modified.Sequence", "Stripped.Sequence", "Precursor.Charge", "Decoy", "Q.Value", "RT", "Precursor.Mz", "Genes", "Protein.Group", "Protein.Names", "psm_id"]
    rows = [(0, run, "c", "p", seq, seq, z, 0, 0.1, rt, mz, "g", "pg", prot, i) for i, run, seq, z, mz, rt, _, prot in psms]
    kinds = ["bigint", "string", "string", "string", "string", "string", "bigint", "bigint", "double", "double", "double", "string", "string", "string", "bigint"]
    spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))).write.parquet(str(tmp_path / "report.parquet"))
    (tmp_path / "job.ini").write_text(f"[input]\nraw_num = 1\nraw_path_1 = {tmp_path}/run.mzML\nlight_result_file = {tmp_path}/report.parquet\nsearch_engine_type = 1\n[general]\nmass_tol_ppm = {TOL}\nxic_cycle_window = {K}\nresult_file = {tmp_path}/out\n")
    cli.main(["--configpath", str(tmp_path / "job.ini"), "--logpath", str(tmp_path / "log")])
    got = {r["sequence"]: r for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()}
    want = {v[0]: v for v in oracle([(i, run, seq, z, mz, rt, [], prot) for i, run, seq, z, mz, rt, _, prot in psms], spectra).values()}
    assert set(got) == set(want)
    for seq, v in want.items():
        assert float(got[seq]["precursor_pearson"]) == pytest.approx(v[7], abs=1e-4) and float(got[seq]["all_mean"]) == pytest.approx(v[23], abs=1e-4)
        assert got[seq]["label"] == str(v[6])


def test_reports_that_arrive(spark, tmp_path):
    from isotwin.streaming.arrivals import stream_psms

    def report(i, seq):
        row = (i, "a.raw", "Oxidation@M", "2", 120.0, seq, 2, 500.0, "G")
        return spark.createDataFrame([row], "psm_id bigint, `raw.name` string, `precursor.mods` string, `precursor.mod_sites` string, `precursor.rt.observed` double, `precursor.sequence` string, `precursor.charge` bigint, `precursor.mz.observed` double, `pg.genes` string")

    folder = str(tmp_path / "in")
    report(1, "AMK").write.mode("append").parquet(folder)
    query = stream_psms(spark, folder, report(1, "AMK").schema, engine=2).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    report(2, "AXK").write.mode("append").parquet(folder)
    report(3, "MMK").write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    assert [(r["psm_id"], r["rt"], r["mods"][0]["site"]) for r in spark.table("arrived").orderBy("psm_id").collect()] == [(1, 2.0, 1), (3, 2.0, 1)]
