"""One query per operator over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isotwin.functions import chem
from isotwin.functions.times import run_stem
from isotwin.operators import traces
from isotwin.operators.matching import cycle_bounds, cycle_edges, cycle_range, fragment_range, matched_intensities, matched_intensity, ppm_join, window_of
from isotwin.operators.ordered import nearest, neighbour_ranks, parents, rank_within
from isotwin.plans.pair_flow import CHUNK_MINUTES, CHUNK_ROWS, pair_features
from isotwin.session import col, cut, read_table, small_side
from isotwin.sources.mzml import scan_number
from isotwin.sources.reports import named_report, positional_report, spectra_frame, valid_psms

#: SQL of a report's run.
_STEM = r"""regexp_replace(regexp_replace(trim("Run"), '^.*[/\\]', ''), '\.(raw|mzML)$', '')"""
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: SQL of a peptide's residues and masses.
_RESIDUES = ", ".join(f"('{r}', CAST({m} AS DOUBLE), {c}, {n})" for r, (m, c, n) in chem.RESIDUES.items())
_MODS = ", ".join(f"({k}, CAST({v} AS DOUBLE))" for k, v in chem.MODIFICATIONS.items())
_NAMES = ", ".join(f"('{k}', {v})" for k, v in chem.MOD_IDS.items())


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- sources ----------------------------------------------------------------------------------------


@query("""SELECT psm_id, "Run" AS raw_title, "Stripped.Sequence" AS sequence, CAST("Precursor.Charge" AS INT) AS charge, CAST("Precursor.Mz" AS DOUBLE) AS precursor_mz,
          round(CAST("RT" AS DOUBLE), 4) AS rt, "Protein.Names" AS protein_names FROM diann_report""")
def scan_positional(spark: SparkSession, d: str) -> DataFrame:
    return positional_report(read_table(spark, d, "diann_report")).drop("mods").withColumn("rt", F.round("rt", 4))


@query("""SELECT psm_id, "raw.name" AS raw_title, "precursor.sequence" AS sequence, CAST("precursor.charge" AS INT) AS charge, CAST("precursor.mz.observed" AS DOUBLE) AS precursor_mz,
          round("precursor.rt.observed" / 60, 6) AS rt, "pg.genes" AS protein_names FROM alphadia_report""")
def scan_named(spark: SparkSession, d: str) -> DataFrame:
    return named_report(read_table(spark, d, "alphadia_report")).drop("mods").withColumn("rt", F.round("rt", 6))


@query("SELECT psm_id, round(\"precursor.rt.observed\" / 60, 6) AS rt_min FROM alphadia_report")
def rt_minutes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "alphadia_report").select("psm_id", F.round(col("precursor.rt.observed") / 60, 6).alias("rt_min"))


@query("SELECT event_id, CAST(regexp_extract('controllerNumber=1 scan=' || event_id, 'scan=([0-9]+)', 1) AS INT) AS scan FROM events")
def scan_numbers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", scan_number(F.concat(F.lit("controllerNumber=1 scan="), F.col("event_id").cast("string"))).alias("scan"))


@query(r"""SELECT psm_id, regexp_replace(regexp_replace("Run", '^.*[/\\]', ''), '\.(raw|mzML)$', '') AS stem FROM diann_report""")
def file_stem(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "diann_report").select("psm_id", run_stem(F.col("Run")).alias("stem"))


@query("SELECT psm_id, \"Stripped.Sequence\" AS sequence FROM diann_report WHERE NOT contains(\"Stripped.Sequence\", 'X')")
def valid_filter(spark: SparkSession, d: str) -> DataFrame:
    return valid_psms(positional_report(read_table(spark, d, "diann_report"))).select("psm_id", "sequence")


@query("SELECT psm_id FROM diann_report WHERE \"Run\" = 'QCREF_pool_std_A'")
def run_filter(spark: SparkSession, d: str) -> DataFrame:
    return positional_report(read_table(spark, d, "diann_report")).where("raw_title = 'QCREF_pool_std_A'").select("psm_id")


@query("SELECT psm_id, contains(lower(\"Protein.Names\"), 'human') AS label, length(\"Stripped.Sequence\") AS sequence_len FROM diann_report")
def label_flag(spark: SparkSession, d: str) -> DataFrame:
    psms = positional_report(read_table(spark, d, "diann_report"))
    return psms.select("psm_id", F.lower("protein_names").contains("human").alias("label"), F.length("sequence").alias("sequence_len"))


@query("""SELECT 'w1' AS part, psm_id, "Run" AS run FROM report_w1 UNION ALL SELECT 'w2', psm_id, "Run" FROM report_w2 UNION ALL SELECT 'w3', psm_id, run FROM report_w3 UNION ALL SELECT 'w4', psm_id, "raw.name" FROM report_w4""")
def concat_runs(spark: SparkSession, d: str) -> DataFrame:
    names = {"w1": "Run", "w2": "Run", "w3": "run", "w4": "raw.name"}
    return reduce(DataFrame.unionByName, [read_table(spark, d, f"report_{w}").select(F.lit(w).alias("part"), "psm_id", col(run).alias("run")) for w, run in names.items()])


@query("SELECT count(*) AS n_psms, count(DISTINCT \"Run\") AS n_runs, max(length(\"Stripped.Sequence\")) AS longest FROM diann_report")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return positional_report(read_table(spark, d, "diann_report")).agg(F.count("*").alias("n_psms"), F.countDistinct("raw_title").alias("n_runs"), F.max(F.length("sequence")).alias("longest"))


# --- chemistry --------------------------------------------------------------------------------------


@query(r"""WITH m AS (SELECT psm_id, "Modified.Sequence" AS s, string_split_regex("Modified.Sequence", '\([^)]*\)') AS parts, regexp_extract_all("Modified.Sequence", '\(([^)]*)\)', 1) AS marks FROM diann_report),
               x AS (SELECT psm_id, parts, marks, unnest(range(len(marks))) AS i FROM m)
          SELECT psm_id, CAST(i AS INT) AS place, CAST(length(array_to_string(parts[1:i + 1], '')) AS INT) AS site, TRY_CAST(regexp_extract(marks[i + 1], 'UniMod:([0-9]+)', 1) AS INT) AS unimod_id FROM x""")
def mods_inline(spark: SparkSession, d: str) -> DataFrame:
    return positional_report(read_table(spark, d, "diann_report")).select("psm_id", F.posexplode("mods").alias("place", "m")).select("psm_id", "place", "m.*")


@query(f"""WITH m AS (SELECT psm_id, string_split("precursor.mods", ';') AS n, string_split("precursor.mod_sites", ';') AS s FROM alphadia_report WHERE "precursor.mods" <> '' AND "precursor.mod_sites" <> ''),
                x AS (SELECT psm_id, n, s, unnest(range(len(n))) AS i FROM m WHERE len(n) = len(s)), names(name, id) AS (VALUES {_NAMES})
           SELECT psm_id, CAST(i AS INT) AS place, CAST(TRY_CAST(trim(s[i + 1]) AS INT) - 1 AS INT) AS site, names.id AS unimod_id
           FROM x LEFT JOIN names ON names.name = regexp_extract(trim(n[i + 1]), '^([^@]*)', 1)""")
def mods_listed(spark: SparkSession, d: str) -> DataFrame:
    return named_report(read_table(spark, d, "alphadia_report")).select("psm_id", F.posexplode("mods").alias("place", "m")).select("psm_id", "place", "m.*")


@query(rf"""WITH m AS (SELECT psm_id, string_split_regex("Modified.Sequence", '\([^)]*\)') AS parts, regexp_extract_all("Modified.Sequence", '\(([^)]*)\)', 1) AS marks FROM diann_report WHERE "Modified.Sequence" IS NOT NULL),
                x AS (SELECT psm_id, parts, marks, unnest(range(len(marks))) AS i FROM m), masses(id, mass) AS (VALUES {_MODS}),
                y AS (SELECT psm_id, mass FROM x JOIN masses ON masses.id = TRY_CAST(regexp_extract(marks[i + 1], 'UniMod:([0-9]+)', 1) AS INT) WHERE length(array_to_string(parts[1:i + 1], '')) <= 4)
           SELECT psm_id, round(coalesce(sum(mass), 0.0), 5) AS mass FROM m LEFT JOIN y USING (psm_id) GROUP BY psm_id""")
def mod_prefix_mass(spark: SparkSession, d: str) -> DataFrame:
    return positional_report(read_table(spark, d, "diann_report")).where("mods is not null").select("psm_id", F.round(chem.mod_mass(F.col("mods"), F.lit(4)), 5).alias("mass"))


@query(f"""SELECT psm_id, round(k * CAST({chem.SILAC_K} AS DOUBLE) + r * CAST({chem.SILAC_R} AS DOUBLE), 6) AS shift, round((mz * z + k * {chem.SILAC_K} + r * {chem.SILAC_R}) / z, 5) AS heavy_mz
           FROM (SELECT psm_id, CAST("Precursor.Mz" AS DOUBLE) AS mz, "Precursor.Charge" AS z, length(s) - length(replace(s, 'K', '')) AS k, length(s) - length(replace(s, 'R', '')) AS r FROM (SELECT *, "Stripped.Sequence" AS s FROM diann_report))""")
def heavy_masses(spark: SparkSession, d: str) -> DataFrame:
    psms = positional_report(read_table(spark, d, "diann_report"))
    return psms.select("psm_id", F.round(chem.heavy_shift(F.col("sequence")), 6).alias("shift"), F.round(chem.heavy_mz(F.col("precursor_mz"), F.col("charge"), F.col("sequence")), 5).alias("heavy_mz"))


@query(f"""WITH t(r, mass, c, n) AS (VALUES {_RESIDUES}), l AS (SELECT psm_id, unnest(string_split("Stripped.Sequence", '')) AS r FROM diann_report)
           SELECT psm_id, round(coalesce(sum(c), 0) * CAST({chem.HEAVY_C} AS DOUBLE), 5) AS c_shift, round(coalesce(sum(n), 0) * CAST({chem.HEAVY_N} AS DOUBLE), 5) AS n_shift FROM l LEFT JOIN t USING (r) GROUP BY psm_id""")
def cn_heavy_shift(spark: SparkSession, d: str) -> DataFrame:
    psms = positional_report(read_table(spark, d, "diann_report")).where("sequence is not null")
    return psms.select("psm_id", *[F.round(chem.heavy_shift(F.col("sequence"), x), 5).alias(f"{x[0].lower()}_shift") for x in ("CHEAVY", "NHEAVY")])


@query(f"""WITH t(r, mass, c, n) AS (VALUES {_RESIDUES}), l AS (SELECT psm_id, unnest(string_split("Stripped.Sequence", '')) AS r FROM diann_report),
                u AS (SELECT psm_id, coalesce(sum(c), 0) * CAST({chem.HEAVY_C} AS DOUBLE) AS c, coalesce(sum(n), 0) * CAST({chem.HEAVY_N} AS DOUBLE) AS n FROM l LEFT JOIN t USING (r) GROUP BY psm_id)
           SELECT psm_id, round((CAST("Precursor.Mz" AS DOUBLE) * "Precursor.Charge" + u.c) / "Precursor.Charge", 4) AS c_mz, round((CAST("Precursor.Mz" AS DOUBLE) * "Precursor.Charge" + u.n) / "Precursor.Charge", 4) AS n_mz FROM diann_report JOIN u USING (psm_id) WHERE "Precursor.Mz" IS NOT NULL""")
def cn_heavy_mz(spark: SparkSession, d: str) -> DataFrame:
    psms = positional_report(read_table(spark, d, "diann_report")).where("sequence is not null and precursor_mz is not null")
    heavy = lambda label: F.round(chem.heavy_mz(F.col("precursor_mz"), F.col("charge"), F.col("sequence"), label), 4)
    return psms.select("psm_id", heavy("CHEAVY").alias("c_mz"), heavy("NHEAVY").alias("n_mz"))


_IONS = f"""WITH t(r, mass, c, n) AS (VALUES {_RESIDUES}), p AS (SELECT DISTINCT "Stripped.Sequence" AS sequence FROM diann_report WHERE NOT contains("Stripped.Sequence", 'X') AND length("Stripped.Sequence") >= 2),
    l AS (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS i FROM p), m AS (SELECT sequence, i, mass, CAST(CASE substr(sequence, i, 1) WHEN 'K' THEN {chem.SILAC_K} WHEN 'R' THEN {chem.SILAC_R} ELSE 0 END AS DOUBLE) AS up FROM l JOIN t ON t.r = substr(sequence, i, 1)),
    w AS (SELECT sequence, i, length(sequence) AS n, sum(mass) OVER b AS bm, sum(up) OVER b AS bu, sum(mass) OVER y AS ym, sum(up) OVER y AS yu FROM m
          WINDOW b AS (PARTITION BY sequence ORDER BY i), y AS (PARTITION BY sequence ORDER BY i DESC)),
    ions AS (SELECT sequence, 'b' AS ion_type, CAST(i AS INT) AS ion_num, bm AS light, bm + bu AS heavy FROM w WHERE i < n
             UNION ALL SELECT sequence, 'y', CAST(n - i + 1 AS INT), ym + CAST({chem.WATER} AS DOUBLE), ym + CAST({chem.WATER} AS DOUBLE) + yu FROM w WHERE i > 1)"""


def _ions(spark: SparkSession, d: str) -> DataFrame:
    peptides = valid_psms(positional_report(read_table(spark, d, "diann_report"))).select("sequence").distinct()
    none = F.array().cast("array<struct<site:int,unimod_id:int>>")
    return peptides.select("sequence", F.explode(chem.fragments(F.col("sequence"), none)).alias("f")).select("sequence", "f.*")


@query(_IONS + " SELECT sequence, ion_type, ion_num, round(light, 6) AS light, round(heavy, 6) AS heavy FROM ions")
def prefix_suffix_sums(spark: SparkSession, d: str) -> DataFrame:
    return _ions(spark, d).withColumns({"light": F.round("light", 6), "heavy": F.round("heavy", 6)})


@query(_IONS + " SELECT ion_type, count(*) AS n, count(DISTINCT sequence) AS n_peptides FROM ions WHERE abs(heavy - light) < 0.01 GROUP BY ion_type")
def skip_filter(spark: SparkSession, d: str) -> DataFrame:
    return _ions(spark, d).where("abs(heavy - light) < 0.01").groupBy("ion_type").agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("n_peptides"))


@query(_IONS + f" SELECT sequence, ion_type, ion_num, CAST(z AS INT) AS z, round((light + z * CAST({chem.PROTON} AS DOUBLE)) / z, 6) AS mz FROM ions, (VALUES (1), (2)) c(z)")
def charge_mz(spark: SparkSession, d: str) -> DataFrame:
    charged = _ions(spark, d).withColumn("z", F.explode(F.array(F.lit(1), F.lit(2))))
    return charged.select("sequence", "ion_type", "ion_num", "z", F.round(chem.ion_mz(F.col("light"), F.col("z")), 6).alias("mz"))


def _modified_sql(site: str) -> str:
    """The ions of whole modified peptides; ``site`` is what counts as the place of a modification."""
    return rf"""WITH t(r, mass, c, n) AS (VALUES {_RESIDUES}), masses(id, mass) AS (VALUES {_MODS}),
        p AS (SELECT DISTINCT "Modified.Sequence" AS modified, "Stripped.Sequence" AS q FROM diann_report WHERE NOT contains("Stripped.Sequence", 'X') AND length("Stripped.Sequence") >= 2 AND "Modified.Sequence" IS NOT NULL),
        k AS (SELECT modified, string_split_regex(modified, '\([^)]*\)') AS parts, regexp_extract_all(modified, '\(([^)]*)\)', 1) AS marks FROM p),
        x AS (SELECT modified, parts, marks, unnest(range(len(marks))) AS i FROM k),
        e AS (SELECT modified, length(array_to_string(parts[1:i + 1], '')) AS site, TRY_CAST(regexp_extract(marks[i + 1], 'UniMod:([0-9]+)', 1) AS INT) AS id FROM x),
        g AS (SELECT modified, {site} AS site, coalesce(mass, 0) AS mass FROM e LEFT JOIN masses USING (id)),
        l AS (SELECT modified, q, unnest(range(1, length(q) + 1)) AS i FROM p),
        m AS (SELECT modified, q, i, mass FROM l JOIN t ON t.r = substr(q, i, 1)),
        w AS (SELECT modified, i, length(q) AS n, sum(mass) OVER b AS bm, sum(mass) OVER y AS ym FROM m WINDOW b AS (PARTITION BY modified, q ORDER BY i), y AS (PARTITION BY modified, q ORDER BY i DESC)),
        ions AS (SELECT modified, 'b' AS ion_type, CAST(i AS INT) AS ion_num, bm AS mass, i - 1 AS upto, -1000 AS beyond FROM w WHERE i < n
                 UNION ALL SELECT modified, 'y', CAST(n - i + 1 AS INT), ym + CAST({chem.WATER} AS DOUBLE), n, i - 2 FROM w WHERE i > 1)
        SELECT ions.modified, ion_type, ion_num, round(any_value(ions.mass) + coalesce(sum(g.mass) FILTER (WHERE site <= upto AND site > beyond), 0), 6) AS light FROM ions LEFT JOIN g USING (modified) GROUP BY ALL"""


def _modified(spark: SparkSession, d: str, site_mode: str) -> DataFrame:
    report = valid_psms(positional_report(read_table(spark, d, "diann_report"))).select("psm_id", "sequence", "mods")
    names = read_table(spark, d, "diann_report").select("psm_id", col("Modified.Sequence").alias("modified"))
    peptides = report.join(names, "psm_id").where("modified is not null").dropDuplicates(["modified", "sequence"])
    ions = peptides.select("modified", F.explode(chem.fragments(F.col("sequence"), F.col("mods"), site_mode=site_mode)).alias("f"))
    return ions.select("modified", "f.ion_type", "f.ion_num", F.round("f.light", 6).alias("light"))


@query(_modified_sql("site"))
def modified_ions(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with their modifications, sites as they stand."""
    return _modified(spark, d, "reference")


@query(_modified_sql("CASE WHEN site > 0 THEN site - 1 ELSE site END"))
def modified_ions_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with their modifications, each with the residue before its bracket."""
    return _modified(spark, d, "corrected")


# --- spectra, windows, nearest scans --------------------------------------------------------------------


_SPECTRA = """s AS (SELECT DISTINCT raw_title, spec_idx, scan_id, precursor_scan_id, CAST(rt AS DOUBLE) AS rt, isolation_lower_mz AS lo, isolation_upper_mz AS hi FROM spectrum_df)"""


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    slim = spectra_frame(read_table(spark, d, "spectrum_df")).drop("mz", "intensity")
    return slim.dropDuplicates(["raw_title", "spec_idx"])


@query(f"WITH {_SPECTRA} SELECT raw_title, count(*) FILTER (WHERE precursor_scan_id = -1) AS n_ms1, count(*) AS n FROM s GROUP BY raw_title")
def ms1_count(spark: SparkSession, d: str) -> DataFrame:
    return _spectra(spark, d).groupBy("raw_title").agg(F.count(F.when(F.col("precursor_scan_id") == -1, 1)).alias("n_ms1"), F.count("*").alias("n"))


_BOUNDS = f"""{_SPECTRA}, i1 AS (SELECT raw_title, min(spec_idx) AS i1 FROM s WHERE precursor_scan_id = -1 GROUP BY raw_title),
    i2 AS (SELECT raw_title, any_value(i1) AS i1, min(spec_idx) FILTER (WHERE spec_idx > i1) AS i2 FROM s JOIN i1 USING (raw_title) WHERE precursor_scan_id = -1 GROUP BY raw_title),
    b AS (SELECT raw_title, spec_idx, CAST(lo AS DOUBLE) AS lower FROM s JOIN i2 USING (raw_title) WHERE spec_idx > i1 AND (i2 IS NULL OR spec_idx < i2) AND lo IS NOT NULL AND NOT isnan(lo))"""


@query(f"WITH {_BOUNDS} SELECT raw_title, CAST(row_number() OVER (PARTITION BY raw_title ORDER BY spec_idx) - 1 AS INT) AS place, lower FROM b")
def cycle_windows(spark: SparkSession, d: str) -> DataFrame:
    return cycle_bounds(_spectra(spark, d)).withColumn("place", F.col("place").cast("int"))


@query(f"WITH {_BOUNDS}, h AS (SELECT raw_title, CAST(min(lo) AS DOUBLE) AS low, CAST(max(hi) FILTER (WHERE NOT isnan(hi)) AS DOUBLE) AS high FROM s JOIN i2 USING (raw_title) WHERE spec_idx > i1 AND (i2 IS NULL OR spec_idx < i2) AND lo IS NOT NULL AND NOT isnan(lo) GROUP BY raw_title) SELECT * FROM h")
def cycle_limits(spark: SparkSession, d: str) -> DataFrame:
    return cycle_range(_spectra(spark, d))


@query(f"WITH {_SPECTRA} SELECT raw_title, CAST(min(lo) AS DOUBLE) AS low, CAST(max(hi) AS DOUBLE) AS high FROM s WHERE precursor_scan_id <> -1 AND lo IS NOT NULL AND NOT isnan(lo) AND hi IS NOT NULL AND NOT isnan(hi) GROUP BY raw_title")
def fragment_limits(spark: SparkSession, d: str) -> DataFrame:
    return fragment_range(_spectra(spark, d))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    slim = _spectra(spark, d)
    center = (F.col("iso_lower").cast("double") + F.col("iso_upper").cast("double")) / 2
    win = F.when(F.col("precursor_scan_id") == -1, F.lit(-1)).otherwise(window_of(F.col("edges"), center))
    slim = slim.join(small_side(cycle_edges(slim)), "raw_title").withColumn("win", win).where("win >= 0 and not isnan(iso_lower) or win = -1").drop("edges")
    return rank_within(slim, ["raw_title", "win"], "spec_idx", CHUNK_ROWS)


_RANKED = f"""{_BOUNDS}, k AS (SELECT s.raw_title, s.spec_idx, s.rt, s.scan_id, s.precursor_scan_id, CASE WHEN precursor_scan_id = -1 THEN -1 ELSE (SELECT count(*) FROM b WHERE b.raw_title = s.raw_title AND b.lower < (CAST(s.lo AS DOUBLE) + CAST(s.hi AS DOUBLE)) / 2) END AS win
      FROM s WHERE raw_title IN (SELECT raw_title FROM b) AND (precursor_scan_id = -1 OR (lo IS NOT NULL AND NOT isnan(lo) AND hi IS NOT NULL))),
    r AS (SELECT *, row_number() OVER (PARTITION BY raw_title, win ORDER BY spec_idx) - 1 AS rank FROM k)"""


@query(f"WITH {_RANKED} SELECT raw_title, spec_idx, CAST(win AS INT) AS win, CAST(rank AS BIGINT) AS rank FROM r")
def window_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("raw_title", "spec_idx", F.col("win").cast("int").alias("win"), "rank")


@query(f"""WITH {_BOUNDS}, m AS (SELECT psm_id, {_STEM} AS raw_title, "Precursor.Mz" AS mz, "Precursor.Charge" AS z, "Stripped.Sequence" AS q FROM diann_report WHERE "Precursor.Mz" IS NOT NULL AND NOT isnan("Precursor.Mz") AND "Stripped.Sequence" IS NOT NULL AND {_STEM} IN (SELECT raw_title FROM b)),
            h AS (SELECT *, (mz * z + (length(q) - length(replace(q, 'K', ''))) * {chem.SILAC_K} + (length(q) - length(replace(q, 'R', ''))) * {chem.SILAC_R}) / z AS hmz FROM m)
          SELECT psm_id, CAST(count(b.lower) FILTER (WHERE b.lower < mz) AS INT) AS light_win, count(b.lower) FILTER (WHERE b.lower < mz) = count(b.lower) FILTER (WHERE b.lower < hmz) AS same_window FROM h JOIN b USING (raw_title) GROUP BY psm_id""")
def same_window(spark: SparkSession, d: str) -> DataFrame:
    psms = positional_report(read_table(spark, d, "diann_report")).where("precursor_mz is not null and not isnan(precursor_mz) and sequence is not null").withColumn("raw_title", run_stem("raw_title"))
    placed = psms.join(small_side(cycle_edges(_spectra(spark, d))), "raw_title")
    light, heavy = window_of(F.col("edges"), F.col("precursor_mz")), window_of(F.col("edges"), chem.heavy_mz(F.col("precursor_mz"), F.col("charge"), F.col("sequence")))
    return placed.select("psm_id", light.alias("light_win"), (light == heavy).alias("same_window"))


_PROBES = f"""p AS (SELECT psm_id, {_STEM} AS raw_title, "RT" AS t FROM diann_report WHERE "RT" IS NOT NULL AND NOT isnan("RT"))"""


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "diann_report").select(F.col("psm_id").alias("probe_id"), run_stem(F.col("Run")).alias("raw_title"), F.col("RT").alias("time"))


def _ms1_points(spark: SparkSession, d: str) -> DataFrame:
    points = _spectra(spark, d).where("precursor_scan_id = -1 and rt > 0")
    return points.select("raw_title", F.col("spec_idx").alias("rank"), F.col("rt").cast("double").alias("time"))


@query(f"""WITH {_SPECTRA}, {_PROBES}, q AS (SELECT psm_id, spec_idx, row_number() OVER (PARTITION BY psm_id ORDER BY abs(s.rt - t), s.rt, CASE WHEN s.rt < t THEN -spec_idx ELSE spec_idx END) AS k
           FROM p JOIN s USING (raw_title) WHERE precursor_scan_id = -1 AND s.rt > 0) SELECT psm_id, CAST(spec_idx AS BIGINT) AS spec_idx FROM q WHERE k = 1""")
def nearest_scan(spark: SparkSession, d: str) -> DataFrame:
    found = nearest(_probes(spark, d), _ms1_points(spark, d), ["raw_title"], CHUNK_MINUTES)
    return found.select(F.col("probe_id").alias("psm_id"), F.col("rank").alias("spec_idx"))


@query(f"""WITH {_RANKED}, m AS (SELECT psm_id, {_STEM} AS raw_title, "RT" AS t, CAST("Precursor.Mz" AS DOUBLE) AS mz FROM diann_report WHERE "RT" IS NOT NULL AND NOT isnan("RT") AND "Precursor.Mz" IS NOT NULL AND NOT isnan("Precursor.Mz")),
            p AS (SELECT psm_id, m.raw_title, any_value(t) AS t, count(*) FILTER (WHERE b.lower < mz) AS win FROM m JOIN b USING (raw_title) GROUP BY psm_id, m.raw_title),
            q AS (SELECT psm_id, rank, row_number() OVER (PARTITION BY psm_id ORDER BY abs(r.rt - t), r.rt, CASE WHEN r.rt < t THEN -rank ELSE rank END) AS k FROM p JOIN r ON r.raw_title = p.raw_title AND r.win = p.win WHERE r.rt > 0)
          SELECT psm_id, CAST(rank AS BIGINT) AS rank FROM q WHERE k = 1""")
def window_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For each match the spectrum of its run and window that is nearest in time, by its rank in the window."""
    slim = _spectra(spark, d)
    edges = cycle_edges(slim)
    psms = read_table(spark, d, "diann_report").select(F.col("psm_id").alias("probe_id"), run_stem(F.col("Run")).alias("raw_title"), F.col("RT").alias("time"), col("Precursor.Mz").cast("double").alias("mz")).where("mz is not null and not isnan(mz)")
    probes = psms.join(small_side(edges), "raw_title").select("probe_id", "raw_title", "time", window_of(F.col("edges"), F.col("mz")).cast("int").alias("win"))
    points = _ranked(spark, d).where("rt > 0").select("raw_title", F.col("win").cast("int").alias("win"), "rank", F.col("rt").cast("double").alias("time"))
    return nearest(probes, points, ["raw_title", "win"], CHUNK_MINUTES).select(F.col("probe_id").alias("psm_id"), "rank")


@query(f"""WITH {_SPECTRA}, {_PROBES}, q AS (SELECT psm_id, spec_idx, row_number() OVER (PARTITION BY psm_id ORDER BY s.rt, spec_idx) AS k
           FROM p JOIN s USING (raw_title) WHERE precursor_scan_id = -1 AND s.rt > 0 AND s.rt >= t) SELECT psm_id, CAST(spec_idx AS BIGINT) AS spec_idx FROM q WHERE k = 1""")
def next_scan(spark: SparkSession, d: str) -> DataFrame:
    found = nearest(_probes(spark, d), _ms1_points(spark, d), ["raw_title"], CHUNK_MINUTES, mode="forward")
    return found.select(F.col("probe_id").alias("psm_id"), F.col("rank").alias("spec_idx"))


@query(f"""WITH {_RANKED}, {_PROBES}, q AS (SELECT psm_id, p.raw_title, rank, row_number() OVER (PARTITION BY psm_id ORDER BY abs(r.rt - t), r.rt, CASE WHEN r.rt < t THEN -rank ELSE rank END) AS k FROM p JOIN r USING (raw_title) WHERE win = -1 AND r.rt > 0)
           SELECT psm_id, spec_idx FROM q JOIN r ON r.raw_title = q.raw_title AND r.win = -1 AND r.rank BETWEEN q.rank - 6 AND q.rank + 6 WHERE k = 1""")
def neighbour_scans(spark: SparkSession, d: str) -> DataFrame:
    ranked = cut(_ranked(spark, d).where("win = -1").select("raw_title", "rank", "spec_idx", "rt"))
    middle = nearest(_probes(spark, d), ranked.where("rt > 0").withColumn("time", F.col("rt").cast("double")), ["raw_title"], CHUNK_MINUTES)
    asked = _probes(spark, d).join(middle, "probe_id").select(F.col("probe_id").alias("psm_id"), "raw_title", F.explode(neighbour_ranks(F.col("rank"), 6)).alias("rank"))
    return asked.join(ranked, ["raw_title", "rank"]).select("psm_id", "spec_idx")


@query(f"""WITH {_SPECTRA} SELECT c.raw_title, c.spec_idx, CAST(coalesce(q.spec_idx, 0) AS INT) AS parent_index FROM s c LEFT JOIN s q ON c.raw_title = q.raw_title AND c.precursor_scan_id = q.scan_id""")
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    scans = _spectra(spark, d)
    return parents(scans, scans.withColumn("scan_id", F.col("scan_id").cast("bigint")), ["raw_title"], "precursor_scan_id", "scan_id", "spec_idx").select("raw_title", "spec_idx", "parent_index")


@query(f"""WITH {_SPECTRA} SELECT raw_title, CAST(width AS DOUBLE) AS width, count(*) AS n FROM (SELECT raw_title, hi - lo AS width FROM s WHERE 700 BETWEEN lo AND hi AND NOT isnan(hi)) GROUP BY raw_title, width""")
def isolation_filter(spark: SparkSession, d: str) -> DataFrame:
    held = _spectra(spark, d).where("700 between iso_lower and iso_upper and not isnan(iso_upper)")
    return held.groupBy("raw_title", (F.col("iso_upper") - F.col("iso_lower")).cast("double").alias("width")).agg(F.count("*").alias("n"))


@query(f"""WITH {_SPECTRA} SELECT psm_id, CAST(count(s.spec_idx) AS BIGINT) AS n_spectra, CAST(min(s.lo) AS DOUBLE) AS low, CAST(max(s.hi) AS DOUBLE) AS high FROM (SELECT psm_id, {_STEM} AS raw_title, CAST("Precursor.Mz" AS FLOAT) AS mz FROM diann_report WHERE "Precursor.Mz" IS NOT NULL AND NOT isnan("Precursor.Mz")) m
          JOIN s ON s.raw_title = m.raw_title AND s.lo <= mz AND mz <= s.hi AND NOT isnan(s.hi) AND NOT isnan(s.lo) GROUP BY psm_id""")
def isolation_matches(spark: SparkSession, d: str) -> DataFrame:
    """For each match how many spectra of its run isolate its precursor, and the reach of their windows; spectra are counted by window first."""
    windows = _spectra(spark, d).where("not isnan(iso_lower) and not isnan(iso_upper)").groupBy("raw_title", "iso_lower", "iso_upper").agg(F.count("*").alias("n"))
    psms = read_table(spark, d, "diann_report").select("psm_id", run_stem(F.col("Run")).alias("raw_title"), col("Precursor.Mz").cast("float").alias("mz")).where("not isnan(mz)")
    held = psms.join(windows, "raw_title").where("iso_lower <= mz and mz <= iso_upper")
    return held.groupBy("psm_id").agg(F.sum("n").alias("n_spectra"), F.min("iso_lower").cast("double").alias("low"), F.max("iso_upper").cast("double").alias("high"))


_PEAKS = "u AS (SELECT DISTINCT raw_title, spec_idx, mz, intensity FROM spectrum_df)"


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "spectrum_df").select("raw_title", "spec_idx", "mz", "intensity").dropDuplicates(["raw_title", "spec_idx"])


@query(f"WITH {_PEAKS} SELECT raw_title, spec_idx, round(coalesce(list_sum(CAST(intensity AS DOUBLE[])), 0), 2) AS tic, len(mz) AS n_peaks FROM u")
def total_intensity(spark: SparkSession, d: str) -> DataFrame:
    return _peaks(spark, d).select("raw_title", "spec_idx", F.round(F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x.cast("double")), 2).alias("tic"), F.size("mz").cast("bigint").alias("n_peaks"))


@query(f"WITH {_PEAKS} SELECT raw_title, spec_idx, CAST(coalesce(sum(len(mz)) OVER (PARTITION BY raw_title ORDER BY spec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u")
def peak_offsets(spark: SparkSession, d: str) -> DataFrame:
    counts = _peaks(spark, d).select("raw_title", "spec_idx", F.size("mz").alias("n"), F.floor(F.col("spec_idx") / CHUNK_ROWS).alias("piece"))
    before = Window.partitionBy("raw_title").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = counts.groupBy("raw_title", "piece").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    own = Window.partitionBy("raw_title", "piece").orderBy("spec_idx").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(pieces, ["raw_title", "piece"]).select("raw_title", "spec_idx", (F.col("base") + F.col("own")).cast("bigint").alias("start"))


@query(f"WITH {_PEAKS} SELECT raw_title, round(min(CAST(x AS DOUBLE)), 3) AS low, round(max(CAST(x AS DOUBLE)), 3) AS high FROM (SELECT raw_title, unnest(mz) AS x FROM u) GROUP BY raw_title")
def mz_range(spark: SparkSession, d: str) -> DataFrame:
    return _peaks(spark, d).where("size(mz) > 0").groupBy("raw_title").agg(F.round(F.min(F.array_min("mz").cast("double")), 3).alias("low"), F.round(F.max(F.array_max("mz").cast("double")), 3).alias("high"))


@query(f"""WITH {_PEAKS}, e AS (SELECT raw_title, spec_idx, unnest(mz) AS m, unnest(intensity) AS i FROM u) SELECT raw_title, spec_idx, round(sum(CAST(i AS DOUBLE)), 2) AS inside FROM e WHERE abs((CAST(m AS DOUBLE) - 500) / 500 * 1e6) <= 100000 GROUP BY ALL""")
def peak_filter(spark: SparkSession, d: str) -> DataFrame:
    inside = matched_intensity(F.col("mz"), F.col("intensity"), F.lit(500.0), 100_000.0)
    some = F.exists("mz", lambda m: F.abs((m.cast("double") - 500) / 500 * 1e6) <= 100_000)
    return _peaks(spark, d).where(some).select("raw_title", "spec_idx", F.round(inside, 2).alias("inside"))


_NEAREST_MS1 = f"""{_SPECTRA}, {_PROBES}, q AS (SELECT psm_id, raw_title, spec_idx, row_number() OVER (PARTITION BY psm_id ORDER BY abs(s.rt - t), s.rt, CASE WHEN s.rt < t THEN -spec_idx ELSE spec_idx END) AS k FROM p JOIN s USING (raw_title) WHERE precursor_scan_id = -1 AND s.rt > 0),
    c AS (SELECT psm_id, q.raw_title, q.spec_idx, "Precursor.Mz" AS mz FROM q JOIN diann_report USING (psm_id) WHERE k = 1)"""


@query(f"""WITH {_NEAREST_MS1}, {_PEAKS}, e AS (SELECT raw_title, spec_idx, unnest(mz) AS m, unnest(intensity) AS i FROM u), t AS (SELECT raw_title, spec_idx, sum(CAST(i AS DOUBLE)) AS total FROM e GROUP BY ALL)
          SELECT psm_id, c.spec_idx, round(coalesce(sum(CAST(i AS DOUBLE)), 0), 2) AS inside, round(coalesce(any_value(total), 0), 2) AS total
          FROM c LEFT JOIN t USING (raw_title, spec_idx) LEFT JOIN e ON e.raw_title = c.raw_title AND e.spec_idx = c.spec_idx AND abs((CAST(m AS DOUBLE) - mz) / mz * 1e6) <= 10 GROUP BY psm_id, c.spec_idx""")
def precursor_peaks(spark: SparkSession, d: str) -> DataFrame:
    """For each match the intensity within 10 ppm of its precursor in the MS1 spectrum nearest in time, and that spectrum's whole intensity."""
    report = read_table(spark, d, "diann_report").select("psm_id", run_stem(F.col("Run")).alias("raw_title"), F.array(col("Precursor.Mz").cast("double")).alias("masses"))
    targets = report.join(nearest_scan(spark, d), "psm_id").select("psm_id", "raw_title", F.col("spec_idx").cast("int").alias("spec_idx"), "masses")
    found = matched_intensities(targets, read_table(spark, d, "spectrum_df").select("raw_title", "spec_idx", "mz", "intensity"), ["raw_title", "spec_idx"], 10.0)
    return found.select("psm_id", "spec_idx", F.round(F.col("found")[0], 2).alias("inside"), F.round("total", 2).alias("total"))


_PPM_SQL = """WITH l AS (SELECT l_extendedprice AS mz, l_quantity AS q FROM lineitem)
          SELECT o_orderkey AS probe_id, count(mz) AS n, coalesce(sum(q), 0.0) AS intensity, round(avg((mz - o_totalprice) / o_totalprice * 1e6), 5) AS ppm_error
          FROM orders LEFT JOIN l ON l.mz BETWEEN o_totalprice * 0.9999 AND o_totalprice * 1.0001 AND abs((mz - o_totalprice) / o_totalprice * 1e6) <= 10 GROUP BY o_orderkey"""


@query(_PPM_SQL)
def ppm_match(spark: SparkSession, d: str) -> DataFrame:
    """Every order looked up: 0 and null where no price is near."""
    probes = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), F.col("o_totalprice").alias("theory"))
    peaks = read_table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))
    return ppm_join(probes, peaks, 10.0).withColumn("ppm_error", F.round("ppm_error", 5))


@query(_PPM_SQL)
def ppm_match_all(spark: SparkSession, d: str) -> DataFrame:
    """``ppm_match`` by its former name."""
    return ppm_match(spark, d)


# --- traces and summaries ------------------------------------------------------------------------------


@query("""SELECT user_id, epoch_us(ts) AS apex_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1""")
def xic_apex(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").where("value is not null").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.groupBy("user_id").agg(traces.apex("us", "value", "event_id").alias("apex_us"))


@query("""WITH k AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS k FROM events WHERE value IS NOT NULL AND event_type IN ('click', 'view'))
          SELECT user_id, max(us) FILTER (WHERE event_type = 'click') - max(us) FILTER (WHERE event_type = 'view') AS delta_us FROM k WHERE k = 1 GROUP BY user_id""")
def apex_delta(spark: SparkSession, d: str) -> DataFrame:
    """The distance in time of two traces' apexes; null where a trace is empty."""
    rows = read_table(spark, d, "events").where("value is not null and event_type in ('click', 'view')").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    tops = rows.groupBy("user_id", "event_type").agg(traces.apex("us", "value", "event_id").alias("us"))
    top = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("us")))
    return tops.groupBy("user_id").agg((top("click") - top("view")).alias("delta_us"))


@query("""SELECT l_returnflag, l_shipdate, CASE WHEN min(l_quantity) = max(l_quantity) OR min(l_extendedprice) = max(l_extendedprice) THEN 0 ELSE round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) END AS r FROM lineitem GROUP BY ALL""")
def pearson_safe(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.round(traces.safe_pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("""SELECT l_orderkey, l_returnflag, count(x) AS v_count, round(least(greatest(quantile_cont(x, 0.25), 0), 1), 6) AS v_p25, round(least(greatest(quantile_cont(x, 0.5), 0), 1), 6) AS v_p50, round(least(greatest(quantile_cont(x, 0.75), 0), 1), 6) AS v_p75, round(avg(x), 6) AS v_mean
          FROM (SELECT l_orderkey, l_returnflag, l_quantity / 25 - 0.5 AS x FROM lineitem) GROUP BY GROUPING SETS ((l_orderkey, l_returnflag), (l_orderkey))""")
def ion_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_quantity") / 25 - 0.5).alias("x"))
    stats = traces.summary(F.col("x"), "v")
    out = rows.groupingSets([["l_orderkey", "l_returnflag"], ["l_orderkey"]], "l_orderkey", "l_returnflag").agg(*stats)
    return out.select("l_orderkey", "l_returnflag", "v_count", *[F.round(f"v_{x}", 6).alias(f"v_{x}") for x in ("p25", "p50", "p75", "mean")])


@query("""SELECT l_orderkey, round(coalesce(sum(l_tax + l_discount) FILTER (WHERE l_tax > 0.02 AND l_discount > 0.02), 0) / coalesce(max(l_quantity) FILTER (WHERE l_tax > 0.02 AND l_discount > 0.02), 1), 8) AS share FROM lineitem GROUP BY l_orderkey""")
def matched_share(spark: SparkSession, d: str) -> DataFrame:
    both = (F.col("l_tax") > 0.02) & (F.col("l_discount") > 0.02)
    share = F.coalesce(F.sum(F.when(both, F.col("l_tax") + F.col("l_discount"))), F.lit(0.0)) / F.coalesce(F.max(F.when(both, F.col("l_quantity"))), F.lit(1.0))
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(share, 8).alias("share"))


@query("""SELECT label, count(*) AS n, round(avg(all_mean), 6) AS mean FROM result WHERE all_mean IS NOT NULL AND NOT isnan(all_mean) AND NOT isinf(all_mean) GROUP BY label""")
def finite_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "result").where("all_mean is not null and not isnan(all_mean) and abs(all_mean) < double('infinity')")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("all_mean"), 6).alias("mean"))


@query("""WITH e AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT user_id, unnest(range(min(day), max(day) + 1)) AS day FROM e GROUP BY user_id)
          SELECT user_id, day, coalesce(n, 0) AS n FROM r LEFT JOIN e USING (user_id, day)""")
def densified(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day"))
    own = events.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    days = events.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(own, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH e AS (SELECT vec_id, label, embedding AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), x AS (SELECT vec_id, label, i, CAST(v[i] AS DOUBLE) AS x FROM e),
            m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i), n AS (SELECT vec_id, label, max(i) AS n FROM x GROUP BY vec_id, label), g AS (SELECT vec_id, label, k, k * (n - 1) / 99.0 AS z, n FROM n, range(100) r(k)),
            f AS (SELECT *, CAST(least(floor(z), n - 2) AS BIGINT) + 1 AS i FROM g WHERE n > 1),
            y AS (SELECT f.vec_id, a.x + (b.x - a.x) * (z - (f.i - 1)) AS u, c.x + (d.x - c.x) * (z - (f.i - 1)) AS w FROM f JOIN x a ON a.vec_id = f.vec_id AND a.i = f.i JOIN x b ON b.vec_id = f.vec_id AND b.i = f.i + 1 JOIN m c ON c.label = f.label AND c.i = f.i JOIN m d ON d.label = f.label AND d.i = f.i + 1)
          SELECT vec_id, round(corr(u, w), 6) AS score FROM y GROUP BY vec_id""")
def trace_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each vector, as a trace, against the mean vector of its label."""
    rows = read_table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    times = F.transform("v", lambda x, i: i.cast("double"))
    return rows.join(means, "label").select("vec_id", F.round(traces.trace_score(times, F.col("v"), times, F.col("m")), 6).alias("score"))


@query()
def feature_row(spark: SparkSession, d: str) -> DataFrame:
    """The whole run over the report and the spectra: one feature row per PSM."""
    psms = positional_report(read_table(spark, d, "diann_report")).withColumn("raw_title", run_stem(F.col("raw_title")))
    return pair_features(psms, spectra_frame(read_table(spark, d, "spectrum_df")))
