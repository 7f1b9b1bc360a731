"""Queries of problems 1, 3 and 4 over the search reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotwin.functions.times import SPELLINGS, run_stem, time_text, unit_of
from isotwin.operators.multivalue import split_fields
from isotwin.operators.schema_drift import schema_changes, unify
from isotwin.operators.units import PROGRAMS, common_units, note_unit
from isotwin.session import col, read_table, small_side

#: The successive deliveries of one report.
DELIVERIES = ("report_w1", "report_w2", "report_w3", "report_w4")
#: The fields of the report that pack several values.
PACKED = ["precursor.mods", "precursor.mod_sites", "pg.genes"]


def _deliveries(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [(name, read_table(spark, sf_dir, name)) for name in DELIVERIES]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(spark, _deliveries(spark, sf_dir), "psm_id")


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unify(_deliveries(spark, sf_dir), "psm_id")
    return out.select("source_table", "psm_id", F.col("Run").alias("run"), col("precursor.sequence").alias("sequence"), col("precursor.charge").alias("charge"), F.round("RT", 4).alias("rt"), F.round(col("precursor.mz.observed"), 2).alias("mz"), F.array_join(col("pg.genes"), ";").alias("genes"), "q_value", F.round("mobility", 3).alias("mobility"), "decoy", "score")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_fields(read_table(spark, sf_dir, "alphadia_report"), ["psm_id"], PACKED)


def p3_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per field and place, over all rows."""
    return p3_found(spark, sf_dir).groupBy("field_name", "pos").agg(F.count("*").alias("n"), F.countDistinct("val").alias("n_distinct"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of the three reports as ``common_units`` takes them; ``plain``: a plain number of the column's own unit may stand as it is."""
    sheet = read_table(spark, sf_dir, "run_sheet")
    null = F.lit(None).cast("string")

    def source(table: str, run: str, entity: str, value: Column, stated: Column, own: str, plain: Column) -> DataFrame:
        return read_table(spark, sf_dir, table).select(F.lit(table).alias("src_table"), "psm_id", run_stem(col(run)).alias("run"), F.upper(col(entity)).alias("entity"), value.alias("value"), stated.alias("stated"), F.lit(own).alias("own"), plain.alias("plain"))

    diann = source("diann_report", "Run", "Stripped.Sequence", F.col("RT").cast("double"), unit_of(col("RT.Unit")), "min", F.lit(True)).withColumn("program", F.lit("diann"))
    alpha = source("alphadia_report", "raw.name", "precursor.sequence", col("precursor.rt.observed").cast("double"), unit_of(col("rt.unit")), "s", F.lit(True)).withColumn("program", F.lit("alphadia"))
    text = read_table(spark, sf_dir, "report_w3").withColumn("_t", time_text(F.col("RT")))
    w3 = text.select(F.lit("report_w3").alias("src_table"), "psm_id", run_stem(F.col("run")).alias("run"), F.upper(col("Stripped.Sequence")).alias("entity"), F.col("_t.value").alias("value"), F.col("_t.unit").alias("stated"), F.lit("min").alias("own"), F.coalesce(F.col("RT").rlike(r"^\s*\d+(?:\.\d+)?\s*$"), F.lit(False)).alias("plain"), null.alias("program"))
    notes = sheet.select(F.col("raw_title").alias("_title"), note_unit(F.col("note"), "diann").alias("_diann"), note_unit(F.col("note"), "alphadia").alias("_alpha"))
    rows = diann.unionByName(alpha).unionByName(w3).join(small_side(notes), F.col("run") == F.col("_title"), "left")
    noted = F.when(F.col("program") == "diann", F.col("_diann")).when(F.col("program") == "alphadia", F.col("_alpha"))
    return rows.withColumn("noted", noted).drop("_title", "_diann", "_alpha")


def _gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "run_sheet").select(F.col("raw_title").alias("run"), "gradient_min")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common_units(_rows(spark, sf_dir), _gradients(spark, sf_dir))


def p4_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the links between sources alone say: in every second run the stated units, notes and gradients are hidden, and the units found
    are compared with the hidden stated ones. Rows of these runs by table: how many stated a unit, and in how many it was found again."""
    hidden = F.pmod(F.xxhash64("run"), F.lit(2)) == 0
    rows = _rows(spark, sf_dir).withColumn("hidden", F.when(hidden, F.col("stated")))
    rows = rows.withColumn("stated", F.when(~hidden, F.col("stated"))).withColumn("noted", F.when(~hidden, F.col("noted")))
    runs = _gradients(spark, sf_dir).withColumn("gradient_min", F.when(~hidden, F.col("gradient_min")))
    out = common_units(rows, runs).where("hidden is not null and rt_min is not null")
    return out.groupBy("src_table").agg(F.count("*").alias("n_stated"), F.count(F.when(F.col("unit") == F.col("hidden"), 1)).alias("n_found"))


def p4_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time of the three reports in minutes, with the unit it stood in."""
    return _times(spark, sf_dir).where("value is not null").select("src_table", "psm_id", "unit", F.round("rt_min", 5).alias("rt_min"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _times(spark, sf_dir).where("rt_min is not null and not (plain and unit = own)")
    return out.select("src_table", "psm_id", F.round(F.col("rt_min") * 6000).cast("bigint").alias("rt_cs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p3_found, p3_value_counts, p4_found, p4_times, p4_linked)}


# --- SQL ----------------------------------------------------------------------------------------------

_QUOTED = "\"(?:[^\"]|\"\")*\"|''(?:[^'']|'''')*''"


def _split_sql() -> str:
    fields = " UNION ALL ".join(rf"""SELECT psm_id, '{f}' AS field_name, regexp_replace("{f}", '^\s+|\s+$', '', 'g') AS raw FROM alphadia_report""" for f in PACKED)

    def parts(sep: str, one: str, rest: str) -> str:
        return rf"regexp_extract_all({sep} || body, '{one}\s*({_QUOTED}|{rest})', 1)"

    def inside(q: str) -> str:
        return rf"regexp_replace(replace(substr(v, 2, length(v) - 2), '{q * 2}', '{q}'), '^\s+|\s+$', '', 'g')"

    return rf"""WITH f AS ({fields}),
        b AS (SELECT psm_id, field_name, regexp_replace(CASE WHEN length(raw) > 1 AND (raw[1] = '[' AND raw[-1] = ']' OR raw[1] = '{{' AND raw[-1] = '}}') THEN substr(raw, 2, length(raw) - 2) ELSE raw END, '^\s+|\s+$', '', 'g') AS body FROM f WHERE raw <> ''),
        m AS (SELECT *, regexp_replace(body, '(^|[;|,/\s])(?:{_QUOTED})', '\1q', 'g') AS masked FROM b),
        s AS (SELECT psm_id, field_name, CASE WHEN regexp_matches(masked, '[;|,/]') THEN {parts("';'", "[;|,/]", "[^;|,/]*")} WHEN contains(masked, chr(9)) THEN {parts("chr(9)", chr(92) + "t", "[^" + chr(92) + "t]*")}
              WHEN contains(masked, ' ') THEN {parts("' '", " +", "[^ ]*")} ELSE [body] END AS parts FROM m),
        v AS (SELECT psm_id, field_name, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS p FROM s),
        t AS (SELECT psm_id, field_name, pos, regexp_replace(p, '^\s+|\s+$', '', 'g') AS v FROM v),
        u AS (SELECT psm_id, field_name, CAST(pos AS BIGINT) AS pos, CASE WHEN regexp_full_match(v, '"(?:[^"]|"")*"') THEN {inside('"')} WHEN regexp_full_match(v, '''(?:[^'']|'''')*''') THEN {inside("''")} ELSE v END AS val FROM t)
        SELECT * FROM u WHERE val <> ''"""


def _unit_sql(text: str) -> str:
    t = rf"regexp_replace(lower(trim({text})), '^[\[(\s]+|[\])\s.]+$', '', 'g')"
    return "CASE " + " ".join(f"WHEN regexp_full_match({t}, '{words}') THEN '{unit}'" for unit, words in SPELLINGS.items()) + " END"


def _noted_sql(program: str) -> str:
    words = "|".join(f"(?:{w})" for w in SPELLINGS.values())
    clause = rf"list_filter(string_split_regex(note, '[;/,!\n|]|\.\s|\.$|\s{{2,}}|\s-\s'), lambda c: regexp_matches(c, '(?i){PROGRAMS[program]}'))[1]"
    return _unit_sql(rf"regexp_extract(regexp_replace({clause}, '(?i){PROGRAMS[program]}', ' '), '(?i)(?:^|[^\w.-])({words})(?:[^\w-]|$)', 1)")


_ONE = r"([+-]?\d[\d '' ]*(?:[.,]\d+)?(?:e[+-]?\d+)?)\s*([a-z]*)\.?"
_CLOCK, _ISO, _WORDS = r"^(\d+):(\d+):([\d.]+)$", r"^pt(?:([\d.]+)h)?(?:([\d.]+)m)?(?:([\d.]+)s)?$", r"^(?:([\d.]+) h )?(?:([\d.]+) min )?([\d.]+) s$"


def _seconds(pattern: str) -> str:
    return " + ".join(f"CAST(coalesce(nullif(regexp_extract(t, '{pattern}', {i}), ''), '0') AS DOUBLE) * {k}" for i, k in ((1, 3600), (2, 60), (3, 1)))


def _stem(column: str) -> str:
    return rf"regexp_replace(regexp_replace(trim({column}), '^.*[/\\]', ''), '\.(raw|mzML)$', '')"


def _minutes(unit: str) -> str:
    return f"CASE {unit} WHEN 'ms' THEN value / 60000 WHEN 's' THEN value / 60 WHEN 'min' THEN value WHEN 'h' THEN value * 60 END"


_W3 = rf"""w3 AS (SELECT *, regexp_replace(lower(trim(RT)), '^[a-z_. ]*[=:]\s*', '') AS t FROM report_w3),
    w3t AS (SELECT *, CASE WHEN regexp_full_match(t, '{_ONE}') THEN CAST(replace(replace(regexp_extract(t, '{_ONE}', 1), ' ', ''), ',', '.') AS DOUBLE) WHEN regexp_matches(t, '{_CLOCK}') THEN {_seconds(_CLOCK)}
      WHEN regexp_matches(t, '{_ISO}') THEN {_seconds(_ISO)} WHEN regexp_matches(t, '{_WORDS}') THEN {_seconds(_WORDS)} END AS value,
      CASE WHEN regexp_full_match(t, '{_ONE}') THEN {_unit_sql(f"regexp_extract(t, '{_ONE}', 2)")} ELSE 's' END AS stated FROM w3)"""
_TIMES_SQL = rf"""WITH {_W3}, a AS (
      SELECT 'diann_report' AS src_table, psm_id, {_stem('"Run"')} AS run, CAST("RT" AS DOUBLE) AS value, {_unit_sql('"RT.Unit"')} AS stated, 'min' AS own, true AS plain FROM diann_report
      UNION ALL SELECT 'alphadia_report', psm_id, {_stem('"raw.name"')}, "precursor.rt.observed", {_unit_sql('"rt.unit"')}, 's', true FROM alphadia_report
      UNION ALL SELECT 'report_w3', psm_id, {_stem('run')}, value, stated, 'min', regexp_full_match(RT, '\s*\d+(\.\d+)?\s*') FROM w3t),
    n AS (SELECT raw_title, gradient_min AS g, {_noted_sql('diann')} AS diann, {_noted_sql('alphadia')} AS alpha FROM run_sheet),
    j AS (SELECT a.*, g, coalesce(stated, CASE src_table WHEN 'diann_report' THEN diann WHEN 'alphadia_report' THEN alpha END) AS known,
          list_filter(['ms', 's', 'min', 'h'], lambda u: {_minutes('u')} BETWEEN 0.025 * g AND g) AS fits FROM a LEFT JOIN n ON a.run = n.raw_title WHERE value IS NOT NULL AND NOT isnan(value)),
    r AS (SELECT *, coalesce(known, CASE WHEN len(fits) = 1 THEN fits[1] END, own) AS unit FROM j)"""

SQL = {
    "p1_unified": f"""WITH {_W3}
        SELECT 'report_w1' AS source_table, psm_id, "Run" AS run, "precursor.sequence" AS sequence, "precursor.charge" AS charge, round(CAST(CAST("RT" AS VARCHAR) AS DOUBLE), 4) AS rt, round("precursor.mz.observed", 2) AS mz, "pg.genes" AS genes, q_value, CAST(NULL AS DOUBLE) AS mobility, CAST(NULL AS BOOLEAN) AS decoy, CAST(NULL AS DOUBLE) AS score FROM report_w1
        UNION ALL SELECT 'report_w2', psm_id, "Run", "precursor.sequence", "precursor.charge", round("RT", 4), round("precursor.mz.observed", 2), "pg.genes", q_value, round(mobility, 3), decoy, NULL FROM report_w2
        UNION ALL SELECT 'report_w3', psm_id, run, "Stripped.Sequence", CAST(regexp_extract("precursor.charge", '[0-9]+') AS BIGINT), round({_minutes("coalesce(stated, 'min')")}, 4), round("precursor.mz.observed", 2), array_to_string("pg.genes", ';'), NULL, round(mobility, 3), decoy = 1, score FROM w3t
        UNION ALL SELECT 'report_w4', psm_id, "raw.name", "precursor.sequence", charge, round(rt_minutes, 4), round(CAST(CAST("precursor.mz.observed" AS VARCHAR) AS DOUBLE), 2), array_to_string("pg.genes", ';'), q_value, round(CAST(CAST(mobility AS VARCHAR) AS DOUBLE), 3), NULL, NULL FROM report_w4""",
    "p3_found": _split_sql(),
    "p3_value_counts": f"SELECT field_name, pos, count(*) AS n, count(DISTINCT val) AS n_distinct FROM ({_split_sql()}) GROUP BY field_name, pos",
    "p4_found": _TIMES_SQL + f" SELECT src_table, psm_id, CAST(round({_minutes('unit')} * 6000) AS BIGINT) AS rt_cs FROM r WHERE NOT (plain AND unit = own)",
    "p4_times": _TIMES_SQL + f" SELECT src_table, psm_id, unit, round({_minutes('unit')}, 5) AS rt_min FROM r",
}
