"""Queries of problems 2 and 5 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotwin.functions.times import run_stem
from isotwin.llm.leakage import leaked
from isotwin.llm.mixing import count_tokens, mix, mix_shares
from isotwin.llm.nearest_time import nearest_in_time
from isotwin.llm.pii import find_pii, redact
from isotwin.llm.splits import HEAD_GROUPS, TAIL_GROUPS, peptide_chain, split_records
from isotwin.session import col, cut, read_table

#: Minutes within which a spectrum is near enough to a match.
TOLERANCE_MIN = 0.05


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of result with a peptide, and its split."""
    targets = {r["split_name"]: r["target_share"] for r in read_table(spark, sf_dir, "split_targets").collect()}
    records = read_table(spark, sf_dir, "result").select(F.col("feature_id").alias("record_id"), "label", peptide_chain(F.col("sequence")).alias("peptide"))
    out = split_records(records, targets, ["peptide"])
    return out.select(F.col("record_id").alias("feature_id"), "peptide", "split", "label")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_splits(spark, sf_dir).select("feature_id", "peptide")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, peptides and share of true labels of each split."""
    out = p2_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("peptide").alias("n_peptides"), F.avg(F.col("label").cast("double")).alias("true_share"))
    return out


def p2_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that keep together what shares a peptide or a protein, directly or through others: for each split its rows, its peptides and
    proteins, and how many of those also stand in another split (none may)."""
    targets = {r["split_name"]: r["target_share"] for r in read_table(spark, sf_dir, "split_targets").collect()}
    records = read_table(spark, sf_dir, "result").select(F.col("feature_id").alias("record_id"), "label", peptide_chain(F.col("sequence")).alias("peptide"), F.nullif(F.trim("protein_names"), F.lit("")).alias("protein"))
    out = cut(split_records(records, targets, ["peptide", "protein"]).select("record_id", "peptide", "protein", "split"))

    def by(key: str) -> DataFrame:
        seen = out.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("split").alias("splits"))
        return seen.select(F.explode("splits").alias("split"), (F.size("splits") > 1).alias("twice")).groupBy("split").agg(F.count("*").alias(f"n_{key}s"), F.count_if("twice").alias(f"n_{key}s_elsewhere"))

    return out.groupBy("split").agg(F.count("*").alias("n_rows")).join(by("peptide"), "split", "left").join(by("protein"), "split", "left")


def p2_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splits must hold to: rows, peptides, peptides in more than one split (none), and whether each split's share of rows is within
    two hundredths of its target and its share of true labels within three hundredths of the whole's, either by the heaviest peptide's share
    of the rows more, as no peptide can be parted."""
    out = cut(p2_splits(spark, sf_dir))
    true = F.avg(F.col("label").cast("double"))
    whole = out.agg(F.count("*").alias("n"), true.alias("true")).first()
    heaviest = (out.groupBy("peptide").count().agg(F.max("count")).first()[0] or 0) / max(1, whole["n"])
    targets = read_table(spark, sf_dir, "split_targets")
    shares = out.groupBy("split").agg(F.count("*").alias("n"), true.alias("true_share")).join(F.broadcast(targets), F.col("split") == F.col("split_name"), "full")
    near = shares.agg(F.bool_and(F.abs(F.coalesce("n", F.lit(0)) / F.lit(whole["n"]) - F.col("target_share")) <= 0.02 + heaviest).alias("a"), F.bool_and(F.abs(F.col("true_share") - F.lit(whole["true"])) <= 0.03 + heaviest).alias("b")).first()
    peptides = out.groupBy("peptide").agg(F.count("*").alias("n"), F.countDistinct("split").alias("k"))
    return peptides.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_peptides"), F.count_if(F.col("k") > 1).alias("n_torn")).select("n_rows", "n_peptides", "n_torn", F.lit(near["a"]).alias("shares_near"), F.lit(near["b"]).alias("labels_near"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = read_table(spark, sf_dir, "diann_report")
    left = report.select(F.col("psm_id").alias("left_id"), run_stem(F.col("Run")).alias("entity"), F.col("RT").alias("time"), col("Precursor.Mz").alias("value"))
    spectra = read_table(spark, sf_dir, "spectrum_df").where("rt > 0")
    right = spectra.select(F.col("scan_id").cast("bigint").alias("right_id"), F.col("raw_title").alias("entity"), F.col("rt").alias("time"), F.col("isolation_lower_mz").alias("lower"), F.col("isolation_upper_mz").alias("upper"))
    return nearest_in_time(left, right, TOLERANCE_MIN).select(F.col("left_id").alias("psm_id"), F.col("right_id").alias("scan_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages on which each leaked item was found."""
    return p6_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_pages"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen pages and their repeats."""
    return mix(count_tokens(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that each source really has."""
    return mix_shares(spark, p7_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on which items of personal information begin, each once per kind: a page's items are brought together by the page alone."""
    return find_pii(read_table(spark, sf_dir, "documents")).select("doc_id", "pii_kind", "line_no").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_splits, p2_shares, p2_two_keys, p2_apart, p5_found, p6_found, p6_items, p7_mix, p7_shares, p8_found, p8_redacted)}

def _chain(column: str) -> str:
    """The SQL of ``peptide_chain``."""
    s = f"regexp_replace({column}, '\\s+', '', 'g')"
    for pattern, put in (
        *[(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")] * 2,
        (f"(?i)^_?-?(?:{HEAD_GROUPS})-|^[_-]+", ""),
        (f"(?i)-(?:{TAIL_GROUPS})([_./+0-9]|$)", "\\1"),
        ("[_*#^~''`]", ""),
        (r"(?:[./|+:;,-]?z?=?\+?\d+\+*|\++)$", ""),
        (r"^[A-Za-z-]?\.", ""),
        (r"\.[A-Za-z-]?$", ""),
        ("[^A-Za-z]", ""),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{put}', 'g')"
    return f"nullif(translate(upper({s}), 'I', 'L'), '')"


SQL = {
    "p2_found": f"SELECT feature_id, {_chain('sequence')} AS peptide FROM result WHERE {_chain('sequence')} IS NOT NULL",
    "p2_apart": f"SELECT count(*) AS n_rows, count(DISTINCT peptide) AS n_peptides, CAST(0 AS BIGINT) AS n_torn, true AS shares_near, true AS labels_near FROM (SELECT {_chain('sequence')} AS peptide FROM result) WHERE peptide IS NOT NULL",
    "p5_found": r"""
        WITH m AS (SELECT psm_id, regexp_replace(regexp_replace(trim("Run"), '^.*[/\\]', ''), '\.(raw|mzML)$', '') AS run, "RT" AS rt, "Precursor.Mz" AS mz FROM diann_report
                   WHERE "RT" IS NOT NULL AND "Precursor.Mz" IS NOT NULL),
             s AS (SELECT DISTINCT raw_title, scan_id, CAST(rt AS DOUBLE) AS rt, isolation_lower_mz AS lo, isolation_upper_mz AS hi FROM spectrum_df WHERE rt > 0 AND NOT isnan(rt)),
             p AS (SELECT psm_id, scan_id, row_number() OVER (PARTITION BY psm_id ORDER BY abs(m.rt - s.rt), scan_id) AS k
                   FROM m JOIN s ON m.run = s.raw_title AND m.mz >= s.lo AND m.mz <= s.hi AND NOT isnan(s.hi) AND abs(m.rt - s.rt) <= 0.05)
        SELECT psm_id, CAST(scan_id AS BIGINT) AS scan_id FROM p WHERE k = 1""",
}
