"""Search-engine reports as PSM frames, and spectra as spectrum frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotwin.functions.chem import inline_mods, listed_mods
from isotwin.session import col

#: Places, from 0, of the columns that a type 1 report is read by.
POSITIONS = {"modified": 4, "sequence": 5, "charge": 6, "precursor_mz": 10, "protein_names": 13}


def _identified(df: DataFrame) -> DataFrame:
    """``df`` with a ``psm_id``: its own, or one made from the row's place, which is its identity in a report without one."""
    return df if "psm_id" in df.columns else df.withColumn("psm_id", F.monotonically_increasing_id())


def positional_report(df: DataFrame) -> DataFrame:
    """PSMs of a type 1 report: columns by place, ``Run`` and ``RT`` (minutes) by name. No row is filtered."""
    at = {name: col(df.columns[i]) for name, i in POSITIONS.items()}
    df = _identified(df)
    return df.select("psm_id", F.col("Run").alias("raw_title"), at["sequence"].alias("sequence"), at["charge"].cast("int").alias("charge"), at["precursor_mz"].cast("double").alias("precursor_mz"), F.col("RT").cast("double").alias("rt"), inline_mods(at["modified"]).alias("mods"), at["protein_names"].alias("protein_names"))


def named_report(df: DataFrame) -> DataFrame:
    """PSMs of a type 2 report: columns by name, times from seconds to minutes, genes for protein names. No row is filtered."""
    df = _identified(df)
    return df.select("psm_id", col("raw.name").alias("raw_title"), col("precursor.sequence").alias("sequence"), col("precursor.charge").cast("int").alias("charge"), col("precursor.mz.observed").cast("double").alias("precursor_mz"), (col("precursor.rt.observed") / 60).alias("rt"), listed_mods(col("precursor.mods"), col("precursor.mod_sites")).alias("mods"), col("pg.genes").alias("protein_names"))


def read_psms(spark: SparkSession, path: str, engine: int = 1) -> DataFrame:
    """The valid PSMs of the Parquet report at ``path``: ``engine`` 1 is read by place, 2 by name, others are refused.

    Peptides with an X, or without a sequence, are left out.
    """
    if engine not in (1, 2):
        raise ValueError(f"search_engine_type {engine}: 1 or 2 is known")
    df = spark.read.parquet(path)
    return valid_psms(positional_report(df) if engine == 1 else named_report(df))


def valid_psms(psms: DataFrame) -> DataFrame:
    return psms.where(~F.col("sequence").contains("X"))


def spectra_frame(df: DataFrame) -> DataFrame:
    """A stored spectrum table as a spectrum frame, rows stored twice once; a spectrum is its run and place."""
    return df.select("raw_title", "spec_idx", "scan_id", "precursor_scan_id", "rt", F.col("isolation_lower_mz").alias("iso_lower"), F.col("isolation_upper_mz").alias("iso_upper"), "mz", "intensity")
