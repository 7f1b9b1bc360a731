"""Reports that arrive file by file, as a stream of PSMs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from isotwin.sources.reports import named_report, positional_report, valid_psms


def stream_psms(spark: SparkSession, folder: str, schema: T.StructType, engine: int = 1) -> DataFrame:
    """Valid PSMs of every Parquet report that comes to ``folder``; the batch readers' rules hold. The report needs a ``psm_id``."""
    reports = spark.readStream.schema(schema).parquet(folder)
    return valid_psms(positional_report(reports) if engine == 1 else named_report(reports))
