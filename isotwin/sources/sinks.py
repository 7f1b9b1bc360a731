"""Where results go."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotwin.schemas import FEATURE_COLUMNS


def write_features(features: DataFrame, path: str, single_file: bool = False) -> None:
    """Features as CSV with a header, truth values as ``True`` and ``False``; no row gives the header alone.

    ``single_file`` gathers the rows in one task: for results that a person opens.
    """
    out = features.select(*[F.initcap(F.col(c).cast("string")).alias(c) if t == "boolean" else F.col(c) for c, t in features.select(*FEATURE_COLUMNS).dtypes])
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True)


def staged(spark: SparkSession, df: DataFrame, path: str, reuse: bool = False) -> DataFrame:
    """``df`` written to ``path`` as Parquet, by Spark's commit protocol, and read again.

    What is there is written over, unless ``reuse`` says that a whole stage of the same columns and types there is to be read as it is.
    """
    if reuse:
        try:
            there = spark.read.parquet(path)
            if there.dtypes == df.dtypes:
                return there
        except AnalysisException:
            pass
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
