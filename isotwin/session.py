"""Session helpers: table access, checkpoints that survive executor loss, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that is broadcast.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a test-data folder; Catalyst prunes and pushes down as for any Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    The folder is the cluster's ``spark.checkpoint.dir``. Only on a single machine (a ``local`` master) a temporary one is made where that is
    unset; elsewhere that is an error, as executors cannot share it. Reliable ``checkpoint()``, so a lost executor costs nothing that was written.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where and not (context.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the size of ``df``; None where the session does not give it (Spark Connect)."""
    plan = getattr(df, "_jdf", None)
    return None if plan is None else int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is at most ``limit`` bytes, else ``df`` as it is.

    Beyond the limit, and where there is no estimate, the join is left to Spark: a shuffle join, whose hot keys adaptive execution splits.
    """
    size = estimated_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df


def quoted(name: str) -> str:
    """A column name fit for ``F.col``, whatever dots or back-ticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    """The column called ``name``, dots included."""
    return F.col(quoted(name))
