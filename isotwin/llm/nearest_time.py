"""Records of two tables paired by nearest time, for the same entity and within a tolerance.

Method: every right-hand time becomes the interval in which it is the nearest one, bounded by the midpoints to its
neighbours and by the tolerance. The intervals are filed in a partitioned index of time bins and value bins, the latter as
wide as the interval of values itself asks for, and left times are range-joined through it with an equi-join on the bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotwin.session import estimated_bytes

#: Bytes of the right table, as Catalyst estimates them, for each of which the index gets a partition.
PART_BYTES = 4 << 20
#: An estimate from here on says that the size is not known.
UNKNOWN_BYTES = 1 << 56
#: Intervals of values narrower than two to this power are filed like those.
NARROWEST = -10


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """For each left row the right row nearest in time: ``left_id, right_id, distance``.

    ``left``: ``left_id, entity, time double, value double``. ``right``: ``right_id, entity, time double, lower double,
    upper double``; a right row can serve a left row of its entity if ``lower <= value <= upper`` and the times differ by at
    most ``tolerance``. Of equally near ones the lowest ``right_id`` is taken. Left rows without a partner give no row; so do
    nulls, NaN and infinities in any of these columns. Left rows of one ``left_id`` give one row, the nearest of all. Rows
    stored twice change nothing. Other columns are not read, so their names cannot clash.

    Scale: the interval bounds are found within pieces of an entity's time line, with a margin copied into the next piece,
    so an entity that holds a third of all rows is spread over many tasks; the join key holds the time bin and the value bin
    for the same reason. A right row is filed in one time bin and in one or two value bins, two to four times as wide as its own
    ``upper - lower``; a left row looks in two time bins, and once for each such width that occurs. Only ids, times and bounds are
    shuffled, into as many partitions as the right table's size asks for (``PART_BYTES``).
    """
    time_bin, piece = 2 * tolerance, 40 * tolerance
    margin = 2 * tolerance
    one = F.lit(1e-9)
    spark = left.sparkSession
    size = estimated_bytes(right) or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES) if size < UNKNOWN_BYTES else 0)
    right = right.select("entity", *[F.col(c).cast("double").alias(c) for c in ("time", "lower", "upper")], "right_id")
    right = right.where(F.col("entity").isNotNull() & F.col("right_id").isNotNull() & _finite(F.col("time")) & _finite(F.col("lower")) & _finite(F.col("upper")) & (F.col("lower") <= F.col("upper")))
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("upper") - F.col("lower"), F.lit(2.0**NARROWEST)))), F.lit(NARROWEST)).cast("int")
    levels = sorted(r[0] for r in right.select(level).distinct().collect())
    schema = "left_id bigint, right_id bigint, distance double"
    if not levels:
        return spark.createDataFrame([], schema)
    pieces = F.sequence(F.floor((F.col("time") - margin) / piece), F.floor((F.col("time") + margin) / piece))
    cell = ["entity", "lower", "upper", "piece"]
    spread = right.withColumn("piece", F.explode(pieces)).repartition(parts, *cell).groupBy(*cell, "time").agg(F.min("right_id").alias("right_id"))
    line = Window.partitionBy(*cell).orderBy("time")
    spread = spread.withColumn("before", F.lag("time").over(line)).withColumn("after", F.lead("time").over(line))
    own = spread.where(F.col("piece") == F.floor(F.col("time") / piece))
    start = F.greatest(F.col("time") - tolerance, (F.col("before") + F.col("time")) / 2) - one
    stop = F.least(F.col("time") + tolerance, (F.col("after") + F.col("time")) / 2) + one
    index = own.select("entity", "right_id", F.col("time").alias("r_time"), "lower", "upper", start.alias("start"), stop.alias("stop"), level.cast("int").alias("level"))
    width = lambda step: F.pow(F.lit(2.0), step + 1)
    index = index.withColumn("v_bin", F.explode(F.sequence(F.floor(F.col("lower") / width(F.col("level"))), F.floor(F.col("upper") / width(F.col("level")))))).withColumn("t_bin", F.floor(F.col("r_time") / time_bin))
    probe = left.select("left_id", "entity", F.col("time").cast("double").alias("l_time"), F.col("value").cast("double").alias("value"))
    probe = probe.where(F.col("left_id").isNotNull() & F.col("entity").isNotNull() & _finite(F.col("l_time")) & _finite(F.col("value")))
    reach = F.sequence(F.floor((F.col("l_time") - tolerance - one) / time_bin), F.floor((F.col("l_time") + tolerance + one) / time_bin))
    probe = probe.withColumn("t_bin", F.explode(reach)).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("v_bin", F.floor(F.col("value") / width(F.col("level"))))
    key = ["entity", "t_bin", "level", "v_bin"]
    distance = F.abs(F.col("l_time") - F.col("r_time"))
    pairs = probe.repartition(parts, *key).join(index.repartition(parts, *key), key).where("l_time between start and stop and value between lower and upper").where(distance <= tolerance)
    best = pairs.groupBy("left_id").agg(F.min(F.struct(distance.alias("distance"), "right_id")).alias("best"))
    return best.select("left_id", "best.right_id", "best.distance")
