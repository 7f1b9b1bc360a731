"""Ordered operators that hold for a key with a third of all rows: ranks, nearest as-of, neighbours, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: list[str], order: str, chunk: int, name: str = "rank") -> DataFrame:
    """``df`` with its rank from 0 by the integer column ``order`` within ``keys``.

    Rows are ranked within chunks of ``chunk`` successive values of ``order``; the chunks' counts, one row each, give the
    offsets. So no task holds a whole key. Equal values of ``order`` are ranked in no stated order; null keys form one group.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    counts = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{i}k") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = [cut[k].eqNullSafe(F.col(f"_{i}k")) for i, k in enumerate(keys)] + [cut["_chunk"].eqNullSafe(F.col("_c"))]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    own = Window.partitionBy(*keys, "_chunk").orderBy(order)
    out = cut.withColumn("_own", F.row_number().over(own) - 1).join(starts, condition)
    return out.withColumn(name, (F.col("_start") + F.col("_own")).cast("bigint")).drop("_chunk", "_own", "_start", "_c", *[f"_{i}k" for i in range(len(keys))])


def nearest(probes: DataFrame, points: DataFrame, keys: list[str], chunk: float, mode: str = "nearest") -> DataFrame:
    """For every probe the point of its keys that is nearest in time: ``probe_id, rank``; ties go to the earlier point.

    ``probes``: ``keys, probe_id, time``; ``points``: ``keys, rank, time``. ``mode`` ``nearest`` reaches as far as need be, on either
    side; ``forward`` takes the first point not before the probe. Of points of one time the lowest rank counts when they lie
    at or after the probe, the highest when before. Null times and keys match nothing, as do keys without points.

    Scale: probes and points are sorted together within pieces of ``chunk`` time units; a piece knows the last point
    before and the first after it from a table of one row per piece, so a key may hold any share of the rows.
    """
    spot = "struct<time:double,rank:bigint>"
    points = points.where(F.col("time").isNotNull() & ~F.isnan("time")).select(*keys, F.col("time").cast("double").alias("time"), F.col("rank").cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("probe_id"))
    probes = probes.where(F.col("time").isNotNull() & ~F.isnan("time")).select(*keys, F.col("time").cast("double").alias("time"), F.lit(None).cast("bigint").alias("rank"), F.col("probe_id").cast("bigint").alias("probe_id"))
    both = points.unionByName(probes).where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_piece", F.floor(F.col("time") / chunk))
    point = F.when(F.col("rank").isNotNull(), F.struct("time", "rank"))
    pieces = both.groupBy(*keys, "_piece").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    by_piece = Window.partitionBy(*keys).orderBy("_piece")
    edges = pieces.select(*keys, "_piece", F.last("_last", ignorenulls=True).over(by_piece.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", ignorenulls=True).over(by_piece.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    line = Window.partitionBy(*keys, "_piece").orderBy("time", F.col("rank").isNotNull(), "rank")
    seen = both.withColumn("_b", F.last(point, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first(point, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing)))
    found = seen.where("probe_id is not null").join(edges, [*keys, "_piece"]).select("probe_id", "time", F.coalesce("_b", "_earlier").cast(spot).alias("b"), F.coalesce("_a", "_later").cast(spot).alias("a"))
    if mode == "forward":
        return found.where("a is not null").select("probe_id", "a.rank")
    earlier = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("time") - F.col("b.time") <= F.col("a.time") - F.col("time")))
    return found.where("a is not null or b is not null").select("probe_id", F.when(earlier, F.col("b.rank")).otherwise(F.col("a.rank")).alias("rank"))


def neighbour_ranks(rank: Column, k: int) -> Column:
    """The ranks from ``k`` before to ``k`` after, to be exploded and joined; those below 0 are left out, those beyond the end find no row."""
    return F.sequence(F.greatest(rank - k, F.lit(0).cast("bigint")), rank + k)


def parents(children: DataFrame, scans: DataFrame, keys: list[str], parent: str, scan: str, index: str) -> DataFrame:
    """``children`` with ``parent_index``: the ``index`` of the scan their ``parent`` names; an unknown one gives 0."""
    known = scans.select(*keys, F.col(scan).alias(parent), F.col(index).alias("_index"))
    return children.join(known, [*keys, parent], "left").withColumn("parent_index", F.coalesce("_index", F.lit(0))).drop("_index")
