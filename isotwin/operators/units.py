"""The same time recorded in different units: find each row's unit and convert.

Method: sources are linked through the entities they share (the peptides). Of each two linked sources the scale and the offset between their
clocks are estimated robustly, from the medians and quartiles of the times of shared entities, and snapped to the known conversions; the
conversions so found are passed on through the graph of sources, from those whose unit is known, until no source gains one. A unit stated in
the row, then in the run's notes, and the run's own limits go before the estimate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotwin.functions.times import MINUTES, SPELLINGS, minutes, unit_of
from isotwin.session import cut, small_side

#: Nothing elutes in this share of the gradient's beginning.
DEAD_SHARE = 0.025
#: Shared entities from which a pair's scale is taken from the spread of its times, which no offset moves, instead of from their ratio.
SPREAD_LEAST = 8
#: A time is taken to stand in another unit than its source's if it lies further from its entity's times than any time of known unit does, and
#: than this factor.
OTHER_UNIT = 8.0
#: What separates the statements of a run's note.
CLAUSE_ENDS = r"[;/,!\n|]|\.\s|\.$|\s{2,}|\s-\s"
#: How the programs are written in notes, any case.
PROGRAMS = {"diann": r"dia[\s_-]?nn", "alphadia": r"alpha[\s_-]?dia"}


def note_unit(note: Column, program: str) -> Column:
    """The unit that a run's note states for ``program`` (a key of ``PROGRAMS``); null if it states none.

    A statement counts if it names the program and a unit that does not follow a number (``trap time 1500 ms`` states a
    duration). The first such statement holds.
    """
    words = "|".join(f"(?:{w})" for w in SPELLINGS.values())
    unit = rf"(?i)(?<![\w.-])(?<!\d\s)({words})(?![\w-])"

    def stated(clause: Column) -> Column:
        rest = F.regexp_replace(clause, f"(?i){PROGRAMS[program]}", " ")
        return unit_of(F.regexp_extract(rest, unit, 1))

    clauses = F.filter(F.split(note, CLAUSE_ENDS), lambda c: c.rlike(f"(?i){PROGRAMS[program]}"))
    return F.get(F.filter(F.transform(clauses, stated), lambda u: u.isNotNull()), F.lit(0))


def fitting(value: Column, gradient: Column, shortest: Column | None = None) -> Column:
    """The units in which ``value`` lies between the dead share of the ``shortest`` run and the end of one of ``gradient`` minutes."""
    fits = [F.when((minutes(value, F.lit(u)) >= DEAD_SHARE * (gradient if shortest is None else shortest)) & (minutes(value, F.lit(u)) <= gradient), F.lit(u)) for u in MINUTES]
    return F.array_compact(F.array(*fits))


#: Logarithms of the known scales between two sources: the ratios of the units' sizes.
_SCALES = sorted({round(math.log(a / b), 9) for a in MINUTES.values() for b in MINUTES.values()})


def _snapped(value: Column, known: list[float]) -> Column:
    """The one of ``known`` that is nearest to ``value``."""
    return F.array_min(F.array(*[F.struct(F.abs(value - F.lit(float(k))).alias("d"), F.lit(float(k)).alias("k")) for k in known]))["k"]


def source_links(times: DataFrame) -> DataFrame:
    """Pairs of sources with what leads from one clock to the other: ``a, b, n, log_scale, shift``, so that ``time_b = exp(log_scale) * time_a + shift``.

    ``times``: ``source, entity, time``. An entity's sources are put in an order by hash and each is linked to the next two, so an entity of
    many sources gives links in proportion, and many entities link most sources. The scale is snapped to the known ratios of units; it
    comes from the ratio of the quartile distances, which no offset moves, where ``SPREAD_LEAST`` entities are shared, else from the median
    ratio of the times. The shift is what then parts the medians.
    """
    medians = times.groupBy("entity", "source").agg(F.percentile_approx("time", 0.5).alias("time"))
    line = Window.partitionBy("entity").orderBy(F.xxhash64("entity", "source"), "source")
    near = medians.withColumn("next", F.array(*[F.lead(F.struct("source", "time"), k).over(line) for k in (1, 2)]))
    pairs = near.select("source", "time", F.explode("next").alias("o")).where("o is not null")
    swap = F.col("source") > F.col("o.source")
    pairs = pairs.select(F.when(swap, F.col("o.source")).otherwise(F.col("source")).alias("a"), F.when(swap, F.col("source")).otherwise(F.col("o.source")).alias("b"), F.when(swap, F.col("o.time")).otherwise(F.col("time")).alias("x"), F.when(swap, F.col("time")).otherwise(F.col("o.time")).alias("y"))
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 1000)
    sums = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), quartiles("x").alias("x"), quartiles("y").alias("y"), F.percentile_approx(F.log("y") - F.log("x"), 0.5).alias("ratio"))
    wide_x, wide_y = F.col("x")[2] - F.col("x")[0], F.col("y")[2] - F.col("y")[0]
    scale = F.when((F.col("n") >= SPREAD_LEAST) & (wide_x > 0) & (wide_y > 0), F.log(wide_y / wide_x)).otherwise(F.col("ratio"))
    return sums.withColumn("log_scale", _snapped(scale, _SCALES)).select("a", "b", "n", "log_scale", (F.col("y")[1] - F.exp("log_scale") * F.col("x")[1]).alias("shift"))


def spread_units(links: DataFrame, known: DataFrame, zeros: tuple[float, ...] = (0.0,)) -> DataFrame:
    """``source, unit, zero`` of every source that links (``source_links``) connect with a ``known`` one (the same columns).

    Each round, sources without a unit take the one that most shared entities speak for among their neighbours with one, until no source
    gains any; so the rounds are as many as the graph is deep. ``zero`` is what has to be added to a time in minutes, snapped to ``zeros``.
    """
    both = links.select("a", "b", "n", "log_scale", "shift").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", (-F.col("log_scale")).alias("log_scale"), (-F.col("shift") * F.exp(-F.col("log_scale"))).alias("shift")))
    both = cut(both)
    sizes = {u: math.log(m) for u, m in MINUTES.items()}
    have = cut(known.select("source", "unit", "zero"))
    fresh = have
    while True:
        asked = both.join(small_side(fresh.withColumnRenamed("source", "a")), "a").join(small_side(have.select(F.col("source").alias("b"))), "b", "left_anti")
        log_size = _log_minutes(F.col("unit")) - F.col("log_scale")
        votes = asked.withColumn("size", _snapped(log_size, sorted(sizes.values()))).groupBy("b", "size").agg(F.sum("n").alias("n"), F.percentile_approx(F.col("zero") - F.exp("size") * F.col("shift"), 0.5).alias("zero"))
        best = votes.groupBy("b").agg(F.max_by(F.struct("size", "zero"), F.struct("n", -F.col("size"))).alias("x"))
        unit = F.coalesce(*[F.when(F.abs(F.col("x.size") - F.lit(v)) < 1e-6, F.lit(u)) for u, v in sizes.items()])
        fresh = cut(best.select(F.col("b").alias("source"), unit.alias("unit"), _snapped(F.col("x.zero"), list(zeros)).alias("zero")))
        if not fresh.limit(1).count():
            return have
        have = cut(have.unionByName(fresh))


def common_units(rows: DataFrame, runs: DataFrame, zeros: tuple[float, ...] = (0.0,)) -> DataFrame:
    """``rows`` with the columns ``unit`` and ``rt_min``, the time in minutes.

    ``rows``: ``src_table string, psm_id, run string, entity string, value double, stated string, noted string, own
    string``: a time, the unit the row itself states, the unit the run's note states for the source's program, and the
    source's customary unit, all null where unknown. ``runs``: ``run, gradient_min`` (null or not positive: unknown), one
    row per run. ``zeros``: minutes by which a source's clock is known to start late, if any does; the estimated offset of a source whose
    unit is estimated is snapped to the nearest of them. By default all clocks start together.

    The unit is, in this order: stated; noted; the only one in which the time fits the run's gradient. Else, of those that
    fit it (the limits of the shortest and longest run, if none does or it is unknown), the one estimated for the source, unless the time then
    lies further off the entity's other times than any time of known unit (and than ``OTHER_UNIT`` times); then the one nearest to those;
    failing these the estimated, then the customary one. A source's rows of known unit and its others count as two sources in the graph. Null, NaN, infinite and negative
    values give a null ``rt_min``. Rows are kept as they are, repeated ones too; null runs and entities are linked to nothing.

    Scale: only entities of rows of open unit enter the graph. It costs an aggregation by source and entity, links in proportion to those, an
    aggregation by pair of sources, and rounds over those pairs alone. Sides are broadcast only within the size bound.
    """
    runs = runs.groupBy(F.col("run").alias("_run")).agg(F.max(F.when(F.col("gradient_min") > 0, F.col("gradient_min"))).alias("_gradient"))
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < F.lit(float("inf")))
    known = rows.join(small_side(runs), F.col("run") == F.col("_run"), "left").withColumn("_v", F.when(good, F.col("value")))
    known = known.withColumn("_fits", fitting(F.col("_v"), F.col("_gradient")))
    known = known.withColumn("_sure", F.coalesce("stated", "noted", F.when(F.size("_fits") == 1, F.get("_fits", F.lit(0)))))
    known = cut(known.drop("_run"))
    if not known.where("_sure is null and _v is not null").limit(1).count():
        return _converted(known.withColumn("unit", F.coalesce("_sure", "own")).withColumn("_zero", F.lit(0.0)))

    source = F.concat_ws("\u0001", F.when(F.col("_sure").isNull(), F.lit("open")).otherwise(F.lit("known")), "src_table", F.coalesce("run", F.lit("\u0002")))
    linked = known.where("_v > 0 and entity is not null and run is not null")
    asked = cut(linked.where("_sure is null").select(F.col("entity").alias("_e")).distinct())
    times = linked.join(small_side(asked), F.col("entity") == F.col("_e"), "left_semi").select(source.alias("source"), "entity", F.coalesce(minutes(F.col("_v"), F.col("_sure")), F.col("_v")).alias("time"))
    times = cut(times)
    start = times.where("source like 'known%'").select("source").distinct().select("source", F.lit("min").alias("unit"), F.lit(0.0).alias("zero"))
    units = spread_units(cut(source_links(times)), start, zeros)
    # What an entity's times are in minutes: by its sources of known unit, else by those that were given one.
    placed = times.join(small_side(units), "source").select("entity", F.col("source").startswith("known").alias("sure"), (minutes(F.col("time"), F.col("unit")) + F.col("zero")).alias("time"))
    median = lambda which: F.percentile_approx(F.when(which, F.log("time")), 0.5)
    middle = placed.where("time > 0").groupBy(F.col("entity").alias("_e")).agg(F.coalesce(median(F.col("sure")), median(~F.col("sure"))).alias("_mid"))

    middle = cut(middle)
    sure_times = placed.where("sure and time > 0").join(small_side(middle), F.col("entity") == F.col("_e"))
    widest = sure_times.agg(F.max(F.abs(F.log("time") - F.col("_mid")))).first()[0]
    limit = max(math.log(OTHER_UNIT), widest or 0.0)

    left = known.where("_sure is null and _v is not null").withColumn("_source", source)
    left = left.join(small_side(units.select(F.col("source").alias("_source"), F.col("unit").alias("_scale"), F.col("zero").alias("_zero"))), "_source", "left")
    left = left.join(small_side(middle), F.col("entity") == F.col("_e"), "left")
    shortest, longest = runs.agg(F.min("_gradient"), F.max("_gradient")).first()
    between = fitting(F.col("_v"), F.lit(longest), F.lit(shortest)) if longest else F.array(*map(F.lit, MINUTES))
    left = left.withColumn("_able", F.when(F.size("_fits") > 0, F.col("_fits")).otherwise(between))
    zero = F.coalesce("_zero", F.lit(0.0))
    off = lambda u: F.abs(F.log(F.greatest(minutes(F.col("_v"), u) + zero, F.lit(1e-9))) - F.col("_mid"))
    near = F.when(F.col("_mid").isNotNull() & (F.col("_v") > 0), F.array_min(F.transform("_able", lambda u: F.struct(off(u).alias("d"), u.alias("u"))))["u"])
    usual = F.when(F.array_contains("_able", F.col("_scale")) & (F.col("_mid").isNull() | (F.col("_v") <= 0) | (off(F.col("_scale")) <= limit)), F.col("_scale"))
    guessed = left.withColumn("unit", F.coalesce(usual, near, F.col("_scale"), F.col("own"))).withColumn("_zero", zero).drop("_source", "_scale", "_mid", "_able", "_e")
    sure = known.where("_sure is not null or _v is null").withColumn("unit", F.coalesce("_sure", "own")).withColumn("_zero", F.lit(0.0))
    return _converted(sure.unionByName(guessed))


def _converted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rt_min", minutes(F.col("_v"), F.col("unit")) + F.col("_zero")).drop("_v", "_fits", "_sure", "_gradient", "_zero")


def _log_minutes(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, size in MINUTES.items():
        out = F.when(unit == name, F.lit(math.log(size))).otherwise(out)
    return out
