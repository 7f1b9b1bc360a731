"""Matching m/z values: isolation windows and relative tolerances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotwin.operators.ordered import rank_within
from isotwin.session import cut

#: Targets of one spectrum that are matched in one place.
HOT_TARGETS = 20_000
#: Spectra with more that are broadcast.
FEW_HOT = 100_000

def window_of(edges: Column, value: Column) -> Column:
    """The window that ``value`` falls in: the number of lower bounds below it. ``edges`` as of ``cycle_edges``."""
    return F.aggregate(F.filter(edges, lambda e: e["lower"] < value), F.lit(0), lambda n, e: n + e["n"].cast("int"))


def within_ppm(mz: Column, theory: Column, tol: float | Column) -> Column:
    """Whether ``mz`` is within ``tol`` parts per million of ``theory``, the limits included."""
    return F.abs((mz - theory) / theory * 1e6) <= tol


def matched_intensity(mz: Column, intensity: Column, theory: Column, tol: float) -> Column:
    """Sum of the intensities of the peaks of an array spectrum within ``tol`` ppm of ``theory``; 0 if there is none."""
    peaks = F.filter(F.arrays_zip(mz.alias("m"), intensity.alias("i")), lambda p: within_ppm(p["m"].cast("double"), theory, tol))
    return F.aggregate(peaks, F.lit(0.0), lambda s, p: s + p["i"].cast("double"))


def matched_intensities(targets: DataFrame, spectra: DataFrame, keys: list[str], tol: float, slim: DataFrame | None = None) -> DataFrame:
    """For each row of ``targets`` the summed intensity of its spectrum's peaks within ``tol`` ppm of each of its masses.

    ``targets``: ``keys, masses`` (``array<double>``) and whatever else is to come back; ``spectra``: ``keys, mz, intensity``, found by equal
    ``keys``. Out come the columns of ``targets`` but ``masses``, ``found`` (``array<double>``, a null or unmatched mass gives 0) and ``total``, the
    spectrum's whole intensity. A spectrum stored twice counts once; a target without a spectrum is left out; a null intensity counts 0.

    Scale: both sides are shuffled once by ``keys`` and meet in order, each spectrum before its targets, so peaks are neither joined to nor
    copied for every target, and no group is gathered: a task holds a batch of rows. A spectrum with more than ``HOT_TARGETS`` targets is sent to as
    many places as it takes; ``slim`` may give the ``keys`` of the rows of ``targets`` for this count, where they are cheaper to have.
    """
    hot = (targets if slim is None else slim).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_TARGETS).select(*keys, F.ceil(F.col("_n") / HOT_TARGETS).cast("int").alias("_places"))
    hot = cut(hot)
    if hot.count() <= FEW_HOT:
        hot = F.broadcast(hot)
    rest = [c for c in targets.columns if c != "masses"]
    kinds = {f.name: f.dataType for f in targets.schema}
    one = F.coalesce("_places", F.lit(1))
    peaks = spectra.join(hot, keys, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), one - 1))).select(*keys, "_place", F.lit(False).alias("_asks"), "mz", "intensity", F.lit(None).cast("array<double>").alias("masses"), *[F.lit(None).cast(kinds[c]).alias(c) for c in rest if c not in keys])
    place = F.pmod(F.xxhash64(*[c for c in rest if c not in keys]), one).cast("int")
    asks = targets.join(hot, keys, "left").select(*keys, place.alias("_place"), F.lit(True).alias("_asks"), *[F.lit(None).cast(spectra.schema[c].dataType).alias(c) for c in ("mz", "intensity")], "masses", *[c for c in rest if c not in keys])
    order = [*keys, "_place"]
    line = peaks.unionByName(asks).repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order, "_asks")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mz = intensity = owner = None
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                asks = batch.column("_asks").to_numpy(zero_copy_only=False)
                some = pa.array(np.flatnonzero(~asks))
                held = [batch.column(c).take(some) for c in ("mz", "intensity")]
                owners = pa.RecordBatch.from_arrays([batch.column(c).take(some) for c in order], names=order)
                if mz is not None:
                    # The spectrum that the batch before ended with goes on.
                    held = [pa.concat_arrays(x) for x in zip((mz, intensity), held)]
                    owners = pa.Table.from_batches([owner, owners]).combine_chunks().to_batches()[0]
                # Each target's spectrum is the last one before it, if it is of its keys.
                spectrum = (np.cumsum(~asks) - (mz is None))[asks]
                rows = batch.take(pa.array(np.flatnonzero(asks)))
                if owners.num_rows:
                    at = pa.array(np.maximum(spectrum, 0))
                    same = spectrum >= 0
                    for c in order:
                        same &= pc.fill_null(pc.equal(owners.column(c).take(at), rows.column(c)), False).to_numpy(zero_copy_only=False)
                    kept = pa.array(np.flatnonzero(same))
                    rows, spectrum = rows.take(kept), spectrum[same]
                    if rows.num_rows:
                        found, total = _matched(*held, rows.column("masses"), spectrum, tol)
                        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in rest], found, pa.array(total[spectrum])], names=[*rest, "found", "total"])
                    mz, intensity, owner = held[0][-1:], held[1][-1:], owners.slice(owners.num_rows - 1)

    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in rest], T.StructField("found", T.ArrayType(T.DoubleType())), T.StructField("total", T.DoubleType())])
    return line.mapInArrow(match, schema)


def _matched(mzs: pa.Array, intensities: pa.Array, asked: pa.Array, spectrum: np.ndarray, tol: float) -> tuple[pa.Array, np.ndarray]:
    """The intensities of the peaks near each asked mass, a list for each row of ``asked`` (of that number of ``mzs``), and the spectra's totals.

    The peaks of all spectra are brought in order, unless they are, and all masses find theirs by one binary search.
    """
    row, peaks = _flat(mzs)
    value_row, values = _flat(intensities)
    values = np.nan_to_num(values)
    # Of nothing at all bincount makes whole numbers.
    total = np.bincount(value_row, values, len(mzs)).astype(float)
    order = np.arange(len(peaks))
    # One number line for all spectra: each one's masses have a stretch of their own.
    target_row, masses = _flat(asked)
    target_row = spectrum[target_row]
    stretch = 2 * max(1.0, np.nanmax(peaks, initial=0.0), np.nanmax(np.abs(masses), initial=0.0))
    line = row * stretch + peaks
    if len(line) and not np.all(np.diff(line) >= 0):
        order = np.argsort(line, kind="stable")
        line = line[order]
    reach = np.abs(masses) * (tol * 1e-6) * (1 + 1e-9) + 1e-9 + len(mzs) * stretch * 1e-15
    at = target_row * stretch + masses
    low, high = np.searchsorted(line, at - reach), np.searchsorted(line, at + reach, side="right")
    some = np.flatnonzero(high > low)
    times = (high - low)[some]
    which = np.repeat(some, times)
    near = order[np.repeat(low[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    inside = (np.abs((peaks[near] - masses[which]) / masses[which] * 1e6) <= tol) & (row[near] == target_row[which])
    found = np.bincount(which[inside], values[near[inside]], len(masses)).astype(float)
    lengths = pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(found)), total


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each value of a batch of lists, and the values; null lists hold none, null values are NaN."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False).astype(float)


def ppm_join(probes: DataFrame, peaks: DataFrame, tol: float, keys: list[str] | None = None) -> DataFrame:
    """For every probe the peaks within ``tol`` ppm: ``probe_id, n, intensity, ppm_error`` (sum and mean; 0 and null if none).

    ``probes``: ``probe_id, theory`` and ``keys``; ``peaks``: ``mz, intensity`` and ``keys``. Logarithmic bins as wide as the
    tolerance turn the match into an equi-join on bin and keys, each probe looked up in three bins; the exact test remains.
    The bins are narrow, so a hot key is spread over as many as it has masses. Non-positive and null masses match nothing.
    """
    keys = keys or []
    step = -math.log(1 - tol * 1e-6)
    bins = lambda c: F.floor(F.log(F.when(F.col(c) > 0, F.col(c))) / step)
    left = probes.select(*keys, "probe_id", "theory", F.explode(F.array(*[bins("theory") + d for d in (-1, 0, 1)])).alias("_bin"))
    right = peaks.where("mz > 0").select(*keys, "mz", "intensity", bins("mz").alias("_bin"))
    pairs = left.join(right, [*keys, "_bin"]).where(within_ppm(F.col("mz"), F.col("theory"), tol))
    sums = pairs.groupBy("probe_id").agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity"), F.avg((F.col("mz") - F.col("theory")) / F.col("theory") * 1e6).alias("ppm_error"))
    return probes.select("probe_id").join(sums, "probe_id", "left").select("probe_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("intensity", F.lit(0.0)).alias("intensity"), "ppm_error")


def _first_cycle(spectra: DataFrame) -> DataFrame:
    """The spectra with a window strictly between a run's first and second MS1, or after the only one."""
    ms1 = spectra.where("precursor_scan_id = -1").select("raw_title", F.col("spec_idx").cast("bigint").alias("i"))
    first = ms1.groupBy("raw_title").agg(F.min("i").alias("i1"))
    second = ms1.join(first, "raw_title").groupBy("raw_title").agg(F.first("i1").alias("i1"), F.min(F.when(F.col("i") > F.col("i1"), F.col("i"))).alias("i2"))
    return spectra.join(second, "raw_title").where("spec_idx > i1 and (i2 is null or spec_idx < i2) and iso_lower is not null and not isnan(iso_lower)")


def cycle_bounds(spectra: DataFrame) -> DataFrame:
    """``raw_title, place, lower``: the lower bounds of the spectra strictly between a run's first and second MS1, from place 0 in file order.

    MS1 are the spectra whose ``precursor_scan_id`` is -1. With one MS1 the cycle lasts to the run's end; a run without MS1, or
    without spectra in its first cycle, gives no row. A spectrum stored twice counts once. Rows stay rows, ranked in pieces of a run.
    """
    inside = _first_cycle(spectra).select("raw_title", F.col("spec_idx").cast("bigint").alias("spec_idx"), F.col("iso_lower").cast("double").alias("lower")).distinct()
    return rank_within(inside, ["raw_title"], "spec_idx", 4096, "place").select("raw_title", "place", "lower")


def cycle_edges(spectra: DataFrame) -> DataFrame:
    """``raw_title, edges``: the distinct lower bounds of a run's first cycle (``cycle_bounds``) with how many spectra have each, ascending.

    Counted before anything is gathered, so what comes together for a run is its window scheme, however many spectra its cycle has.
    """
    inside = _first_cycle(spectra).select("raw_title", "spec_idx", F.col("iso_lower").cast("double").alias("lower")).distinct()
    return inside.groupBy("raw_title", "lower").agg(F.count("*").alias("n")).groupBy("raw_title").agg(F.array_sort(F.collect_list(F.struct("lower", "n"))).alias("edges"))


def cycle_range(spectra: DataFrame) -> DataFrame:
    """``raw_title, low, high``: the least lower and the greatest upper bound of the windows of a run's first cycle (``cycle_bounds``)."""
    return _first_cycle(spectra).groupBy("raw_title").agg(F.min("iso_lower").cast("double").alias("low"), F.max(F.when(~F.isnan("iso_upper"), F.col("iso_upper"))).cast("double").alias("high"))


def fragment_range(spectra: DataFrame) -> DataFrame:
    """``raw_title, low, high``: the range of the isolation windows of all of a run's spectra that have a parent; MS1 do not count."""
    inside = spectra.where("precursor_scan_id <> -1 and iso_lower is not null and not isnan(iso_lower) and iso_upper is not null and not isnan(iso_upper)")
    return inside.groupBy("raw_title").agg(F.min("iso_lower").cast("double").alias("low"), F.max("iso_upper").cast("double").alias("high"))
