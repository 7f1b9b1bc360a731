"""Light and heavy traces: interpolation, correlation, apex, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the grid on which two traces are compared.
GRID = 100


def trace_score(light_rt: Column, light: Column, heavy_rt: Column, heavy: Column) -> Column:
    """Pearson correlation of two traces interpolated on a common grid of ``GRID`` points, 0 where there is none.

    Times ascend. The grid goes from the later start to the earlier end; beyond a trace's ends its end values hold. An empty
    or null trace, one that is constant on the grid, and traces whose times do not overlap give 0.
    """

    def score(lt: pa.Array, li: pa.Array, ht: pa.Array, hi: pa.Array) -> pa.Array:
        columns = [(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False).astype(float)) for x in (lt, li, ht, hi)]
        begins = [np.cumsum(n) - n for n, _ in columns]
        out = np.zeros(len(lt))
        n_light, n_heavy = columns[0][0], columns[2][0]
        usable = (n_light > 0) & (n_heavy > 0) & (columns[1][0] == n_light) & (columns[3][0] == n_heavy)
        # Rows of equal lengths are interpolated together.
        for size in {(int(a), int(b)) for a, b in zip(n_light[usable], n_heavy[usable])}:
            rows = np.flatnonzero(usable & (n_light == size[0]) & (n_heavy == size[1]))
            for k in range(0, len(rows), 2048):
                some = rows[k : k + 2048]
                a, x, b, y = (values[begin[some][:, None] + np.arange(size[i // 2])] for i, ((_, values), begin) in enumerate(zip(columns, begins)))
                low, high = np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, -1], b[:, -1])
                grid = np.linspace(low, high, GRID, axis=1)
                out[some] = _correlation(_interpolated(grid, a, x), _interpolated(grid, b, y))
        return pa.array(out)

    return F.arrow_udf(score, "double")(light_rt, light, heavy_rt, heavy)


def _interpolated(grid: np.ndarray, times: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each row's values on its grid: linear between its ascending times, its end values beyond them."""
    at = np.maximum((grid[:, :, None] >= times[:, None, :]).sum(axis=2) - 1, 0)
    to = np.minimum(at + 1, times.shape[1] - 1)
    pick = lambda m, i: np.take_along_axis(m, i, axis=1)
    step = pick(times, to) - pick(times, at)
    share = np.clip(np.divide(grid - pick(times, at), step, out=np.zeros_like(grid), where=step > 0), 0, 1)
    start = pick(values, at)
    return start + (pick(values, to) - start) * share


def _correlation(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Pearson correlation of each row of ``u`` with that of ``v``; 0 where either is constant or there is none."""
    moving = (np.ptp(u, axis=1) > 0) & (np.ptp(v, axis=1) > 0)
    u, v = u - u.mean(axis=1, keepdims=True), v - v.mean(axis=1, keepdims=True)
    norm = np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))
    r = np.divide((u * v).sum(axis=1), norm, out=np.zeros(len(u)), where=(norm > 0) & moving)
    return np.clip(np.where(np.isfinite(r), r, 0.0), -1, 1)


def safe_pearson(x: str, y: str) -> Column:
    """Correlation of two columns as an aggregate; 0 if either is constant or nothing is left."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y))))
    return F.when((F.min(x) == F.max(x)) | (F.min(y) == F.max(y)), F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0)))


def apex(time: str, intensity: str, order: str) -> Column:
    """The time of the highest intensity as an aggregate; the first by ``order`` of equals."""
    return F.max_by(time, F.struct(F.col(intensity), -F.col(order)))


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def summary(value: Column, prefix: str) -> list[Column]:
    """Aggregates count, quartiles (linear, clipped to 0..1) and mean (not clipped) of the finite values; all 0 if there is none."""
    finite = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
    quartiles = F.percentile(finite, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.count(finite).alias(f"{prefix}_count"), *[F.coalesce(clipped(quartiles[i]), F.lit(0.0)).alias(f"{prefix}_{p}") for i, p in enumerate(("p25", "p50", "p75"))], F.coalesce(F.avg(finite), F.lit(0.0)).alias(f"{prefix}_mean")]
