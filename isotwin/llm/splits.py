"""Training, validation and test splits that keep related records together.

Method: records are joined into components by the entities they share; components are balanced into many nearly equal bins
by largest differencing (blocks of weights, always the two with the widest spread combined, heaviest with lightest), and
whole bins go to the splits by target share.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotwin.session import cut

#: Bins into which the components of one stratum are balanced; bounds what the driver sees.
BINS = 256
#: Most blocks of weights combined in one task.
FAN_IN = 64
#: Steps of label share that components are stratified by, besides those with no label.
LABEL_STEPS = 4

#: End groups written before and after a peptide.
HEAD_GROUPS = "Ac|Acetyl|H|Me|For|Formyl|Myr|Pal|Boc|Fmoc|Biotin|Bio|pGlu|Suc|TMT|iTRAQ"
TAIL_GROUPS = "OH|NH2|NH|COOH|CONH2|OMe|NHMe|Am"


def peptide_chain(sequence: Column) -> Column:
    """The residues of a peptide in capitals, I written as L; null where none is left.

    Bracketed and starred modifications, charges after a point, stroke or letter, end groups, neighbouring residues
    (``K.PEPTIDE.R``), underscores and blanks are left out.
    """
    s = F.regexp_replace(sequence, r"\s+", "")
    for _ in range(2):
        s = F.regexp_replace(s, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")
    s = F.regexp_replace(s, f"(?i)^_?-?(?:{HEAD_GROUPS})-|^[_-]+", "")
    s = F.regexp_replace(s, f"(?i)-(?:{TAIL_GROUPS})([_./+0-9]|$)", "$1")
    s = F.regexp_replace(s, r"[_*#^~'`]", "")
    s = F.regexp_replace(s, r"(?:[./|+:;,-]?z?=?\+?\d+\+*|\++)$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z-]?\.", ""), r"\.[A-Za-z-]?$", "")
    s = F.regexp_replace(s, r"[^A-Za-z]", "")
    return F.nullif(F.translate(F.upper(s), "I", "L"), F.lit(""))


# --- components ------------------------------------------------------------------------------------


def components(records: DataFrame, id_col: str, keys: list[str], rounds: int = 40) -> DataFrame:
    """``id, component``: records connected through equal values of any of ``keys``; nulls connect nothing.

    One key: the component is the key itself and nothing is shuffled. Several: smallest labels spread from records to key
    values and back, each value in turn linked to its smallest label (not to its other records), until no label changes;
    a value that a third of all rows share costs one combined row per task. Records without any key are left out.
    """
    if len(keys) == 1:
        return records.where(F.col(keys[0]).isNotNull()).select(id_col, F.col(keys[0]).cast("string").alias("component"))
    values = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}\u0001"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    edges = cut(records.select(id_col, F.explode(F.array_compact(F.array(*values))).alias("value")))
    labels = cut(edges.groupBy(id_col).agg(F.min("value").alias("component")))
    for _ in range(rounds):
        best = edges.join(labels, id_col).groupBy("value").agg(F.min("component").alias("low"))
        # The smallest label of a value is itself a value: following it once more halves the remaining distance.
        jump = best.join(best.select(F.col("value").alias("low"), F.col("low").alias("lower")), "low", "left").select("value", F.coalesce("lower", "low").alias("low"))
        new = cut(edges.join(jump, "value").groupBy(id_col).agg(F.min("low").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), id_col).where("component <> old").limit(1).count()
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels


# --- largest differencing ---------------------------------------------------------------------------


def _combine(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest differencing over rows of bin weights: the sums per bin, and the bin that each row's places go to."""
    n, k = weights.shape
    groups: dict[int, tuple[np.ndarray, list[tuple[int, np.ndarray]]]] = {i: (weights[i], [(i, np.arange(k))]) for i in range(n)}
    heap = [(-float(np.ptp(weights[i])), i) for i in range(n)]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (wa, ma), (wb, mb) = groups.pop(a), groups.pop(b)
        down, up = np.argsort(-wa, kind="stable"), np.argsort(wb, kind="stable")
        place_a, place_b = np.empty(k, int), np.empty(k, int)
        place_a[down] = np.arange(k)
        place_b[up] = np.arange(k)
        total = wa[down] + wb[up]
        groups[fresh] = (total, [(r, place_a[m]) for r, m in ma] + [(r, place_b[m]) for r, m in mb])
        heapq.heappush(heap, (-float(np.ptp(total)), fresh))
        fresh += 1
    total, members = groups.popitem()[1]
    places = np.empty((n, k), int)
    for r, m in members:
        places[r] = m
    return total, places


def _combine_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    total, places = _combine(np.array(pdf["weights"].tolist(), float))
    first = pdf["up"].iloc[0]
    return pd.DataFrame({"stratum": pdf["stratum"], "block": pdf["block"], "up": first, "places": list(places.astype("int32")), "total": [total if i == 0 else None for i in range(len(pdf))]})


def balanced_bins(weighted: DataFrame, bins: int = BINS) -> DataFrame:
    """``stratum, component, bin``: components of ``weighted`` (``stratum int, component, weight``) in ``bins`` nearly equal bins per stratum.

    Components are ordered by falling weight and cut into blocks of ``bins``, each a set of bins with one component apiece;
    blocks are combined by largest differencing, ``FAN_IN`` at a time, until one is left per stratum. What is combined are
    arrays of ``bins`` weights; the components themselves stay in place and are looked up at the end. The order comes from
    counts per weight and range within equal weights, so no task sorts all components.
    """
    pieces = 4 * max(64, int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = weighted.withColumn("piece", F.pmod(F.xxhash64("component"), F.lit(pieces)))
    cells = cut(ranked.groupBy("stratum", "weight", "piece").agg(F.count("*").alias("n")))
    # One row a weight for the order of weights, which grow at most as the square root of all records; one row a piece within each weight.
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    heavier = cells.groupBy("stratum", "weight").agg(F.sum("n").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(up_to(Window.partitionBy("stratum").orderBy(F.desc("weight")))), F.lit(0))).drop("n")
    starts = cells.withColumn("own", F.coalesce(F.sum("n").over(up_to(Window.partitionBy("stratum", "weight").orderBy("piece"))), F.lit(0))).join(heavier, ["stratum", "weight"]).withColumn("start", F.col("own") + F.col("above")).drop("own", "above")
    inside = Window.partitionBy("stratum", "weight", "piece").orderBy("component")
    placed = ranked.withColumn("inner", F.row_number().over(inside) - 1).join(starts.drop("n"), ["stratum", "weight", "piece"])
    rank = F.col("start") + F.col("inner")
    placed = cut(placed.select("stratum", "component", "weight", F.floor(rank / bins).alias("block"), (rank % bins).cast("int").alias("place")))
    filled = placed.groupBy("stratum", "block").agg(F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("m"))
    blocks = filled.select("stratum", "block", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias("weights"))
    paths = placed.select("stratum", "block").distinct().select("stratum", "block", F.col("block").alias("at"), F.sequence(F.lit(0), F.lit(bins - 1)).alias("way"))
    while True:
        grouped = blocks.withColumn("up", F.floor(F.col("block") / FAN_IN))
        done = cut(grouped.groupBy("stratum", "up").applyInPandas(_combine_group, "stratum int, block bigint, up bigint, places array<int>, total array<double>"))
        step = done.select("stratum", F.col("block").alias("at"), "up", "places")
        paths = paths.join(step, ["stratum", "at"]).select("stratum", "block", F.col("up").alias("at"), F.transform("way", lambda p: F.get("places", p)).alias("way"))
        blocks = done.where("total is not null").select("stratum", F.col("up").alias("block"), F.col("total").alias("weights"))
        if blocks.agg(F.max("block")).first()[0] in (0, None):
            break
    return placed.join(paths, ["stratum", "block"]).select("stratum", "component", F.get("way", F.col("place")).alias("bin"))


def allocate(bins: list[tuple[int, int, float, float, float]], targets: dict[str, float], sweeps: int = 20) -> dict[tuple[int, int], str]:
    """Whole bins to splits, so that totals of weight, of true labels and of false labels come near the targets.

    ``bins``: ``stratum, bin, weight, positive, labelled``. The cost is the sum over splits and the three totals of the
    squared distance to the target, as shares, divided by the target. Heaviest first, each bin goes where it costs least;
    then bins move one at a time while that lowers the cost, at most ``sweeps`` times over all. Ties go to the larger
    target, then by name.
    """
    share = sum(targets.values()) or 1
    names = sorted((s for s, t in targets.items() if t > 0), key=lambda s: (-targets[s], s))
    want = np.array([targets[s] / share for s in names])[:, None]
    order = sorted(bins, key=lambda x: (-x[2], x[0], x[1]))
    own = np.array([(w, p, n - p) for _, _, w, p, n in order], float).reshape(-1, 3)
    own /= np.maximum(own.sum(axis=0), 1)
    lack = np.repeat(want, 3, axis=1)
    where = np.zeros(len(order), int)
    for i, x in enumerate(own):
        where[i] = np.argmin(((x * x - 2 * x * lack) / want).sum(axis=1))
        lack[where[i]] -= x
    for _ in range(sweeps):
        moved = False
        for i, x in enumerate(own):
            lack[where[i]] += x
            costs = ((x * x - 2 * x * lack) / want).sum(axis=1)
            to = int(np.argmin(costs))
            if costs[to] < costs[where[i]] - 1e-15:
                where[i], moved = to, True
            lack[where[i]] -= x
        if not moved:
            break
    return {(s, b): names[k] for (s, b, *_), k in zip(order, where)}


def split_records(records: DataFrame, targets: dict[str, float], keys: list[str], bins: int = BINS) -> DataFrame:
    """Every record with a key, its ``component`` and its ``split``.

    ``records``: ``record_id, label boolean`` and the columns ``keys``; records that share a value of any key, directly or
    through others, come into one split. ``targets``: share by split name; shares are taken relative to their sum, and a
    split with share 0 gets nothing. Records whose keys are all null belong to no component and are left out. A null label
    counts for the weight only. Rows stored twice count twice and go together. A component heavier than its share goes whole
    to the split that lacks most. Components are stratified by their share of true labels, so that every split gets a like
    share. Empty ``records`` give no rows.

    Scale: components are weighed by an aggregation combined before its shuffle; the driver sees at most
    ``(LABEL_STEPS + 2) * bins`` bin totals.
    """
    if len(keys) == 1:
        tagged = records.where(F.col(keys[0]).isNotNull()).withColumn("component", F.col(keys[0]).cast("string"))
    else:
        tagged = records.join(components(records, "record_id", keys), "record_id")
    tagged = cut(tagged)
    sizes = tagged.groupBy("component").agg(F.count("*").alias("weight"), F.count(F.when(F.col("label"), 1)).alias("positive"), F.count("label").alias("labelled"))
    stratum = F.when(F.col("labelled") == 0, F.lit(LABEL_STEPS + 1)).otherwise(F.round(F.col("positive") / F.col("labelled") * LABEL_STEPS)).cast("int")
    sizes = cut(sizes.withColumn("stratum", stratum))
    binned = cut(balanced_bins(sizes.select("stratum", "component", "weight"), bins))
    totals = sizes.join(binned, ["stratum", "component"]).groupBy("stratum", "bin").agg(*[F.sum(c).alias(c) for c in ("weight", "positive", "labelled")]).collect()
    chosen = allocate([tuple(r) for r in totals], targets)
    spark = records.sparkSession
    table = spark.createDataFrame([(s, b, name) for (s, b), name in chosen.items()], "stratum int, bin int, split string")
    splits = binned.join(F.broadcast(table), ["stratum", "bin"]).select("component", "split")
    return tagged.join(splits, "component")


