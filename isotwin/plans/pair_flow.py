"""The whole run: PSMs and spectra to one feature row per PSM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotwin.functions.chem import fragments, heavy_mz, ion_mz
from isotwin.operators.matching import cycle_edges, matched_intensities, window_of
from isotwin.operators.ordered import nearest, neighbour_ranks, rank_within
from isotwin.operators.traces import summary, trace_score
from isotwin.schemas import FEATURE_COLUMNS
from isotwin.session import cut, small_side

#: Rows in a piece of a run that is ranked in one task, and minutes in one that is searched in one task.
CHUNK_ROWS, CHUNK_MINUTES = 4096, 4.0
#: Fragments that labelling moves by less do not count, if light and heavy lie in one window.
UNMOVED = 0.01
MS1, LIGHT, HEAVY = 0, 1, 2


def pair_features(psms: DataFrame, spectra: DataFrame, tol_ppm: float = 10.0, half_width: int = 6, site_mode: str = "reference", label: str = "SILAC") -> DataFrame:
    """One row per valid PSM whose run is in ``spectra``: ``psm_id`` and the feature columns.

    ``psms`` and ``spectra`` as in ``isotwin.schemas``; ``psm_id`` must be unique. Traces reach ``half_width`` spectra to either side of the
    one nearest in time. A PSM without time, mass or spectra near it has empty traces, hence zeros. Peptides with an X are left
    out. Spectra stored twice count once. ``label`` and ``site_mode``: see ``functions.chem``.

    Scale: ranks, windows and neighbours are found on rows without peaks; peaks are shuffled once and go to
    Python once a spectrum, to come out as a number per fragment. No step gathers a run.
    """
    runs = spectra.select("raw_title").distinct()
    psms = psms.where("sequence is not null").where(~F.col("sequence").contains("X")).join(small_side(runs), "raw_title", "left_semi")
    edges = cut(cycle_edges(spectra))
    slim = spectra.select("raw_title", "spec_idx", "rt", "iso_lower", "iso_upper", "precursor_scan_id").dropDuplicates(["raw_title", "spec_idx"])
    slim = slim.join(small_side(edges), "raw_title", "left")
    center = (F.col("iso_lower") + F.col("iso_upper")).cast("double") / 2
    win = F.when(F.col("precursor_scan_id") == -1, F.lit(-1)).otherwise(window_of(F.col("edges"), center))
    slim = cut(rank_within(slim.withColumn("win", win).where("win is not null and not (win >= 0 and (iso_lower is null or isnan(iso_lower)))").drop("edges"), ["raw_title", "win"], "spec_idx", CHUNK_ROWS))

    heavy = heavy_mz(F.col("precursor_mz"), F.col("charge"), F.col("sequence"), label)
    # Spread before the masses are reckoned: a report may come in few large pieces.
    psm = psms.repartition(int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions")), "psm_id").join(small_side(edges), "raw_title", "left").withColumn("heavy_mz", heavy)
    psm = psm.withColumn("win_l", window_of(F.col("edges"), F.col("precursor_mz"))).withColumn("win_h", window_of(F.col("edges"), F.col("heavy_mz"))).drop("edges")
    ions = F.filter(fragments(F.col("sequence"), F.col("mods"), label, site_mode), lambda f: ~F.coalesce((F.abs(f["heavy"] - f["light"]) < UNMOVED) & (F.col("win_l") == F.col("win_h")), F.lit(False)))
    psm = cut(psm.withColumn("ions", ions))

    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), w.cast("int").alias("win"), m.alias("mz")) for k, w, m in ((MS1, F.lit(-1), F.col("precursor_mz")), (LIGHT, F.col("win_l"), F.col("precursor_mz")), (HEAVY, F.col("win_h"), F.col("heavy_mz")))])
    probes = psm.select("psm_id", "raw_title", "rt", F.explode(kinds).alias("x")).select("psm_id", "raw_title", "x.kind", "x.win", F.col("x.mz").alias("own_mz"), F.col("rt").alias("time")).withColumn("probe_id", F.col("psm_id") * 4 + F.col("kind"))
    middle = nearest(probes, slim.select("raw_title", "win", "rank", F.col("rt").alias("time")), ["raw_title", "win"], CHUNK_MINUTES)
    around = probes.join(middle, "probe_id").withColumn("rank", F.explode(neighbour_ranks(F.col("rank"), half_width)))
    used = around.join(slim.select("raw_title", "win", "rank", "spec_idx", F.col("rt").alias("spec_rt"), "iso_lower", "iso_upper"), ["raw_title", "win", "rank"])
    used = used.where((F.col("kind") == MS1) | ((F.col("iso_lower") <= F.col("own_mz").cast("float")) & (F.col("own_mz").cast("float") <= F.col("iso_upper"))))

    # Per fragment the masses at charge 1 and 2, one after the other.
    charged = lambda name: F.flatten(F.transform("ions", lambda f: F.transform(F.array(F.lit(1), F.lit(2)), lambda z: ion_mz(f[name], z))))
    psm = psm.withColumn("masses", F.array(F.array("precursor_mz", "heavy_mz"), charged("light"), charged("heavy")))
    targets = cut(used.select("psm_id", "raw_title", "kind", "spec_idx", F.col("spec_rt").cast("double").alias("rt")))
    asked = targets.join(psm.select("psm_id", "masses"), "psm_id").withColumn("masses", F.get("masses", F.col("kind")))
    points = matched_intensities(asked, spectra.select("raw_title", "spec_idx", "mz", "intensity").join(small_side(psms.select("raw_title").distinct()), "raw_title", "left_semi"), ["raw_title", "spec_idx"], tol_ppm, targets)
    # At most 2 * half_width + 1 points per PSM and kind.
    traces = points.groupBy("psm_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("spec_idx", "rt", "found", "total")))).alias(n) for k, n in ((MS1, "ms1"), (LIGHT, "l"), (HEAVY, "h"))])
    wide = cut(psm.select("psm_id", "ions").join(traces, "psm_id", "left"))

    pick = lambda name, i: F.transform(name, lambda p: F.get(p["found"], i))
    pair = lambda name, i: F.transform(name, lambda p: F.get(p["found"], 2 * i) + F.get(p["found"], 2 * i + 1))
    times = lambda name: F.transform(name, lambda p: p["rt"])
    precursor = wide.select("psm_id", times("ms1").alias("t"), pick("ms1", F.lit(0)).alias("light"), pick("ms1", F.lit(1)).alias("heavy")).select("psm_id", trace_score(F.col("t"), F.col("light"), F.col("t"), F.col("heavy")).alias("precursor_pearson"))
    each = wide.select("psm_id", F.posexplode("ions").alias("i", "ion"), "l", "h").select("psm_id", "ion.ion_type", times("l").alias("lt"), pair("l", F.col("i")).alias("li"), times("h").alias("ht"), pair("h", F.col("i")).alias("hi"), *[F.aggregate(n, F.lit(0.0), lambda s, p: s + p["total"]).alias(f"{n}_all") for n in ("l", "h")])
    scored = each.withColumn("score", trace_score(F.col("lt"), F.col("li"), F.col("ht"), F.col("hi"))).withColumn("both", (F.array_max("li") > 0) & (F.array_max("hi") > 0))
    add = lambda name: F.aggregate(name, F.lit(0.0), lambda s, x: s + x)
    stats = [s for prefix, c in (("b", F.when(F.col("ion_type") == "b", F.col("score"))), ("y", F.when(F.col("ion_type") == "y", F.col("score"))), ("all", F.col("score"))) for s in summary(c, prefix)]
    share = F.coalesce(F.sum(F.when(F.col("both"), add("li") + add("hi"))), F.lit(0.0)) / F.coalesce(F.max(F.when(F.col("both"), F.col("l_all") + F.col("h_all"))), F.lit(1.0))
    by_psm = scored.groupBy("psm_id").agg(F.count("*").alias("valid_fragment_ions_num"), *stats, share.alias("matched_intensity_percent"))
    base = psm.select("psm_id", "sequence", "charge", "precursor_mz", "raw_title", "protein_names", F.length("sequence").alias("sequence_len"), F.lower("protein_names").contains("human").alias("label"))
    out = base.join(precursor, "psm_id", "left").join(by_psm, "psm_id", "left")
    numbers = [c for c in FEATURE_COLUMNS if c not in base.columns]
    return out.fillna(0, subset=numbers).select("psm_id", *FEATURE_COLUMNS)
