"""Peptide chemistry as Column expressions: modifications, heavy labels, fragment masses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isotwin.functions.times import let

#: Proton and water, in Da.
PROTON, WATER = 1.00727646677, 18.0105647
#: Residue masses in Da with their numbers of carbon and nitrogen atoms.
RESIDUES = {
    "G": (57.02146, 2, 1), "A": (71.03711, 3, 1), "S": (87.03203, 3, 1), "P": (97.05276, 5, 1), "V": (99.06841, 5, 1), "T": (101.04768, 4, 1), "C": (103.00919, 3, 1),
    "L": (113.08406, 6, 1), "I": (113.08406, 6, 1), "N": (114.04293, 4, 2), "D": (115.02694, 4, 1), "Q": (128.05858, 5, 2), "K": (128.09496, 6, 2), "E": (129.04259, 5, 1),
    "M": (131.04049, 5, 1), "H": (137.05891, 6, 3), "F": (147.06841, 9, 1), "R": (156.10111, 6, 4), "Y": (163.06333, 9, 1), "W": (186.07931, 11, 2),
}
#: Monoisotopic masses of modifications by Unimod id.
MODIFICATIONS = {4: 57.021464, 35: 15.994915, 21: 79.966331, 1: 42.010565, 34: 14.015650, 36: 28.031300, 37: 42.046950, 7: 0.984016, 26: 39.994915, 28: -17.026549, 27: -18.010565}
#: Unimod ids by modification name.
MOD_IDS = {"Carbamidomethyl": 4, "Oxidation": 35, "Phospho": 21, "Acetyl": 1, "Methyl": 34, "Dimethyl": 36, "Trimethyl": 37, "Deamidated": 7, "Pyro-carbamidomethyl": 26, "Gln->pyro-Glu": 28, "Glu->pyro-Glu": 27}
#: What a heavy label adds, in Da: per K and R (SILAC), per carbon, per nitrogen atom.
SILAC_K, SILAC_R, HEAVY_C, HEAVY_N = 8.014204, 10.008275, 1.00727646677, 0.997036


def _lookup(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def inline_mods(modified: Column) -> Column:
    """``array<struct<site, unimod_id>>`` of ``AC(UniMod:4)DE``: the site is the number of residues before the bracket.

    Null text gives null; a bracket without a ``UniMod`` number gives a null id, an unclosed one is not read.
    """
    pieces = F.split(modified, r"\([^)]*\)")
    marks = F.regexp_extract_all(modified, F.lit(r"\(([^)]*)\)"), F.lit(1))
    site = lambda i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda n, s: n + F.length(s))
    return F.transform(marks, lambda m, i: F.struct(site(i).cast("int").alias("site"), F.regexp_extract(m, r"UniMod:(\d+)", 1).try_cast("int").alias("unimod_id")))


def listed_mods(mods: Column, sites: Column) -> Column:
    """``array<struct<site, unimod_id>>`` of lists ``Name@AA;...`` and ``site;...``, sites less one.

    Null or empty lists, and lists of unequal number, give an empty array; an unknown name a null id.
    """
    names, places = F.split(mods, ";"), F.split(sites, ";")
    pair = F.transform(F.arrays_zip(names.alias("m"), places.alias("s")), lambda x: F.struct((F.trim(x["s"]).try_cast("int") - 1).alias("site"), F.try_element_at(_lookup(MOD_IDS), F.regexp_extract(F.trim(x["m"]), r"^([^@]*)", 1)).alias("unimod_id")))
    usable = (F.length(mods) > 0) & (F.length(sites) > 0) & (F.size(names) == F.size(places))
    return F.when(F.coalesce(usable, F.lit(False)), pair).otherwise(F.array().cast("array<struct<site:int,unimod_id:int>>"))


def mod_mass(mods: Column, end: Column) -> Column:
    """Sum of the masses of the modifications with a site of at most ``end``; an unknown id counts 0."""
    return F.aggregate(F.filter(mods, lambda m: m["site"] <= end), F.lit(0.0), lambda s, m: s + F.coalesce(F.try_element_at(_lookup(MODIFICATIONS), m["unimod_id"]), F.lit(0.0)))


def _sum_per_residue(sequence: Column, table: dict[str, float]) -> Column:
    return sum((F.regexp_count(sequence, F.lit(r)).cast("double") * v for r, v in table.items()), F.lit(0.0))


def heavy_shift(sequence: Column, label: str = "SILAC") -> Column:
    """The mass that ``SILAC``, ``CHEAVY`` or ``NHEAVY`` labelling adds to a peptide; letters that are no residues add 0."""
    if label == "SILAC":
        return F.regexp_count(sequence, F.lit("K")) * F.lit(SILAC_K) + F.regexp_count(sequence, F.lit("R")) * F.lit(SILAC_R)
    if label not in ("CHEAVY", "NHEAVY"):
        raise ValueError(label)
    which, mass = (1, HEAVY_C) if label == "CHEAVY" else (2, HEAVY_N)
    return _sum_per_residue(sequence, {r: float(x[which]) for r, x in RESIDUES.items()}) * mass


def heavy_mz(mz: Column, charge: Column, sequence: Column, label: str = "SILAC") -> Column:
    """The precursor m/z of the heavy counterpart."""
    return (mz * charge + heavy_shift(sequence, label)) / charge


def ion_mz(mass: Column, charge: Column) -> Column:
    return (mass + charge * F.lit(PROTON)) / charge


def fragments(sequence: Column, mods: Column, label: str = "SILAC", site_mode: str = "reference") -> Column:
    """b ions 1..n-1, then y ions 1..n-1: ``array<struct<ion_type, ion_num, light, heavy>>``, neutral masses.

    ``site_mode``: ``reference`` takes sites as they stand; ``corrected`` lowers inline sites of 1 and more by one, so that a
    modification belongs to the ion that holds its residue. A peptide of fewer than two residues, or null, has none; a
    letter that is no residue gives null masses.
    """
    if site_mode == "corrected":
        mods = F.transform(mods, lambda m: F.struct(F.when(m["site"] > 0, m["site"] - 1).otherwise(m["site"]).alias("site"), m["unimod_id"].alias("unimod_id")))
    heavy = {"SILAC": {"K": SILAC_K, "R": SILAC_R}, "CHEAVY": {r: x[1] * HEAVY_C for r, x in RESIDUES.items()}, "NHEAVY": {r: x[2] * HEAVY_N for r, x in RESIDUES.items()}}[label]
    mass, shift = _lookup({r: x[0] for r, x in RESIDUES.items()}), _lookup(heavy)
    n = F.length(sequence)
    # Each residue is looked up once; the ions are running sums from either end.
    residues = F.transform(F.split(sequence, ""), lambda r: F.struct(F.try_element_at(mass, r).alias("m"), F.coalesce(F.try_element_at(shift, r), F.lit(0.0)).alias("s")))
    sums = "array<struct<m:double,s:double>>"
    zero = F.array(F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))).cast(sums)
    running = lambda rs: F.aggregate(rs, zero, lambda acc, r: F.concat(acc, F.array(let(F.element_at(acc, -1), lambda t: F.struct((t["m"] + r["m"]).alias("m"), (t["s"] + r["s"]).alias("s")))).cast(sums)))

    def ion(kind: str, i: Column, part: Column, extra: Column) -> Column:
        light = part["m"] + extra
        return F.struct(F.lit(kind).alias("ion_type"), i.cast("int").alias("ion_num"), light.alias("light"), (light + part["s"]).alias("heavy"))

    def ions(residues: Column) -> Column:
        steps = F.sequence(F.lit(1), n - 1)
        b = let(running(residues), lambda sums: F.transform(steps, lambda i: ion("b", i, F.get(sums, i), mod_mass(mods, i - 1))))
        y = let(running(F.reverse(residues)), lambda sums: F.transform(steps, lambda i: ion("y", i, F.get(sums, i), F.lit(WATER) + mod_mass(mods, n) - mod_mass(mods, n - i - 1))))
        return F.concat(b, y)

    none = F.array().cast("array<struct<ion_type:string,ion_num:int,light:double,heavy:double>>")
    return F.when(n >= 2, let(residues, ions)).otherwise(none)
