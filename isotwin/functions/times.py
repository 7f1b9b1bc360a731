"""Times and runs written in many ways, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes in one of each unit.
MINUTES = {"ms": 1 / 60000, "s": 1 / 60, "min": 1.0, "h": 60.0}
#: How the units are spelled (whole words, any case), in English, German and French.
SPELLINGS = {
    "ms": r"ms|msecs?|millis(?:ec(?:ond)?s?)?|milliseconds?|millisek(?:unden?)?|millisecondes?",
    "s": r"s|secs?|seconds?|sek(?:unden?)?|secondes?",
    "min": r"m|mins?|minutes?|minuten?",
    "h": r"h|hrs?|hours?|std|stunden?|dezimalstunden?|heures?",
}
#: File-name endings that are no part of a run's name.
RUN_ENDINGS = r"(?i)\.(?:raw|mzml|mzxml|wiff|d|dia|htrms|gz|parquet|txt|tsv|csv)$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_stem(name: Column) -> Column:
    """The run's name in a path or file name; null stays null. Dots that belong to the run's name are kept."""
    s = F.regexp_replace(F.trim(name), r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(s, RUN_ENDINGS, ""), RUN_ENDINGS, "")


def unit_of(text: Column) -> Column:
    """``ms``, ``s``, ``min`` or ``h`` for a unit spelled freely, null for anything else."""

    def named(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for unit, words in SPELLINGS.items():
            out = F.when(t.rlike(f"^(?:{words})$"), F.lit(unit)).otherwise(out)
        return out

    return let(F.regexp_replace(F.lower(F.trim(text)), r"^[\[(\s]+|[\])\s.]+$", ""), named)


def number(text: Column) -> Column:
    """A number with blanks between digits and a point or comma, else null."""
    t = F.regexp_replace(text, r"(?<=\d)[\s '](?=\d)", "")
    return F.regexp_replace(t, ",", ".").try_cast("double")


def time_text(text: Column) -> Column:
    """A time in free text as ``struct<value double, unit string>``; ``unit`` is null where the text names none.

    Knows plain numbers, numbers with a unit (blanks in or a comma for a point allowed, ``rt=`` before), ``h:mm:ss`` and
    ``m:ss``, ``3 min 4.5 s`` and ISO 8601 (``PT3M4.5S``). Null or unreadable text gives a null ``value``.
    """
    num = r"([+-]?\d[\d ' ]*(?:[.,]\d+)?(?:e[+-]?\d+)?)"
    one = rf"^{num}\s*(?:\[|\()?([a-z]*)\.?(?:\]|\))?$"
    clock3, clock2 = r"^(\d+):(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)$", r"^(\d+):(\d{1,2}(?:[.,]\d+)?)$"
    iso = r"^pt(?=\d)(?:([\d.,]+)h)?(?:([\d.,]+)m)?(?:([\d.,]+)s)?$"
    words = rf"^(?=\d)(?:([\d.,]+)\s*(?:{SPELLINGS['h']})\.?)?\s*(?:([\d.,]+)\s*(?:{SPELLINGS['min']})\.?)?\s*(?:([\d.,]+)\s*(?:{SPELLINGS['s']})\.?)?$"
    pair = lambda v, u: F.struct(v.cast("double").alias("value"), u.cast("string").alias("unit"))
    none = pair(F.lit(None), F.lit(None))

    def read(t: Column) -> Column:
        part = lambda pattern, i: F.coalesce(number(F.regexp_extract(t, pattern, i)), F.lit(0.0))
        seconds = lambda p: pair(part(p, 1) * 3600 + part(p, 2) * 60 + part(p, 3), F.lit("s"))
        word = F.regexp_extract(t, one, 2)
        return (
            F.when(t.isNull(), none)
            .when(t.rlike(one), let(unit_of(word), lambda u: F.when((word == "") | u.isNotNull(), pair(number(F.regexp_extract(t, one, 1)), u)).otherwise(none)))
            .when(t.rlike(clock3), seconds(clock3))
            .when(t.rlike(clock2), pair(part(clock2, 1) * 60 + part(clock2, 2), F.lit("s")))
            .when(t.rlike(iso), seconds(iso))
            .when(t.rlike(words), seconds(words))
            .otherwise(none)
        )

    return let(F.regexp_replace(F.lower(F.trim(text)), r"^[a-z_. ]*[=:]\s*", ""), read)


def minutes(value: Column, unit: Column) -> Column:
    """``value`` of ``unit`` in minutes; null if either is null."""
    out = F.lit(None).cast("double")
    for name, factor in MINUTES.items():
        out = F.when(unit == name, value * factor if factor >= 1 else value / round(1 / factor)).otherwise(out)
    return out
