"""Several values packed in one field: one row per value, with its place.

Method: every field is reduced to its *delimiter skeleton* (quoted stretches and ordinary characters masked, repeats
collapsed). A splitting rule is resolved once per distinct skeleton, the rules are joined back, and the values come out by
positional extraction with the rule's pattern. Masking and extraction run inside the JVM; Python sees skeletons only.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotwin.functions.times import let
from isotwin.session import col, cut

#: Characters that separate values, strongest first; blanks separate only where none of these does.
SEPARATORS = (";", "|", ",", "/")
#: Brackets that may stand around a whole field.
BRACKETS = {"[": "]", "{": "}"}
#: Most distinct skeletons that are broadcast; beyond it the rules are joined by a shuffle.
BROADCAST_RULES = 50_000

_DOUBLE = r'"(?:[^"]|"")*"'
_SINGLE = r"'(?:[^']|'')*'"
_ENDS = r"(?=[;|,/\]}]|\s|$)"
_STARTS = r"(^|[;|,/\[{]|\s)"
_RULE_TYPE = "sep string, opened string, closed string, pattern string"


def _trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\n\u000b\f\r"))


def skeleton(value: Column) -> Column:
    """The delimiter skeleton: ``a`` for a plain value, ``q`` for a quoted one, separators, blanks and brackets as they are.

    A repeated stretch is written once, so the number of skeletons depends on the habits of writing, not on the rows. A text that
    holds nothing but a plain value costs one look, and quotes and brackets cost only where there are any.
    """
    quoted = value.contains('"') | value.contains("'")
    s = F.when(quoted, F.regexp_replace(F.regexp_replace(value, _STARTS + _DOUBLE + _ENDS, "$1\u0001"), _STARTS + _SINGLE + _ENDS, "$1\u0001")).otherwise(value)
    s = F.regexp_replace(s, r"[^\u0001;|,/\s\[\]{}]+", "a")
    s = let(s, lambda x: F.when(x.rlike(r"[\[\]{}]"), F.regexp_replace(x, r"a[\[\]{}]+a", "a")).otherwise(x))
    s = F.regexp_replace(F.translate(s, "\u0001", "q"), r"[^\S\t]+", " ")
    for _ in range(2):
        s = F.regexp_replace(s, r"([aq][;|,/\s]+)\1+", "$1")
    return F.when(value.rlike(r"""[;|,/\s"'\[\]{}]"""), s).otherwise(F.lit("a"))


def _rule(shape: str) -> tuple[str, str, str, str]:
    """Separators (as the inside of a character class), brackets and extraction pattern for a skeleton."""
    bare, opened, closed = shape.strip(), "", ""
    if len(bare) > 1 and BRACKETS.get(bare[0]) == bare[-1]:
        opened, closed, bare = bare[0], bare[-1], bare[1:-1].strip()
    found = [c for c in SEPARATORS if c in bare]
    if not found and "\t" in bare:
        found = ["\t"]
    if found:
        sep = "".join(found)
        one = "[" + re.escape(sep) + "]"
    elif " " in bare:
        sep, one = " ", r"\s+"
    else:
        sep, one = "", ""
    if not sep:
        return sep, opened, closed, ""
    plain = rf"[^{re.escape(sep)}]*?" if sep != " " else r"\S*"
    tail = rf"(?=\s*{one}|\s*$)"
    return sep, opened, closed, rf"{one}\s*({_DOUBLE}{tail}|{_SINGLE}{tail}|{plain}{tail})"


def resolve(shapes: pd.Series) -> pd.DataFrame:
    """The splitting rule of each distinct skeleton."""
    return pd.DataFrame([_rule(s) for s in shapes], columns=["sep", "opened", "closed", "pattern"])


def _unquoted(value: Column) -> Column:
    """``value`` without blanks and quotes around it, a doubled quote within written once."""

    def bare(v: Column) -> Column:
        out = v
        for q in ('"', "'"):
            inner = F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit(q * 2), F.lit(q))
            out = F.when(v.startswith(q) & v.rlike(f"(?s)^{q}(?:[^{q}]|{q}{q})*{q}$"), _trimmed(inner)).otherwise(out)
        return out

    return let(_trimmed(value), bare)


def split_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Split ``fields`` of ``df`` into one row per non-empty value.

    Returns ``keys`` and ``field_name string, pos bigint, val string``: ``pos`` counts from 1 and counts empty places.
    Text within quotes is one value; brackets around a whole field belong to no value; ``: - . @ ^ > _ ( )`` never
    separate. A null, empty or blank field, and one of separators only, gives no row. Repeated rows of ``df`` give
    repeated results. Texts of any length are split whole. Other columns of ``df`` are left out, so none can clash; a key
    may not be called ``field_name``, ``pos`` or ``val``.

    Scale: one pass over the three columns; the only shuffle is the distinct over skeletons, combined before it, so a
    skeleton that holds a third of all rows costs one row per task. The rules are broadcast if at most
    ``BROADCAST_RULES``, counted, and joined by a shuffle otherwise.
    """
    long = df.select(*[col(k) for k in keys], F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), _trimmed(col(f)).alias("raw")) for f in fields])).alias("_f")).select(*[col(k) for k in keys], "_f.*").where("raw <> ''").withColumn("shape", skeleton(F.col("raw")))
    shapes = long.select("shape").distinct()
    rules = cut(shapes.withColumn("rule", F.pandas_udf(resolve, _RULE_TYPE)("shape")).select("shape", "rule.*"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    # There are as many patterns as sets of separators, whatever the rows; as literals each is compiled once.
    patterns = {r["sep"]: r["pattern"] for r in rules.select("sep", "pattern").distinct().collect() if r["sep"]}
    ruled = long.join(F.broadcast(rules) if few else rules, "shape")
    ruled = ruled.withColumn("body", F.when(F.col("opened") != "", _trimmed(F.substring("raw", F.lit(2), F.length("raw") - 2))).otherwise(F.col("raw")))
    body, quoted = F.col("body"), F.col("raw").contains('"') | F.col("raw").contains("'")
    values = F.array(body)
    for sep, pattern in sorted(patterns.items()):
        parted = F.split(body, r"\s+" if sep == " " else "[" + re.escape(sep) + "]")
        values = F.when(F.col("sep") == sep, F.when(quoted, F.regexp_extract_all(F.concat(F.lit(sep[0]), body), F.lit(pattern), F.lit(1))).otherwise(parted)).otherwise(values)
    out = ruled.select(*[col(k) for k in keys], "field_name", F.posexplode(values).alias("place", "part"))
    return out.select(*[col(k) for k in keys], "field_name", (F.col("place") + 1).cast("bigint").alias("pos"), _unquoted(F.col("part")).alias("val")).where("val <> ''")
