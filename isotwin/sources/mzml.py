"""mzML files as spectrum frames: Spark's XML source with an explicit schema, peaks decoded in Arrow batches."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotwin.functions.times import let

_PARAMS = "cvParam array<struct<_accession:string,_name:string,_value:string,_unitName:string>>"
SCHEMA = f"""_index string, _id string, {_PARAMS},
scanList struct<scan:array<struct<{_PARAMS.replace('cvParam ', 'cvParam:')}>>>,
precursorList struct<precursor:array<struct<_spectrumRef:string,
  isolationWindow:struct<{_PARAMS.replace('cvParam ', 'cvParam:')}>,
  selectedIonList:struct<selectedIon:array<struct<{_PARAMS.replace('cvParam ', 'cvParam:')}>>>>>>,
binaryDataArrayList struct<binaryDataArray:array<struct<{_PARAMS.replace('cvParam ', 'cvParam:')},binary:string>>>"""


def _value(params: Column, name: str) -> Column:
    return F.get(F.filter(params, lambda p: p["_name"] == name), F.lit(0))["_value"]


def _has(params: Column, name: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_name"] == name), F.lit(False))


def scan_number(text: Column) -> Column:
    """The number in ``scan=N``; a text without one is an error."""
    n = F.regexp_extract(text, r"scan=(\d+)", 1)
    return F.when(n == "", F.raise_error(F.concat(F.lit("no scan number in: "), text))).otherwise(n).cast("int")


def decoded(data: Column, wide: Column, packed: Column) -> Column:
    """Base64 peaks, of 64 or 32 bits, zlib-packed or not, as ``array<float>``; null gives an empty array."""

    def decode(texts: pd.Series, wides: pd.Series, packs: pd.Series) -> pd.Series:
        out = []
        for t, w, p in zip(texts, wides, packs):
            raw = base64.b64decode(t) if t else b""
            raw = zlib.decompress(raw) if p and raw else raw
            out.append(np.frombuffer(raw, "<f8" if w else "<f4").astype(np.float32))
        return pd.Series(out)

    return F.pandas_udf(decode, "array<float>")(data, wide, packed)


def read_mzml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The spectra of mzML files: one row each, ``raw_title`` the file's name without its last extension.

    Of several precursors and selected ions the first counts; a spectrum without a precursor has ``precursor_scan_id`` -1, which marks
    it as MS1, and null bounds. The window lies around the selected ion. A missing time is 0. Files are read in parallel, large
    ones in splits.
    """
    df = spark.read.format("xml").option("rowTag", "spectrum").schema(SCHEMA).load(paths).withColumn("_file", F.col("_metadata.file_name"))
    scan = F.get("scanList.scan", F.lit(0))["cvParam"]
    first = F.get("precursorList.precursor", F.lit(0))
    ion = F.get(first["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]
    window = first["isolationWindow"]["cvParam"]
    center = _value(ion, "selected ion m/z").cast("double")
    arrays = F.col("binaryDataArrayList.binaryDataArray")

    def peaks(name: str) -> Column:
        a = F.get(F.filter(arrays, lambda x: _has(x["cvParam"], name)), F.lit(0))
        return decoded(a["binary"], _has(a["cvParam"], "64-bit float"), _has(a["cvParam"], "zlib compression"))

    parent = F.when(first.isNull(), F.lit(-1).cast("bigint")).otherwise(scan_number(first["_spectrumRef"]).cast("bigint"))
    return df.select(
        let(F.col("_file"), lambda f: F.regexp_replace(F.url_decode(f), r"(?<=.)\.[^.]*$", "")).alias("raw_title"),
        F.col("_index").cast("int").alias("spec_idx"),
        scan_number(F.col("_id")).alias("scan_id"),
        parent.alias("precursor_scan_id"),
        F.coalesce(_value(scan, "scan start time").cast("float"), F.lit(0.0).cast("float")).alias("rt"),
        (center - _value(window, "isolation window lower offset").cast("double")).cast("float").alias("iso_lower"),
        (center + _value(window, "isolation window upper offset").cast("double")).cast("float").alias("iso_upper"),
        peaks("m/z array").alias("mz"),
        peaks("intensity array").alias("intensity"),
    )
