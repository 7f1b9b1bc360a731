"""Schemas of the frames that operators take and give."""

from pyspark.sql import types as T

MOD = T.StructType([T.StructField("site", T.IntegerType()), T.StructField("unimod_id", T.IntegerType())])
PSM = T.StructType([T.StructField("psm_id", T.LongType()), T.StructField("raw_title", T.StringType()), T.StructField("sequence", T.StringType()), T.StructField("charge", T.IntegerType()), T.StructField("precursor_mz", T.DoubleType()), T.StructField("rt", T.DoubleType()), T.StructField("mods", T.ArrayType(MOD)), T.StructField("protein_names", T.StringType())])
SPECTRUM = T.StructType([T.StructField("raw_title", T.StringType()), T.StructField("spec_idx", T.IntegerType()), T.StructField("scan_id", T.IntegerType()), T.StructField("precursor_scan_id", T.LongType()), T.StructField("rt", T.FloatType()), T.StructField("iso_lower", T.FloatType()), T.StructField("iso_upper", T.FloatType()), T.StructField("mz", T.ArrayType(T.FloatType())), T.StructField("intensity", T.ArrayType(T.FloatType()))])

#: The feature columns, in order.
FEATURE_COLUMNS = ["sequence", "charge", "precursor_mz", "raw_title", "protein_names", "sequence_len", "label", "precursor_pearson", "valid_fragment_ions_num", "b_count", "b_p25", "b_p50", "b_p75", "b_mean", "y_count", "y_p25", "y_p50", "y_p75", "y_mean", "all_count", "all_p25", "all_p50", "all_p75", "all_mean", "matched_intensity_percent"]
