"""Command line: ``python -m isotwin.cli --configpath config.ini --logpath run.log``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from isotwin.config import read_job
from isotwin.plans.pair_flow import pair_features
from isotwin.sources.mzml import read_mzml
from isotwin.sources.reports import read_psms
from isotwin.sources.sinks import write_features


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--configpath", default="./config.ini")
    parser.add_argument("--logpath", default="./run.log")
    args = parser.parse_args(argv)
    logging.basicConfig(filename=args.logpath, level=logging.INFO)
    job = read_job(args.configpath)
    spark = SparkSession.builder.appName("isotwin").getOrCreate()
    features = pair_features(read_psms(spark, job.report, job.engine), read_mzml(spark, job.raw_paths), job.tolerance_ppm, job.half_width, job.site_mode, job.label)
    write_features(features, job.result)
    logging.info("wrote %s", job.result)


if __name__ == "__main__":
    main()
