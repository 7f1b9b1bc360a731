"""Job parameters from an INI file."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Job:
    """What a run needs: raw files, report and its engine, tolerance, trace half-width, result, heavy label, reading of sites."""

    raw_paths: list[str] = field(default_factory=list)
    report: str = ""
    engine: int = 1
    tolerance_ppm: float = 10.0
    half_width: int = 3
    result: str = "result.csv"
    label: str = "SILAC"
    site_mode: str = "reference"


def read_job(path: str) -> Job:
    """The job that an INI file with the sections ``input`` and ``general`` describes; a missing file or key is an error."""
    parser = configparser.ConfigParser()
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    parser.read(path)
    source, general = parser["input"], parser["general"] if parser.has_section("general") else {}
    value = lambda key, default=None: source.get(key, general.get(key, default))
    if value("mass_tol_ppm") is None:
        raise KeyError("mass_tol_ppm")
    n = int(value("raw_num", 1))
    return Job([value(f"raw_path_{i}") for i in range(1, n + 1) if value(f"raw_path_{i}")], value("light_result_file", ""), int(value("search_engine_type", 1)), float(value("mass_tol_ppm")), int(value("xic_cycle_window", 3)), value("result_file", "result.csv"), value("label", "SILAC"), value("site_mode", "reference"))
