"""Compare a query's rows with those of its SQL over the same Parquet files."""

import math
from pathlib import Path

import duckdb

FOLDER = Path("/root/testdata/sf0.001")


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 7) + 0.0
    return str(value)


def same_rows(query, sql, spark):
    got = query(spark, str(FOLDER))
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = [tuple(plain(dict(zip(names, row))[c]) for c in order) for row in result.fetchall()]
    have = [tuple(plain(row[c]) for c in order) for row in got.collect()]
    key = lambda row: [(x is not None, str(type(x)), x) for x in row]
    assert len(have) == len(want)
    for a, b in zip(sorted(have, key=key), sorted(want, key=key)):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)
