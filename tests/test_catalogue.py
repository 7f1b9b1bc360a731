"""Every core query that has SQL gives the rows of its SQL; the others run and name their columns once."""

import pytest
from sqlcheck import FOLDER, same_rows

from isotwin.plans import catalogue, reports

QUERIES, SQL = {**catalogue.QUERIES, **reports.QUERIES}, {**catalogue.SQL, **reports.SQL}
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same_rows(QUERIES[name], SQL[name], spark)


def test_schema_changes_of_the_deliveries(spark):
    rows = {tuple(r) for r in reports.p1_found(spark, str(FOLDER)).collect()}
    assert len(rows) == 23
    assert ("report_w2", "report_w3", "renamed", "Run", "run") in rows and ("report_w3", "report_w4", "retyped", "precursor.charge", "charge") in rows and ("report_w2", "report_w3", "removed", "q_value", "") in rows


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert len(set(out.columns)) == len(out.columns) == 26 and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_order_is_looked_up(spark):
    """Against brute force; the dearest orders, which no price is near, have their row too."""
    import numpy as np

    orders, lines = (spark.read.parquet(f"{FOLDER}/{t}.parquet").toPandas() for t in ("orders", "lineitem"))
    got = catalogue.ppm_match_all(spark, str(FOLDER)).toPandas().set_index("probe_id")
    assert len(got) == len(orders) and got.index.is_unique
    prices, counts = lines.l_extendedprice.to_numpy(float), lines.l_quantity.to_numpy(float)
    for key, theory in zip(orders.o_orderkey, orders.o_totalprice.astype(float)):
        error = (prices - theory) / theory * 1e6
        near = np.abs(error) <= 10
        row = got.loc[key]
        assert row.n == near.sum() and abs(row.intensity - counts[near].sum()) < 1e-6
        assert np.isnan(row.ppm_error) if not near.any() else abs(row.ppm_error - error[near].mean()) < 2e-5


def test_links_alone_find_the_hidden_units(spark):
    rows = reports.p4_linked(spark, str(FOLDER.parent / "sf0.01")).collect()
    stated, found = sum(r["n_stated"] for r in rows), sum(r["n_found"] for r in rows)
    assert stated > 500 and found >= 0.95 * stated
