import pytest
from sqlcheck import FOLDER, same_rows

from isotwin.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same_rows(QUERIES[name], SQL[name], spark)


def test_found_cases_have_their_columns(spark):
    columns = {"p2_found": ["feature_id", "peptide"], "p5_found": ["psm_id", "scan_id"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "pii_kind", "line_no"]}
    for name, want in columns.items():
        out = QUERIES[name](spark, str(FOLDER))
        assert out.columns == want and out.count() == out.distinct().count() > 0


def test_no_peptide_or_protein_crosses_splits(spark):
    rows = QUERIES["p2_two_keys"](spark, str(FOLDER)).collect()
    assert len(rows) == 3 and all(r["n_peptides_elsewhere"] == 0 and r["n_proteins_elsewhere"] == 0 for r in rows)
    assert sum(r["n_rows"] for r in rows) > 300
