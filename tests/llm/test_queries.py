"""Every registered query of the subpackage over the smallest tables."""

import os

import pytest

from rolloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": "id_a id_b", "p2_found": "tbl rec_id", "p3_found": "id_a id_b", "p4_found": "tbl rec_id defect", "p5_found": "tbl first_id copy_id", "p6_ids": "doc_id ids", "p7_found": "doc_id item_id", "p8_found": "doc_id subject",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    assert len({str(r) for r in rows}) == len(rows)


def test_all_found_queries_are_registered():
    import __spark_entry__

    assert set(COLUMNS) <= set(QUERIES) <= set(__spark_entry__.queries())
