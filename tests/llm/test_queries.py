"""The queries on the smallest data: columns, and rows once each."""

import os

import pytest

from stichos.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"id": "string", "seg_no": "int", "lang_code": "string"},
    "p2_found": {"id": "string", "test_id": "string"},
    "p3_found": {"table_name": "string", "rec_key": "string"},
    "p5_found": {"case_id": "bigint", "id": "string"},
    "p6_found": {"file_a": "string", "file_b": "string"},
    "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", COLUMNS)
def test_found(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert dict(df.dtypes) == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    assert rows
    assert len(set(rows)) == len(rows)
    assert all(x is not None for r in rows for x in r)
