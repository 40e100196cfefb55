"""Every query of the subpackage on the smallest tables: columns, types and distinct rows."""

import pytest

from citeloom.llm import queries

FOUND = {
    "p1_found": [("rec_kind", "string"), ("rec_id", "bigint"), ("start_pos", "bigint"), ("end_pos", "bigint")],
    "p2_found": [("rec_kind", "string"), ("rec_id", "bigint"), ("start_pos", "bigint"), ("end_pos", "bigint")],
    "p3_found": [("answer_id", "bigint"), ("defect_type", "string")],
    "p4_found": [("unit_id", "bigint"), ("cut_kind", "string")],
    "p5_found": [("atom_id", "string"), ("support_verdict", "string"), ("shortfall_type", "string")],
    "p6_found": [("unit_id", "bigint"), ("citation_id", "bigint")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in FOUND:
        assert df.dtypes == FOUND[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
