import os

import pytest

from orrery.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
FOUND = {"p1_found": ["src", "row_key"], "p2_found": ["claim_id", "model_id"], "p4_found": ["rid"], "p5_found": ["claim_id", "canon_field"], "p6_found": ["row_id_a", "row_id_b"], "p10_found": ["doc_id", "start_pos"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name] and len(rows) == len(set(rows))
