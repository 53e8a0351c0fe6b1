import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_check import compare, views  # noqa: E402

from lexweave.llm import queries  # noqa: E402

COLUMNS = {
    "p1_found": {"chunk_id", "field_name"}, "p3_found": {"conversation_id"}, "p5_found": {"chunk_id_a", "chunk_id_b"}, "p6_found": {"raw_artifact_path", "line_no"},
    "p7_found": {"table_name", "record_key"}, "p8_found": {"doc_id", "item_id"}, "p9_found": {"source"}, "p10_found": {"doc_id", "kind"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
    if name in queries.SQL:
        compare(views(data), queries.SQL[name], df)
    else:
        n = df.count()
        assert n >= 0
        if name in COLUMNS:
            assert n == df.distinct().count()
