"""Every query over training text: those with SQL against it, the others on the smallest tables."""

import os

import duckdb
import pytest

from loomspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plain(v):
    return round(v, 5) if isinstance(v, float) else int(v) if isinstance(v, (bool, int)) else v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert len(rows) == len(set(map(str, rows)))
    if name in ORACLES:
        con = duckdb.connect()
        for t in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        order = lambda data, columns: sorted(str([plain(r[columns.index(c)]) for c in sorted(names)]) for r in data)
        assert order(rows, df.columns) == order(result.fetchall(), names)


@pytest.mark.parametrize("name, columns", [("p2_found", {"first_id": "bigint", "copy_id": "bigint"}), ("p3_found", {"repair_id": "bigint"}), ("p4_found", {"repair_id": "bigint", "field": "string"}), ("p5_found", {"repair_id": "bigint", "defect": "string"}), ("p6_ids", {"doc_id": "bigint", "ids": "array<int>"}), ("p7_found", {"doc_id": "bigint", "task_id": "string"}), ("p8_found", {"doc_id": "bigint", "subject": "string"})])
def test_columns(spark, name, columns):
    assert {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, FOLDER).schema} == columns
