"""The package's queries: rows of the SQL where there is one, else the stated columns and invariants."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

OWN = [q for q in sorted(entry.queries()) if entry.queries()[q].__module__.startswith("sievework.llm")]


@pytest.mark.parametrize("name", [q for q in OWN if q in entry.oracle_sql()])
def test_same_rows_as_sql(spark, data, name):
    assert differences(entry.queries()[name](spark, data), connect(data), entry.oracle_sql()[name]) == ([], [])


COLUMNS = {"p3_found": ["res_id", "ref_id"], "p4_found": ["src", "term", "mark"], "p5_found": ["src", "first_id", "copy_id"], "p7_ids": ["doc_id", "ids"], "p8_containers": ["doc_id", "part", "start", "size", "container_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", [q for q in OWN if q not in entry.oracle_sql()])
def test_columns_and_distinct_rows(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [repr(r) for r in df.collect()]
    assert rows and (not name.endswith("_found") or len(rows) == len(set(rows)))


def test_one_row_per_document(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert entry.queries()["p7_ids"](spark, data).count() == n
