import pytest

from quillmesh.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_equals_sql(compare, name):
    compare(name)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_runs(spark, data_dir, name):
    queries.QUERIES[name](spark, data_dir).limit(5).collect()
