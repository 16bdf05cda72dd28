import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillmesh.session import build_session

    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


@pytest.fixture(scope="session")
def compare(spark, data_dir):
    """Runs a query and its SQL over the same tables and compares their rows."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in os.listdir(data_dir):
        con.sql(f"create view {name[:-8]} as select * from '{data_dir}/{name}'")
    queries, texts = entry.queries(), entry.oracle_sql()

    def cell(value):
        if value is None or value != value:
            return None
        return f"{value:.6g}" if isinstance(value, float) else str(value)

    def check(name):
        df = queries[name](spark, data_dir)
        names = sorted(df.columns)
        ours = sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=str)
        sql = con.sql(texts[name])
        at = [sql.columns.index(c) for c in names]
        theirs = sorted((tuple(cell(r[i]) for i in at) for r in sql.fetchall()), key=str)
        assert names == sorted(sql.columns)
        assert ours == theirs

    return check
