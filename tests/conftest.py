import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory() as shared:
        s = (
            SparkSession.builder.master("local[8]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "6g")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", f"file://{shared}")
            .getOrCreate()
        )
        s.sparkContext.setLogLevel("ERROR")
        yield s
        s.stop()


TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(TESTDATA):
        pytest.skip("the test tables aren't here")
    return TESTDATA


def held_against_sql(spark, sf_dir, run, sql):
    """Rows of a query and of its SQL in DuckDB, rounded and sorted, by column name."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS FROM '{sf_dir}/{t}'")
    show = lambda v: repr(round(float(v), 5) + 0.0) if isinstance(v, float) else repr(v)
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(show, r)) for r in df.select(*cols).collect())
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(show(r[names.index(c)]) for c in cols) for r in got.fetchall())
    return mine, theirs
