import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over one folder of tables and asserts that the rows are the same."""
    import duckdb

    def norm(v):
        if isinstance(v, float):
            return repr(round(v, 9))
        if isinstance(v, (list, tuple)):
            return str([norm(x) for x in v])
        return v if v is None else str(v)

    def of(query, sql, folder):
        df = query(spark, folder)
        names = sorted(df.columns)
        got = sorted((tuple(norm(v) for v in r) for r in df.select(*names).collect()), key=str)
        c = duckdb.connect()
        c.execute("SET TimeZone = 'UTC'")
        for f in os.listdir(folder):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
        r = c.execute(sql)
        cols = [d[0] for d in r.description]
        assert names == sorted(cols)
        at = [cols.index(n) for n in names]
        assert got == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=str)

    return of
