import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ["PYSPARK_PYTHON"] = sys.executable

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from meridia.session import build_session

    session = build_session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{sf}/{name}.parquet')")
    return con


def same_rows(df, sql: str, sf: str) -> None:
    """The query's rows are the SQL's, columns by name, order aside."""
    got = df.collect()
    columns = sorted(df.columns)
    found = duck(sf).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    rows = found.fetchall()
    ours = sorted(repr([r[c] for c in columns]) for r in got)
    theirs = sorted(repr([r[names.index(c)] for c in columns]) for r in rows)
    assert ours == theirs
