"""Every registered query of the library against its DuckDB counterpart, on the smallest tables."""

import os

import duckdb
import pytest

from quillspark import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df):
    df = df[sorted(df.columns)]
    fix = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(fix, r))) for r in df.astype(object).where(df.notna(), None).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, name):
    got = own.QUERIES[name](spark, DATA).toPandas()
    if name not in own.ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    want = con.execute(own.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry_survives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sql_join' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_stream(spark, tmp_path):
    from quillspark.operators import governance
    from quillspark.streaming import log_stream

    rows = spark.sql("select '1' as id, 'query' as kind, timestamp'2024-01-01 00:01:00' as created union all select '2', 'query', timestamp'2024-01-01 00:02:00'")
    governance.append_evidence(rows, str(tmp_path / "log"))
    q = log_stream.counts(log_stream.read(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["kind"], r["n"]) for r in spark.sql("select * from counts").collect()] == [("query", 2)]
