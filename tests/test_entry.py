"""The driver's entry, with and without the optional subpackage; every query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_survives_without_the_optional_parts(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/corpusflow", tmp_path / "corpusflow", ignore=lambda d, names: ["llm", "__pycache__"] if d.endswith("corpusflow") else ["__pycache__"])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def _names():
    sys.path.insert(0, ROOT)
    from corpusflow.registry import SQL

    return sorted(SQL)


def _rows(df):
    cell = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else v
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from corpusflow.registry import QUERIES, SQL

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_streaming_and_merging_queries(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    from corpusflow.registry import QUERIES

    assert QUERIES["q_bpe_ids"](spark, DATA).count() == 200
    assert QUERIES["q_stream_buckets"](spark, DATA).count() > 0
