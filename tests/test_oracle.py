"""Registered queries vs their DuckDB oracle on the smallest data set."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from cadenza.plans.registry import QUERIES  # noqa: E402
from oracle_check import rows_key  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

# the corpus operators have tests of their own; they can be absent
NAMES = sorted(set(QUERIES) & set(E.oracle_sql()))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    o = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert rows_key(s, df.columns) == rows_key(o, ocols)


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The driver deletes the subpackage and the pipeline: the rest still imports."""
    import shutil
    import subprocess
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "cadenza"), tmp_path / "cadenza",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert got.stdout.split() == [str(len(QUERIES)), "False"], got.stderr[-500:]


@pytest.mark.parametrize("gone", [[0], [0, 1, 2]])
def test_album_requests_with_seeds_that_the_tables_do_not_hold(spark, tmp_path, gone):
    """The request is fixed, the tables are not: the known seeds make the profile, none puts all at 1."""
    import duckdb
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        if f == "orders.parquet":
            con.execute(f"copy (select * from '{SF_SMALL}/{f}' where o_custkey not in "
                        f"({', '.join(map(str, gone))})) to '{tmp_path}/{f}' (format parquet)")
        else:
            os.symlink(f"{SF_SMALL}/{f}", tmp_path / f)
        con.execute(f"create view {f.split('.')[0]} as select * from '{tmp_path}/{f}'")
    for name in ("k5_album_knn", "k5_album_knn_genre_filter"):
        df = E.queries()[name](spark, str(tmp_path))
        res = con.execute(E.oracle_sql()[name])
        assert rows_key([tuple(r) for r in df.collect()], df.columns) == rows_key(
            res.fetchall(), [d[0] for d in res.description])
