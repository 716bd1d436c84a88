"""Steps that must not shuffle or work more than their rows need, and requests with unknown seeds."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from cadenza.operators.artists import artist_training_features  # noqa: E402
from cadenza.operators.genres import genre_tokens  # noqa: E402
from cadenza.sources.catalog import _linked_groups, _view, fixture_catalog  # noqa: E402
from cadenza.sources.fixtures import VIEWS  # noqa: E402
from conftest import SF_SMALL  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def odd_tables(tmp_path):
    """sf0.001 with lines and orders that share keys, lines without a part, and null keys."""
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        t = f.split(".")[0]
        src = f"select * from '{SF_SMALL}/{f}'"
        if t == "lineitem":
            src = (f"{src} union all (select * replace (l_suppkey % 5 as l_suppkey, -1 as l_partkey) "
                   f"from '{SF_SMALL}/{f}' where l_orderkey % 3 = 0) union all (select * replace "
                   f"(null as l_linenumber) from '{SF_SMALL}/{f}' where l_orderkey % 7 = 0) union all "
                   f"(select * replace (null as l_partkey, 7 as l_suppkey) from '{SF_SMALL}/{f}' where l_orderkey % 11 = 0)")
        if t == "orders":
            src = (f"{src} union all (select * replace (o_custkey + 1 as o_custkey) from '{SF_SMALL}/{f}' "
                   f"where o_orderkey % 4 = 0) union all (select * replace (null as o_custkey) from "
                   f"'{SF_SMALL}/{f}' where o_orderkey % 9 = 0) union all (select * replace "
                   f"(null as o_orderpriority) from '{SF_SMALL}/{f}' where o_orderkey % 10 = 0)")
        con.execute(f"copy ({src}) to '{tmp_path}/{f}' (format parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("view", ["lt", "release_group", "l_artist_release_group"])
def test_views_that_spark_plans_have_the_rows_of_their_text(spark, odd_tables, view):
    cat = fixture_catalog(spark, odd_tables, f"{odd_tables}/views")
    want = _view(spark, cat, VIEWS[view])
    got = cat[view].select(*want.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()


def test_links_read_no_line_twice(spark, tmp_path):
    cat = fixture_catalog(spark, SF_SMALL, str(tmp_path))
    assert "lineitem.parquet" not in plan(_linked_groups(spark, cat))


def test_release_groups_are_told_apart_by_their_keys(spark):
    shuffled = [x for x in plan(fixture_catalog(spark, SF_SMALL)["release_group"]).split("\n") if "Exchange" in x]
    assert shuffled and not any("gid" in x or "name" in x for x in shuffled)


def test_a_genre_is_cut_once_for_the_list(spark, tmp_path):
    feats = artist_training_features(fixture_catalog(spark, SF_SMALL, str(tmp_path)))
    assert "regexp_replace" not in plan(feats) and "SortAggregate" not in plan(feats)


def test_genre_tokens_of_spellings_spaces_and_null_keys(spark):
    rows = [(1, "b rock"), (1, "B Rock"), (1, " B Rock "), (1, "a pop"), (1, "!!"), (1, None), (1, "b rock"),
            (2, "Zed"), (2, "zed"), (None, "a pop"), (3, " "), (4, "b-rock"), (4, "B Rock")]
    got = genre_tokens(spark.createDataFrame(rows, "id long, genre string"))
    assert {r["id"]: r["tokens"] for r in got.collect()} == {
        1: ["b_rock", "a_pop"], 2: ["zed"], None: ["a_pop"], 4: ["b_rock", "b_rock"]}


@pytest.mark.parametrize("gone", [[0], [0, 1, 2]])
def test_album_cards_with_seeds_that_the_tables_do_not_hold(spark, tmp_path, gone):
    """Request, enrichment and digest where the tables hold the seeds in part or not at all."""
    import __spark_entry__ as E
    from oracle_check import rows_key
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        where = f"where o_custkey not in ({', '.join(map(str, gone))})" if f == "orders.parquet" else ""
        con.execute(f"copy (select * from '{SF_SMALL}/{f}' {where}) to '{tmp_path}/{f}' (format parquet)")
        con.execute(f"create view {f.split('.')[0]} as select * from '{tmp_path}/{f}'")
    for name in ("k5_album_knn", "k5_album_knn_genre_filter", "q8_album_recommendations", "s10_album_digest"):
        df = E.queries()[name](spark, str(tmp_path))
        res = con.execute(E.oracle_sql()[name])
        assert rows_key([tuple(r) for r in df.collect()], df.columns) == rows_key(
            res.fetchall(), [d[0] for d in res.description]), name
