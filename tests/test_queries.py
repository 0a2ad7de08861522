"""Every query of the trace engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomspan.plans import queries as traces

from conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(traces.queries()))
def test_query_matches_sql(spark, duck, name):
    got = traces.queries()[name](spark, SMALL)
    sql = traces.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = duck.execute(sql)
    names = [x[0] for x in want.description]
    columns = sorted(names)
    assert sorted(got.columns) == columns
    at = [names.index(c) for c in columns]
    text = lambda row: tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in row)
    assert sorted(text(r) for r in got.select(*columns).collect()) == sorted(text([r[i] for i in at]) for r in want.fetchall())


def test_entry_has_rows_and_a_stable_schema(spark):
    events = entry.entry(spark)
    assert events.count() > 0
    assert entry.entry(spark).schema == events.schema


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_trim_takes_whole_texts_and_their_own_white_space(spark, tmp_path):
    texts = ["x" * 50 + " \u2003\u00a0\n", "\u3000\x0b" + "long text " * 20 + "\x85", " \t ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.chars for r in traces.queries()["fn_trim"](spark, str(tmp_path)).collect()}
    assert got == {0: 50, 1: 199, 2: 0, 3: 0, 4: None}
    want = duckdb.sql(traces.oracle_sql()["fn_trim"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    assert {r[0]: r[1] for r in want.select("doc_id, chars").fetchall()} == got
