"""Queries with SQL on tables whose keys are larger than those of the given ones, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

from .test_differential import plain


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query equals its SQL over tables given as name=SQL of their rows."""

    def check(name, **tables):
        c = duckdb.connect()
        for t, sql in tables.items():
            c.sql(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
            c.sql(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = entry.queries()[name](spark, f"file://{tmp_path}")
        cols = sorted(df.columns)
        got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{x}`" for x in cols]).collect())
        want = c.sql(f"select {', '.join(f'"{x}"' for x in cols)} from ({entry.oracle_sql()[name]})").fetchall()
        assert got == sorted(tuple(plain(v) for v in r) for r in want)
        return got

    return check


def test_article_numbers_beyond_a_thousand_millions(same):
    got = dict(same("article_paths", orders="SELECT unnest([0, 5, 1003, 1003008, 1003010, 8999999]::BIGINT[]) AS o_orderkey"))
    assert got["PMC8972999003"] == "PMC897xxxxxx/PMC8972999003.xml" and got["PMC999991"] == "PMC000xxxxxx/PMC999991.xml"


def test_ids_that_parts_share_with_absent_ones(same):
    got = same("known_ids", part="SELECT unnest([0, 3, 4, 6, 7, 1000000, 1000002, 1000003, 1000005, 2000001]::BIGINT[]) AS p_partkey")
    assert len(got) == 20 and [a for a, _, i in got if i == "A1000005"] == ["confirmed"] and [a for a, _, i in got if i == "A1000003"] == ["absent", "absent"]


DOCUMENTS = "SELECT i AS doc_id, CASE WHEN i % 2 = 0 THEN 'plain words' END AS text FROM (SELECT unnest([0, 5, 99998, 99999, 100000, 100284, 999998, 1000000, 1002846, 12345678]::BIGINT[]) AS i)"


@pytest.mark.parametrize("name", ["regex_extract", "flagship", "streamed_usage"])
def test_numbers_longer_than_their_accessions(same, name):
    assert not any("PF10028" in x for x in same(name, documents=DOCUMENTS))


@pytest.mark.parametrize("name", ["usage_by_sketches", "shared_documents"])
def test_more_documents_than_a_sketch_holds(same, name):
    lines = "SELECT i // 2 AS l_orderkey, i % 700 AS l_partkey, (i * 7 + i // 5) % {} AS l_suppkey, 1 + i % 2 AS l_linenumber, CASE WHEN i % 3 = 0 THEN 'A' ELSE 'N' END AS l_returnflag FROM range({}) AS r(i)"
    same(name, lineitem=lines.format(3, 450_000))
