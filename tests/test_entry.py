"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(small):
        c.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{small}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr(plain(tuple(r))) for r in got.select(*columns).collect())
    assert rows == sorted(repr(plain(r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and max(r["rank"] for r in rows) <= 8
    assert all(r["score"] == 0.2 or 0.4 <= r["score"] <= 1.0 for r in rows)
    assert all((r["type"] == "seed") == (r["score"] >= 0.4) for r in rows)


@pytest.mark.parametrize("name", ["seeds_exact_over_vector", "bleu_by_turn", "curate_diff_size", "curate_syntax_valid", "stream_symbol_enrich", "stream_buffered_scan"])
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_index_finds_what_is_near(spark, small):
    """Nearly all of the exact nearest rows, with fewer rows scored than there are."""
    rows = QUERIES["vector_index_recall"](spark, small).collect()
    assert sum(r.hit for r in rows) >= 0.95 * sum(r.wanted for r in rows) > 0
    assert sum(r.scored for r in rows) < sum(r.rows for r in rows)
