import datetime
import math

import duckdb
import pytest

from tessera import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[k]) for k in columns) for r in df.collect())
    assert got
    if name in registry.oracle_sql():
        q = duck.sql(registry.oracle_sql()[name])
        assert sorted(q.columns) == columns
        at = [q.columns.index(k) for k in columns]
        assert got == sorted(tuple(norm(r[i]) for i in at) for r in q.fetchall())


def of_sql(name, folder, *names):
    """The rows of a query's SQL over tables in a folder."""
    c = duckdb.connect()
    for t in names:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    q = c.sql(registry.oracle_sql()[name])
    order = [q.columns.index(k) for k in sorted(q.columns)]
    return sorted(tuple(norm(r[i]) for i in order) for r in q.fetchall())


def of_query(name, spark, folder):
    df = registry.queries()[name](spark, folder)
    return sorted(tuple(norm(r[k]) for k in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", ["metadata_enrich", "refresh_report"])
def test_pages_of_one_address(spark, tmp_path, name):
    """Pages that share an address count by themselves in reports; where paths count, the one with the least id does."""
    rows = [(i, f"http{'s' * (i % 2)}://{'abc'[i % 3]}.org/e{i % 3}/p{i % 21}", f"<p>{i}</p>") for i in range(899, -1, -1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).write.parquet(f"{tmp_path}/pages.parquet")
    got = of_query(name, spark, str(tmp_path))
    assert got and got == of_sql(name, tmp_path, "pages")


def test_footers_are_seen_below_long_texts(spark, tmp_path):
    """A footer that every document of a file ends in is found, though it stands beyond 80 characters."""
    from tessera.plans import corpus

    rows = [(40 * k, "src0", "x" * 90 + f" {k}\nbody\nThe footer") for k in range(1, 5)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.file, r.line, r.n) for r in corpus.header_lines(spark, str(tmp_path)).collect()}
    assert got == {(0, "Header 0", 3), (0, "The footer", 4)}


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries())
