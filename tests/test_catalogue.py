"""Every registered query of the engine against its SQL on the smallest tables, those over documents and pages on larger ones too."""

import os

import pytest

from maskwright.plans import catalogue

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def connected(folder):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


@pytest.fixture(scope="module")
def duck():
    return {folder: connected(folder) for folder in (DATA, LARGER) if os.path.isdir(folder)}


def plain(x):
    if x is None or str(x) in ("<NA>", "nan", "NaT"):
        return "null"
    x = x.item() if hasattr(x, "item") else x
    return str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def held(spark, duck, name, folder):
    df = catalogue.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck[folder].sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(map(plain, r)) for r in rel.df()[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_equal_to_sql(spark, duck, name):
    held(spark, duck, name, DATA)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
@pytest.mark.parametrize("name", [n for n in catalogue.oracle_sql() if n == "entity_counts" or n.endswith(("_documents", "_pages"))])
def test_equal_to_sql_on_larger_tables(spark, duck, name):
    held(spark, duck, name, LARGER)


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_letters_are_dealt_to_all_cores(spark):
    assert catalogue.letters(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pseudonyms_to_be_restored_are_made_by_all_cores(spark):
    assert len(catalogue._with_mappings(spark, DATA)[0].inputFiles()) >= spark.sparkContext.defaultParallelism
