"""Every query of the catalogue against its SQL twin."""
import duckdb
import pytest

from rasterloom.plans import catalogue

TABLES = ("lineitem", "embeddings", "events")


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def shown(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None).astype(str)
    return frame.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf_dir, db, name):
    ours, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), db.execute(catalogue.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert sorted(want.columns) == columns and len(ours) == len(want) > 0
    assert shown(ours, columns).equals(shown(want, columns))


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
