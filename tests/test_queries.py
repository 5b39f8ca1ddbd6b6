"""Every core query runs at the smallest scale; those with SQL agree with it."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cellorium.plans import registry

SLOW = {"signature_classes", "svm_labels", "subsample_classified", "pipeline_labels", "pooled_classes", "model_classes", "integrate_datasets"}
NAMES = sorted(set(registry.queries()) - SLOW)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canonical(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(one(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
