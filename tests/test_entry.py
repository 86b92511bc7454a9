"""Every query against its SQL, and the driver's contract."""

import importlib.abc
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from ngramforge.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_float_dtype(frame[c]):
            frame[c] = frame[c].round(5) + 0.0
    return frame.sort_values(list(frame.columns), ignore_index=True)


@pytest.fixture(scope="module")
def sql(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sql, sf_dir, name):
    got = comparable(queries.QUERIES[name](spark, sf_dir).toPandas())
    want = comparable(sql.execute(oracles.ORACLES[name]).df())
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-5)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count()


def test_contract(spark):
    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(monkeypatch):
    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "ngramforge.llm"):
                raise ModuleNotFoundError(name, name=name)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("ngramforge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert set(__spark_entry__.queries()) == set(queries.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(oracles.ORACLES)
