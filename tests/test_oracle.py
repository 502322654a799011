"""Every registered query of the reference's operators against its SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import lodestone.plans.all as plans

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in plans.ORACLE:
        assert df.columns
        return
    rel = db.sql(plans.ORACLE[name])
    want = rel.fetchall()
    assert not any(isinstance(v, decimal.Decimal) for r in want for v in r), "Spark has doubles"
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(rel.columns, want)
    assert want or "empty" in name, "an oracle without rows tells nothing"
