"""Every registered query of the match and odds operators against its SQL, run by DuckDB on the same tables."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from oddslake.plans import catalogue


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def tables(sf_dir):
    held = duckdb.connect()
    held.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        held.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return held


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, tables):
    out = catalogue.QUERIES[name](spark, sf_dir)
    order = sorted(out.columns)
    got = Counter(tuple(plain(v) for v in r) for r in out.select(*order).toLocalIterator())
    found = tables.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == order
    at = [found.columns.index(c) for c in order]
    assert got == Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())


def test_name_based_uuids(spark, sf_dir):
    out = catalogue.QUERIES["uuid_from_name"](spark, sf_dir)
    assert out.count() > 0


def test_every_query_has_a_name_of_its_own():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
