"""Every core query that has SQL gives the same rows as DuckDB on the smallest tables; the others run."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from threadloom.queries import catalogue, corpora, problems

SQL = {**problems.oracle_sql(), **catalogue.oracle_sql(), **corpora.oracle_sql()}
ALL = {**problems.queries(), **catalogue.queries(), **corpora.queries()}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return round(float(v), 7) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = ALL[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, sf, name):
    assert ALL[name](spark, sf).count() >= 0
