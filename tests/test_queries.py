"""Every query with SQL gives the same rows as DuckDB; the others run."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from orderloom.plans import catalogue


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, Decimal):
            return str(v.normalize() + 0)
        return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, (bool, int)) else None if v is None else str(v)

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def database(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_same_rows(spark, data, database, name):
    df = catalogue.queries()[name](spark, data)
    result = database.execute(catalogue.oracles()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_runs(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalogue.oracles()) <= set(catalogue.queries())


def test_flagship(spark, data):
    assert catalogue.flagship(spark, data).count() > 0


def test_core_does_not_import_llm():
    root = Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "orderloom.llm" not in path.read_text(), path
