"""Every registered query of the library with an oracle: Spark against DuckDB on the same files."""

import duckdb
import pytest

from loomwork import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        out.append(tuple("" if row[i] is None else f"{row[i]:.6g}" if isinstance(row[i], float) else str(row[i]) for i in order))
    return sorted(names), sorted(out)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = duck.execute(ORACLES[name])
    theirs = canonical(rel.fetchall(), [d[0] for d in rel.description])
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1]) and mine[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_names():
    assert ORACLES.keys() <= QUERIES.keys()
