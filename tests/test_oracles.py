"""Every registered query against its SQL on the smallest test tables."""

import math

import pytest

from monthmill.plans.catalog import ORACLES, QUERIES


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def key(row):
    return tuple("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, root, name):
    df = QUERIES[name](spark, root)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == columns
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=key)
    assert len(rows) == len(expected)
    for got, want in zip(rows, expected):
        assert all(same(a, b) for a, b in zip(got, want)), (got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, root, name):
    rows = QUERIES[name](spark, root).collect()
    assert rows
