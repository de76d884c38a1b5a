"""Every query of the library beside its SQL, over the smallest data."""

import os

import duckdb
import pytest

from corpusloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = plain([tuple(r[c] for c in columns) for r in df.collect()])
    if name not in ORACLES:
        assert found
        return
    said = duck.sql(ORACLES[name])
    at = [said.columns.index(c) for c in columns]
    assert len(said.columns) == len(columns)
    assert found == plain([tuple(r[i] for i in at) for r in said.fetchall()])


def beside(spark, name, table, rows, tmp_path):
    """What a query and its SQL make of a table of these rows."""
    c = duckdb.connect()
    c.sql(f"CREATE TABLE {table} AS {rows}")
    c.sql(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    df, said = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLES[name])
    return plain(tuple(r[x] for x in said.columns) for r in df.collect()), plain(said.fetchall())


def test_verdict_of_halves(spark, tmp_path):
    prices = "(1, 199999.5), (2, 200000.4), (3, 200000.5), (4, 200000.51), (5, 200001.5), (6, -0.5), (7, NULL)"
    found, said = beside(spark, "agg14_verdict", "orders", f"SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(700 AS BIGINT) AS o_custkey, CAST(p AS DOUBLE) AS o_totalprice FROM (VALUES {prices}) AS v(k, p)", tmp_path)
    assert found == said
    assert [r[1] for r in found] == [True, True, True, False, False, True, None]


def test_priority_of_large_identifiers(spark, tmp_path):
    events = [
        (1, 5, "purchase"), (1, 2_000_000, "error"),  # the purchase is more than a million before
        (2, 1_500_000, "purchase"), (2, 2_000_000, "error"),
        (3, 5, "view"), (3, 1_000_006, "click"), (3, 6_000_000, "error"),
        (4, 7, None), (4, 5_000_000, "view"),  # rows without reason or identifier are not chosen
        (5, None, "error"), (5, 9, "signup"),
        (6, 3, None),
        (7, 8, "purchase"), (7, 1_000_008, "error"),  # equal keys: the smaller identifier
        (None, 2, "click"), (None, 1, "view"),
    ]
    rows = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in events)
    found, said = beside(spark, "agg15_priority", "events", f"SELECT CAST(u AS BIGINT) AS user_id, CAST(e AS BIGINT) AS event_id, t AS event_type FROM (VALUES {rows}) AS v(u, e, t)", tmp_path)
    assert found == said
    assert dict(found) == {1: "purchase", 2: "error", 3: "view", 4: "view", 5: "signup", 6: None, 7: "purchase", None: "click"}
