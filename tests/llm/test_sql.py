"""The SQL twins beside the queries, over the smallest data and over a fixture of secrets."""

import os

import duckdb
import pytest

from corpusloom.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import SECRETS

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    said = c.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, DATA).select(*said.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(said.fetchall(), key=str)


def test_secrets_twin(spark, tmp_path):
    path = f"{tmp_path}/sf"
    spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string").write.parquet(f"file://{path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    said = c.sql(ORACLE_SQL["op10_secret_links"])
    df = QUERIES["op10_secret_links"](spark, f"file://{path}").select(*said.columns)
    assert sorted(map(tuple, df.collect())) == sorted(said.fetchall())


def test_decontamination_twin(spark, tmp_path):
    """Items without identifier, repeated and null ones."""
    path = f"{tmp_path}/sf"
    docs = [(1, "one two three"), (1, "ONE, two"), (None, "one"), (2, None), (3, "x " * 30), (4, "a b c d e f g h i j k l")]
    items = [(7, "two three"), (None, "one"), (7, "two three"), (8, None), (None, None), (9, "b c d e f g h i j k"), (10, "b c d e f g h i j k"), (None, "three")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    said = c.sql(ORACLE_SQL["op1_decontamination"])
    df = QUERIES["op1_decontamination"](spark, f"file://{path}").select(*said.columns)
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == sorted(said.fetchall(), key=str) and sum(r[said.columns.index("contaminated")] for r in rows) == 4
