"""The registry of queries, and the inputs that they share.

The given documents are clean, so a deterministic projection of them dirties line ends, blanks, tabs and marks
by ``doc_id``; the same projection, written in SQL, is the head of every oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under name, with its oracle."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_text() -> Column:
    t, by = F.col("text"), F.col("doc_id") % 8
    swap = lambda new: F.replace(t, F.lit("\n"), F.lit(new))
    cases = [
        F.concat(t, F.lit("\n")),
        swap("\r\n"),
        swap("\r"),
        F.concat(swap("\r\n"), F.lit("\ntail")),
        swap(" \t\n"),
        swap("\n" * 6 + " \n"),
        F.concat(F.lit("\t "), swap("\n\t ")),
        F.concat(F.lit("\ufeff"), t),
    ]
    out = F.when(by == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(by == i, c)
    return out


def extension() -> Column:
    by = F.col("doc_id") % 7
    return F.when(by == 1, F.lit(".TXT")).when(by == 2, F.lit(".md")).when(by == 3, F.lit(".html")).when(by == 6, F.lit(".htm")).otherwise(F.lit(".txt"))


def two(c: Column, n: int = 2) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def dirty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, the dirty text without its mark, whether it had one, and the text's class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    path = F.concat(F.lit("lib/"), two(i % 53), F.lit("/doc"), two(i, 6), extension())
    raw = docs.select("doc_id", path.alias("path"), dirty_text().alias("raw"))
    bare = F.when(i % 8 == 7, F.expr("substring(raw, 2)")).otherwise(F.col("raw"))
    return raw.select("doc_id", "path", "raw", bare.alias("x"), (i % 8 == 7).alias("marked"), F.when((i % 7).isin(3, 6), F.lit("markup")).otherwise(F.lit("text")).alias("kind"))


#: The same projection in DuckDB's SQL.
DIRTY = r"""dirty0 AS (
  SELECT doc_id, 'lib/' || lpad(CAST(doc_id % 53 AS VARCHAR), 2, '0') || '/doc' || lpad(CAST(doc_id AS VARCHAR), 6, '0') ||
    CASE doc_id % 7 WHEN 1 THEN '.TXT' WHEN 2 THEN '.md' WHEN 3 THEN '.html' WHEN 6 THEN '.htm' ELSE '.txt' END AS path,
    CASE doc_id % 8
      WHEN 0 THEN text || E'\n'
      WHEN 1 THEN replace(text, E'\n', E'\r\n')
      WHEN 2 THEN replace(text, E'\n', E'\r')
      WHEN 3 THEN replace(text, E'\n', E'\r\n') || E'\ntail'
      WHEN 4 THEN replace(text, E'\n', E' \t\n')
      WHEN 5 THEN replace(text, E'\n', E'\n\n\n\n\n\n \n')
      WHEN 6 THEN E'\t ' || replace(text, E'\n', E'\n\t ')
      ELSE chr(65279) || text END AS raw
  FROM documents),
dirty AS (
  SELECT doc_id, path, raw, CASE WHEN doc_id % 8 = 7 THEN substr(raw, 2) ELSE raw END AS x, doc_id % 8 = 7 AS marked,
    CASE WHEN doc_id % 7 IN (3, 6) THEN 'markup' ELSE 'text' END AS kind FROM dirty0)"""

#: Steps of the normalisation, each from the one before, with tabs on (width 4) and runs of 3 blank lines.
STEPS = (
    DIRTY
    + r""",
s1 AS (SELECT *, replace(replace(x, E'\r\n', E'\n'), E'\r', E'\n') AS x1 FROM dirty),
s2 AS (SELECT *, CASE WHEN kind = 'text' THEN regexp_replace(x1, '[ \t]+(\n|$)', '\1', 'g') ELSE x1 END AS x2 FROM s1),
s3 AS (SELECT *, CASE WHEN kind = 'text' THEN array_to_string(list_transform(string_split(x2, E'\n'),
    lambda l: replace(regexp_extract(l, '^[ \t]*'), E'\t', '    ') || regexp_replace(l, '^[ \t]+', '')), E'\n') ELSE x2 END AS x3 FROM s2),
s4a AS (SELECT *, string_split(CASE WHEN suffix(x3, E'\n') THEN left(x3, length(x3) - 1) ELSE x3 END, E'\n') AS ls FROM s3),
s4b AS (SELECT *, list_filter(ls, lambda l, i: NOT (i > 3 AND len(list_filter(ls[i-3:i], lambda y: trim(y, E' \t') <> '')) = 0)) AS kept FROM s4a),
s4 AS (SELECT *, CASE WHEN kind <> 'text' OR x3 = '' THEN x3 WHEN len(kept) = 0 THEN ''
    ELSE array_to_string(kept, E'\n') || CASE WHEN suffix(x3, E'\n') THEN E'\n' ELSE '' END END AS x4 FROM s4b),
s5 AS (SELECT *, CASE WHEN kind = 'text' THEN rtrim(x4, E'\n') || E'\n' ELSE x4 END AS x5 FROM s4),
planned AS (SELECT *, list_filter([CASE WHEN marked THEN 'reencode' END, CASE WHEN x1 <> x THEN 'normalize_newlines' END,
    CASE WHEN x2 <> x1 THEN 'trim_trailing_whitespace' END, CASE WHEN x3 <> x2 THEN 'normalize_tabs' END,
    CASE WHEN x4 <> x3 THEN 'collapse_blank_lines' END, CASE WHEN x5 <> x4 THEN 'ensure_final_newline' END,
    CASE WHEN kind = 'text' AND lower(path) LIKE '%.txt' THEN 'rename' END], lambda o: o IS NOT NULL) AS ops FROM s5)"""
)
