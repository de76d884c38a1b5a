"""Relational pieces that plans and checks are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hard_links(files: DataFrame) -> DataFrame:
    """Sorted paths of each object with more than one link."""
    return files.where("nlink > 1").groupBy("dev", "ino").agg(F.max("nlink").alias("nlink"), F.sort_array(F.collect_list("path")).alias("paths"))


def with_links(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds to each path the group that it belongs to, if any."""
    members = groups.select("dev", "ino", F.explode("paths").alias("member"))
    return files.join(members.withColumnsRenamed({"dev": "g_dev", "ino": "g_ino"}), F.col("path") == F.col("member"), "left").drop("member")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def multiset_difference(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    missing = expected.exceptAll(observed).withColumn("side", F.lit("missing"))
    return missing.unionByName(observed.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many distinct rows are in both."""
    return a.intersect(b).agg(F.count("*").alias("shared"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first; ties go to none, since orders are unique."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def mismatches(expected: DataFrame, observed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full comparison by key: what is missing, unexpected, or differs, and where."""
    right = observed.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = expected.select(key, *columns).join(right, F.col(key) == F.col("__k"), "full")
    differs = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns])), ",")
    problem = F.when(F.col("__k").isNull(), F.lit("missing")).when(F.col(key).isNull(), F.lit("unexpected")).when(differs != "", F.concat(F.lit("differs: "), differs))
    return both.select(F.coalesce(key, "__k").alias(key), problem.alias("problem")).where("problem IS NOT NULL")


def totals_agree(declared: DataFrame, observed: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose declared count isn't the observed one."""
    seen = observed.groupBy(key).agg(F.count("*").alias("seen"))
    both = declared.select(key, count).join(seen.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "full")
    both = both.select(F.coalesce(key, "__k").alias(key), F.coalesce(count, F.lit(0)).cast("long").alias("declared"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"))
    return both.where("declared <> seen")


def by_priority(name: Column, priorities: list[str]) -> Column:
    """The rank of a name in a list; what isn't in it comes last."""
    out = F.lit(len(priorities))
    for i, p in reversed(list(enumerate(priorities))):
        out = F.when(name == p, F.lit(i)).otherwise(out)
    return out
