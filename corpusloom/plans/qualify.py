"""Qualification: a synthetic corpus, capacity, and thresholds from measured runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of index % 40: upper end, class, suffix, encoding, newline, operations, disposition (fixed values).
BUCKETS = [
    (24, "rename-only", ".txt", "utf-8", "lf", "rename", "action"),
    (32, "rewrite-and-rename", ".txt", "utf-8", "crlf", "normalize_newlines,rename", "action"),
    (36, "clean-markdown", ".md", "utf-8", "lf", "", "noop"),
    (38, "rewrite-markdown", ".md", "utf-8", "crlf", "normalize_newlines", "action"),
    (39, "legacy-conversion", ".txt", "windows-1252", "crlf", "reencode,normalize_newlines,rename", "action"),
    (40, "below-floor-skip", ".txt", "windows-1252", "lf", "", "skip"),
]


def recipes(indexed: DataFrame) -> DataFrame:
    """What each index stands for in the synthetic corpus, and what a plan must make of it."""
    b = F.col("index") % 40

    def pick(k: int) -> Column:
        out = F.when(b < BUCKETS[0][0], F.lit(BUCKETS[0][k]))
        for row in BUCKETS[1:]:
            out = out.when(b < row[0], F.lit(row[k]))
        return out

    rows = indexed.select("index", *[pick(i).alias(n) for i, n in enumerate(["recipe_class", "suffix", "encoding", "newline", "operations", "disposition"], 1)])
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    path = F.concat(F.lit("lib/"), two(F.col("index") % 53), F.lit("/"), two(F.floor(F.col("index") / 53) % 41), F.lit("/doc"), F.lpad(F.col("index").cast("string"), 6, "0"), F.col("suffix"))
    return rows.withColumn("path", path)


def corpus(spark: SparkSession, n: int, seed: int = 20260713, words: int = 12) -> DataFrame:
    """Synthetic documents: a body of words drawn by hashes of seed, index and place."""
    rows = recipes(spark.range(n).withColumnRenamed("id", "index"))
    word = lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed), F.col("index"), i), F.lit(997)).cast("string"))
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ")
    end = F.when(F.col("newline") == "crlf", F.lit("\r\n")).otherwise(F.lit("\n"))
    return rows.withColumn("text", F.concat(line, end, line, end))


def slope(points: DataFrame) -> DataFrame:
    """The largest least-squares slope over stages of (stage, n, rss), none below zero."""
    return points.groupBy("stage").agg(F.greatest(F.lit(0.0), F.regr_slope("rss", "n")).alias("slope")).agg(F.max("slope").alias("slope"))


def thresholds(points: DataFrame, small: int, large: int, at: int) -> DataFrame:
    """Peaks projected from two sizes to a third, and the limit a quarter above the largest, in whole bytes.

    Arithmetic is exact: growth is a fraction of whole numbers, cleared by its denominator before rounding up.
    """
    span = large - small
    r1, r2 = (F.max(F.when(F.col("n") == n, F.col("rss").cast("decimal(20,0)"))) for n in (small, large))
    rows = points.groupBy("stage").agg(r1.alias("r1"), r2.alias("r2"))
    scaled = F.greatest(F.greatest("r1", "r2") * F.lit(span), F.col("r1") * F.lit(span) + (F.col("r2") - F.col("r1")) * F.lit(at - small))
    return rows.agg(F.max(scaled).alias("m")).select(F.ceil(F.col("m") * 5 / F.lit(4 * span).cast("decimal(12,0)")).cast("long").alias("peak_limit"))


def verdict(measured: DataFrame, peak_limit: Column, slope_limit: Column, linear_limit: Column) -> DataFrame:
    """Which of the limits each run keeps."""
    return measured.select("run", (F.col("peak") <= peak_limit).alias("peak_ok"), (F.col("slope") <= slope_limit).alias("slope_ok"), (F.col("linearity") <= linear_limit).alias("linear_ok"))


def capacity(actions: DataFrame, fragment: int = 4096) -> DataFrame:
    """What a plan needs on each device: whole fragments and inodes, a quarter more, rounded up, beside what is free."""
    from ..functions.text import allocated_bytes

    need = actions.groupBy("device").agg(F.sum(allocated_bytes(F.col("size_bytes"), fragment)).alias("bytes"), F.sum(F.lit(3) + F.col("depth")).alias("inodes"), F.max("available").alias("available"))
    more = lambda c: F.floor((F.col(c) * 5 + 3) / 4).cast("long")
    return need.select("device", more("bytes").alias("bytes"), more("inodes").alias("inodes"), (more("bytes") <= F.col("available")).alias("fits"))


def throughput(stages: DataFrame) -> DataFrame:
    """Files and bytes per second of each stage."""
    return stages.select("stage", (F.col("files") / F.col("elapsed")).alias("files_s"), (F.col("bytes") / F.col("elapsed")).alias("bytes_s"))
