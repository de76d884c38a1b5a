"""New documents as a stream: normalised statelessly, each text taken once, outputs claimed per batch.

An extension: batch plans need none of it.  Exactly-once comes from the checkpoint and from outputs that are
named by the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.tables import kept


def normalized(docs: DataFrame, rules: T.Rules = T.Rules()) -> DataFrame:
    """Path, kind and text in; path, normalised text, its digest and the operations out.  No state."""
    rows = docs.withColumn("kind", T.suffix_class(F.col("path"))).withColumnRenamed("text", "x")
    out = T.transformed(rows, "x", "kind", rules)
    return out.select("path", F.col("new_text").alias("text"), F.sha2("new_text", 256).alias("sha"), F.array_join("text_ops", ",").alias("ops"))


def start(stream: DataFrame, out: str, checkpoint: str, rules: T.Rules = T.Rules()):
    """Writes what each batch brings and no earlier batch has claimed, under its number.

    ``out/texts`` has every text once, under the batch that brought it first, and ``out/paths`` every path with its
    text's digest.  Claims are digests alone, in one table by batch, so a batch reads no texts of earlier ones; a
    batch that runs again finds its own claims left out and writes the same.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = kept(normalized(batch, rules), "batch")
        rows.select("path", "sha").write.mode("overwrite").parquet(f"{out}/paths/batch={number}")
        new = rows.groupBy("sha").agg(F.min_by(F.struct("path", "text", "ops"), "path").alias("r")).select("r.path", "r.text", "sha", "r.ops")
        from ..sources.sinks import _exists

        if _exists(spark, f"{out}/claims"):
            claims = spark.read.schema("sha string, batch long").parquet(f"{out}/claims").where(F.col("batch") < number)
            new = new.join(claims, "sha", "left_anti")
        new = kept(new, "new")
        new.select("sha").write.mode("overwrite").parquet(f"{out}/claims/batch={number}")
        new.write.mode("overwrite").parquet(f"{out}/texts/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Documents per kind and window of event time, closed once ``late`` has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "kind").agg(F.count("*").alias("n"))
