"""Sinks: artifacts that appear whole or not at all, append-only journals and backups."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guard(path: str, corpus_root: str, inputs: list[str], folder: str = ".corpusloom") -> None:
    """Refuses artifact paths inside the corpus (but for its own folder), over an input, or on what isn't a file."""
    real, root = os.path.realpath(path), os.path.realpath(corpus_root)
    for place, top in ((os.path.normpath(os.path.abspath(path)), os.path.abspath(corpus_root)), (real, root)):
        own = os.path.join(top, folder)
        if os.path.commonpath([place, top]) == top and os.path.commonpath([place, own]) != own:
            raise ValueError(f"{path} is inside the corpus")
    if real in {os.path.realpath(x) for x in inputs}:
        raise ValueError(f"{path} is an input")
    if os.path.lexists(path) and not os.path.isfile(path):
        raise ValueError(f"{path} isn't a regular file")


def write_artifact(path: str, value: dict, clobber: bool = True) -> None:
    """A small JSON artifact on any store that Arrow reaches.

    The store moves a finished file to its name, so nothing is ever half there.  Without ``clobber`` a name that is
    taken is an error; on a local disk an empty file claims it until the move, so of two writers at once one gets it.
    """
    store, place = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    store.create_dir(os.path.dirname(place), recursive=True)
    if not clobber and store.type_name == "local":
        with open(place, "xb"):  # the name is claimed, and replaced by the move
            pass
    elif not clobber and store.get_file_info(place).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    hidden = os.path.join(os.path.dirname(place), f".{os.path.basename(place)}.{uuid.uuid4().hex}")
    try:
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps(value, ensure_ascii=False, sort_keys=True).encode())
        store.move(hidden, place)
    except BaseException:
        for left in [hidden] + [place] * (not clobber):
            if store.get_file_info(left).type != fs.FileType.NotFound:
                store.delete_file(left)
        raise


def write_checked(rows: DataFrame, problems: DataFrame, path: str, mode: str = "error") -> None:
    """Writes a dataset only if the frame of its broken constraints is empty."""
    broken = problems.limit(5).collect()
    if broken:
        raise ValueError(f"not written, {broken}")
    rows.write.mode(mode).parquet(path)


def append_backups(copies: DataFrame, path: str) -> None:
    """Copies by key, each written once: keys that are there already, or named twice, are refused.

    With their digests in ``sha``, what was written is read again, and a copy that isn't its original is an error.
    """
    spark = copies.sparkSession
    twice = copies.groupBy("key").count().where("count > 1")
    held = spark.read.parquet(path).select("key") if _exists(spark, path) else copies.select("key").limit(0)
    again = copies.select("key").join(held, "key", "left_semi").withColumn("count", F.lit(2))
    write_checked(copies, twice.select("key", F.col("count").cast("long")).unionByName(again.select("key", F.col("count").cast("long"))), path, "append")
    if "sha" in copies.columns:
        written = spark.read.parquet(path).select("key", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("found"))
        wrong = copies.select("key", "sha").join(written, "key", "left").where(~F.col("sha").eqNullSafe(F.col("found"))).limit(5).collect()
        if wrong:
            raise ValueError(f"backups that aren't their originals: {wrong}")


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


class Heartbeat:
    """Progress lines every so many seconds: counts never fall, and add up at the end."""

    def __init__(self, emit, total: int, every: float = 30.0, clock=time.monotonic):
        self.emit, self.total, self.every, self.clock = emit, total, every, clock
        self.counts, self.last = (0, 0, 0), clock()

    def advance(self, processed: int, skipped: int, failed: int) -> None:
        now = (processed, skipped, failed)
        if any(a < b for a, b in zip(now, self.counts, strict=True)) or processed > self.total:
            raise ValueError("progress can't fall or pass the total")
        self.counts = now
        if self.clock() - self.last >= self.every or processed == self.total:
            self.last = self.clock()
            self.emit({"event": "progress", "processed": processed, "skipped": skipped, "failed": failed, "total": self.total})
