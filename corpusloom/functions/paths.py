"""Relative paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contained(path: Column) -> Column:
    """Whether a path stays below its root: relative, and at no step above where it starts.

    Steps fold to the lowest depth reached; a ``..`` goes up by one, an empty or ``.`` step stays.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(acc: Column, s: Column) -> Column:
        depth = acc["depth"] + F.when(s == "..", F.lit(-1)).when(s.isin("", "."), F.lit(0)).otherwise(F.lit(1))
        return F.struct(depth.alias("depth"), F.least(acc["least"], depth).alias("least"))

    lowest = F.aggregate(F.split(path, "/", -1), start, step, lambda acc: acc["least"])
    return ~F.startswith(path, F.lit("/")) & (lowest >= 0)


def backup_key(root: Column, run: Column, seq: Column, role: Column, rel: Column) -> Column:
    """Where a write-once copy lies: root/run/aN/role/rel."""
    return F.concat_ws("/", root, run, F.concat(F.lit("a"), seq.cast("string")), role, rel)
