"""What the training-data operators share: tables, the shared scratch folder, and Arrow passes over rows.

Rows are addressed by position, never by identifier, wherever a result is per row, so repeated or null
identifiers are ordinary rows.  Other columns of an input are dropped, or travel inside one struct column
``row`` (``carry=True``), so their names can't clash with what an operator adds.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..operators.tables import kept as materialize
from ..operators.tables import scratch
from ..session import ship

__all__ = ["arrow_pass", "crc_mod", "ddl", "materialize", "one_thread", "quoted", "scratch", "small_batches", "table"]

#: Rows of one Arrow batch; texts can be long, so batches are short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given data folder, by whatever path Spark can read."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches short, so that a worker holds a few MB of text at a time, and ships the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_pass(
    df: DataFrame,
    inputs: dict[str, Column],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    schema: str,
    carry: bool = False,
) -> DataFrame:
    """Adds columns computed from whole Arrow batches.

    ``make`` is called once per task and returns the function of a batch of ``inputs``; ``schema`` lists what
    it returns.  With ``carry`` the columns of df come along as struct ``row``.
    """
    small_batches(df.sparkSession)
    picked = [c.alias(k) for k, c in inputs.items()] + ([F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")] if carry else [])
    source = df.select(*picked)
    out = schema + (f", row {ddl(source.schema['row'].dataType)}" if carry else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = work(batch)
            if carry:
                columns = columns | {"row": batch.column(batch.schema.get_field_index("row"))}
            yield pa.RecordBatch.from_pydict(columns)

    return source.mapInArrow(run, out)


@functools.cache
def one_thread() -> None:
    """Keeps numpy's products to the thread that asks for them: a task has one core, and small products don't gain by more.

    Where numpy has brought another library than OpenBLAS, all stays as it is.
    """
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def ddl(kind: DataType) -> str:
    """A type in DDL, with the names of fields quoted."""
    if isinstance(kind, StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{ddl(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    if isinstance(kind, MapType):
        return f"map<{ddl(kind.keyType)},{ddl(kind.valueType)}>"
    return kind.simpleString()


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of an identifier's decimal text, modulo n: the fold that fixes what is held out."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))
