"""The corpus pipeline: documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from corpusloom.llm import quality, simhash
from corpusloom.llm.common import materialize, quoted, scratch, table
from corpusloom.llm.decontam import decontaminate
from corpusloom.llm.packing import pack
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.secrets import redacted, scan


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have the mean label for a score, so without good labels in the majority they go; rows
    that repeat an identifier are judged one by one; no documents give none; other columns stay as they are.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=0.7, carry=True).where("predicted = 1").select("row.*")


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _holds_map(kind.elementType))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near duplicates: the first by its identifier, then by a hash of its columns.

    Rows are told apart by their place, so those that repeat an identifier are near duplicates only if their
    texts are; rows without identifier come last.  Null and wordless texts are one class; no documents give
    none; other columns, of any name and kind, stay as they are.
    """
    rows = materialize(simhash.fingerprints(docs, carry=True), "fingerprints")
    classes = simhash.classes(rows.select("doc_id", "fp"))
    columns = [F.to_json(F.struct(c)) if _holds_map(f.dataType) else c for f in docs.schema for c in [F.col(f"row.{quoted(f.name)}")]]
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*columns), "place")
    first = rows.select("fp", "place", order.alias("rank")).join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min_by("place", "rank").alias("place"))
    return rows.join(first.select("place"), "place", "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and wordless texts stay; rows that repeat an identifier are judged one by one; without a benchmark all
    documents stay; other columns stay as they are.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True).where("not contaminated").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked, and ``n_chars`` by the masked text where there is such a column.

    Null texts stay null; repeated rows are masked alike; no documents give none; other columns stay as they are.
    """
    masked = scan(docs, carry=True).select("row", redacted(F.col("row.text"), F.concat("base", "linked")).alias("masked"))
    changed = {"text": F.col("masked"), "n_chars": F.length("masked")}
    return masked.select(*[changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col(f"row.{quoted(f.name)}") for f in docs.schema])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids, and where their ids are.

    The ids are written below the shared folder, as token-id files; ``file`` is the path of a piece's one, and
    ``file_start`` its place there.  Null and empty texts are their end id; rows that repeat an identifier are
    documents of their own; no documents give no pieces; other columns are dropped.
    """
    folder = f"{scratch(spark)}/ids"
    packed = pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024, folder=folder)
    return packed.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("packing", pack_windows),
]

#: Model scores and fingerprints are beyond SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each reading what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
