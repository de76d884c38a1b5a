"""Facts of raw bytes as column expressions.

``latin`` reads each byte as one character, so that the regular expressions see bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte-order marks, longest first (fixed values).
BOMS = [("utf-32-le", "FFFE0000"), ("utf-32-be", "0000FEFF"), ("utf-8", "EFBBBF"), ("utf-16-le", "FFFE"), ("utf-16-be", "FEFF")]
BOM_LENGTH = {name: len(mark) // 2 for name, mark in BOMS}


def latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def bom(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 4)), None
    for name, mark in BOMS:
        test = F.startswith(head, F.lit(mark))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def utf8_valid(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def count_of(content: Column, pattern: str) -> Column:
    return F.regexp_count(latin(content), F.lit(pattern)).cast("long")


def newline_style(crlf: Column, lf: Column, cr: Column) -> Column:
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds == 0, F.lit("none")).when(kinds > 1, F.lit("mixed")).when(crlf > 0, F.lit("crlf")).when(lf > 0, F.lit("lf")).otherwise(F.lit("cr"))


def utf16_suspect(content: Column) -> Column:
    """At least a quarter of four or more bytes are NUL, nine in ten of those at one parity."""
    n, nuls = F.octet_length(content), count_of(content, r"\x00")
    even = F.regexp_count(F.regexp_replace(latin(content), r"(?s)(.).?", "$1"), F.lit(r"\x00")).cast("long")
    return (n >= 4) & (4 * nuls >= n) & ((10 * even >= 9 * nuls) | (10 * (nuls - even) >= 9 * nuls))


def with_facts(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds every fact of a file's bytes."""
    c = F.col(content)
    counted = files.withColumns(
        {
            "size_bytes": F.octet_length(c).cast("long"),
            "sha256": digest(c),
            "bom": bom(c),
            "utf8_valid": utf8_valid(c),
            "nul_bytes": F.contains(F.hex(c), F.lit("00")) & (count_of(c, r"\x00") > 0),
            "non_ascii_bytes": count_of(c, r"[\x80-\xFF]"),
            "crlf": count_of(c, r"\r\n"),
            "lf": count_of(c, r"(?<!\r)\n"),
            "cr": count_of(c, r"\r(?!\n)"),
        }
    )
    return counted.withColumns({"ascii_only": F.col("non_ascii_bytes") == 0, "newline_style": newline_style(F.col("crlf"), F.col("lf"), F.col("cr"))})


def detected(frame: DataFrame) -> Column:
    """The ladder of certain answers: a mark, then strict UTF-8; null where only detection could tell."""
    mark = F.struct(F.col("bom").alias("name"), F.lit(1.0).alias("confidence"), F.lit("bom").alias("method"))
    strict = F.struct(F.lit("utf-8").alias("name"), F.lit(1.0).alias("confidence"), F.lit("utf8-strict").alias("method"))
    return F.when(F.col("bom").isNotNull(), mark).when(F.col("utf8_valid"), strict)
