"""Facts of bytes over dirtied documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as X
from .base import DIRTY, dirty_docs, query

#: Bytes with a NUL in every tenth row, and another mark in every eleventh.
BYTES = DIRTY + r""",
b0 AS (SELECT doc_id, path, CASE WHEN doc_id % 10 = 4 THEN raw || chr(0) || 'z' ELSE raw END AS t FROM dirty),
b AS (SELECT doc_id, path, t, CASE doc_id % 11 WHEN 3 THEN '\xFF\xFE'::BLOB || encode(t) WHEN 5 THEN '\xFE\xFF'::BLOB || encode(t) WHEN 6 THEN '\xFF\xFE\x00\x00'::BLOB || encode(t) ELSE encode(t) END AS c, doc_id % 11 IN (3, 5, 6) AS broken FROM b0)"""
CRLF = r"CAST((length(t) - length(replace(t, E'\r\n', ''))) // 2 AS BIGINT)"


def files(spark, sf_dir):
    docs, i = dirty_docs(spark, sf_dir), F.col("doc_id")
    t = F.when(i % 10 == 4, F.concat("raw", F.lit("\x00z"))).otherwise(F.col("raw"))
    mark = F.when(i % 11 == 3, F.unhex(F.lit("FFFE"))).when(i % 11 == 5, F.unhex(F.lit("FEFF"))).when(i % 11 == 6, F.unhex(F.lit("FFFE0000"))).otherwise(F.unhex(F.lit("")))
    return X.with_facts(docs.select("doc_id", "path", F.concat(mark, F.encode(t, "UTF-8")).alias("content")))


@query("fct01_sha256", f"WITH {BYTES} SELECT doc_id, 'sha256:' || sha256(c) AS sha256 FROM b")
def fct01(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "sha256")


@query("fct02_bom", f"WITH {BYTES} SELECT doc_id, CASE WHEN hex(c) LIKE 'FFFE0000%' THEN 'utf-32-le' WHEN hex(c) LIKE '0000FEFF%' THEN 'utf-32-be' WHEN hex(c) LIKE 'EFBBBF%' THEN 'utf-8' WHEN hex(c) LIKE 'FFFE%' THEN 'utf-16-le' WHEN hex(c) LIKE 'FEFF%' THEN 'utf-16-be' END AS bom FROM b")
def fct02(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "bom")


@query("fct03_utf8_valid", f"WITH {BYTES} SELECT doc_id, NOT broken AS utf8_valid FROM b")
def fct03(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "utf8_valid")


@query("fct04_nul", f"WITH {BYTES} SELECT doc_id, contains(t, chr(0)) OR doc_id % 11 = 6 AS nul_bytes FROM b")
def fct04(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "nul_bytes")


NON_ASCII = r"CAST(octet_length(encode(regexp_replace(t, '[\x00-\x7f]', '', 'g'))) + CASE WHEN broken THEN 2 ELSE 0 END AS BIGINT)"


@query("fct05_non_ascii", f"WITH {BYTES} SELECT doc_id, {NON_ASCII} AS non_ascii_bytes FROM b")
def fct05(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "non_ascii_bytes")


@query("fct06_ascii_only", f"WITH {BYTES} SELECT doc_id, {NON_ASCII} = 0 AS ascii_only FROM b")
def fct06(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "ascii_only")


CENSUS = rf"{CRLF} AS crlf, CAST(length(t) - length(replace(t, E'\n', '')) AS BIGINT) - {CRLF} AS lf, CAST(length(t) - length(replace(t, E'\r', '')) AS BIGINT) - {CRLF} AS cr"


@query("fct07_newline_census", f"WITH {BYTES} SELECT doc_id, {CENSUS} FROM b")
def fct07(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "crlf", "lf", "cr")


@query("fct08_newline_style", f"WITH {BYTES}, n AS (SELECT doc_id, {CENSUS} FROM b) SELECT doc_id, CASE CAST(crlf > 0 AS INT) + CAST(lf > 0 AS INT) + CAST(cr > 0 AS INT) WHEN 0 THEN 'none' WHEN 1 THEN CASE WHEN crlf > 0 THEN 'crlf' WHEN lf > 0 THEN 'lf' ELSE 'cr' END ELSE 'mixed' END AS newline_style FROM n")
def fct08(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "newline_style")


@query("fct09_size_suffix", f"WITH {BYTES} SELECT doc_id, CAST(octet_length(c) AS BIGINT) AS size_bytes, regexp_extract(path, '[.][^./]+$') AS suffix FROM b")
def fct09(spark, sf_dir):
    from ..functions.text import suffix

    return files(spark, sf_dir).select("doc_id", "size_bytes", suffix(F.col("path")).alias("suffix"))


@query("fct10_detected", f"WITH {BYTES} SELECT doc_id, CASE doc_id % 11 WHEN 3 THEN 'utf-16-le' WHEN 5 THEN 'utf-16-be' WHEN 6 THEN 'utf-32-le' ELSE 'utf-8' END AS name, CASE WHEN broken OR doc_id % 8 = 7 THEN 'bom' ELSE 'utf8-strict' END AS method FROM b")
def fct10(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.withColumn("d", X.detected(f)).select("doc_id", "d.name", "d.method")


@query("fct11_legacy_charset")
def fct11(spark, sf_dir):
    """Detection runs on those rows alone that no certain answer fits; beyond SQL."""
    from ..functions.detect import legacy_charset

    content = F.encode(F.translate("text", "«»’", "   "), "ISO-8859-1")
    docs = dirty_docs(spark, sf_dir).select("doc_id", "x").withColumnRenamed("x", "text")
    rows = docs.where(~F.col("text").rlike(r"[^\x00-\xFF]")).select("doc_id", content.alias("content"))
    open_ = X.with_facts(rows).where("bom IS NULL AND NOT utf8_valid AND NOT nul_bytes")
    return open_.select("doc_id", legacy_charset("content").alias("d")).select("doc_id", "d.name", F.round("d.confidence", 6).alias("confidence"), "d.method")


@query("fct12_totals", f"WITH {BYTES} SELECT count(*) AS files, CAST(sum(octet_length(c)) AS BIGINT) AS bytes, count(*) FILTER (WHERE broken) AS invalid FROM b")
def fct12(spark, sf_dir):
    return files(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(~F.col("utf8_valid")).alias("invalid"))


#: Characters whose low byte is NUL, as a pattern; those up to U+00FF have a high one.
LOW_NUL = "".join(f"\\x{{{page:02X}00}}" for page in range(256) if not 0xD8 <= page <= 0xDF)


@query("flt05_utf16_suspect", f"""WITH {DIRTY}, c AS (SELECT doc_id, 2 * length(x) AS n, length(regexp_replace(x, '[^\\x00-\\x{{FF}}]', '', 'g')) AS high, length(regexp_replace(x, '[^{LOW_NUL}]', '', 'g')) AS low FROM dirty)
SELECT doc_id, doc_id % 3 < 2 AND n >= 4 AND 4 * (high + low) >= n AND 10 * greatest(high, low) >= 9 * (high + low) AS suspect FROM c""")
def flt05(spark, sf_dir):
    """UTF-16 without a mark, against bytes with odd NULs; the SQL counts NULs by the characters that make them."""
    x = F.col("x")
    content = F.when(F.col("doc_id") % 3 == 0, F.encode(x, "UTF-16LE")).when(F.col("doc_id") % 3 == 1, F.encode(x, "UTF-16BE")).otherwise(F.concat(F.encode(x, "UTF-8"), F.unhex(F.lit("0000"))))
    return dirty_docs(spark, sf_dir).select("doc_id", X.utf16_suspect(content).alias("suspect"))


@query("flt08_shrink", f"WITH {DIRTY}, y AS (SELECT doc_id, x, replace(replace(x, E'\\r\\n', E'\\n'), E'\\r', E'\\n') AS y FROM dirty) SELECT doc_id, length(regexp_replace(y, '[ \\t\\r\\n]', '', 'g')) < length(regexp_replace(x, '[ \\t\\r\\n]', '', 'g')) AS shrinks FROM y")
def flt08(spark, sf_dir):
    from ..functions.text import non_whitespace_count, normalize_newlines

    x = F.col("x")
    return dirty_docs(spark, sf_dir).select("doc_id", (non_whitespace_count(normalize_newlines(x)) < non_whitespace_count(x)).alias("shrinks"))


@query("flt10_content_checks", f"WITH {BYTES}, n AS (SELECT doc_id, path, broken, {CENSUS} FROM b) SELECT path, 'encoding' AS check_name FROM n WHERE broken UNION ALL SELECT path, 'newlines' FROM n WHERE crlf > 0 OR cr > 0")
def flt10(spark, sf_dir):
    from ..plans.verify import content_findings

    return content_findings(files(spark, sf_dir)).select("path", F.col("check").alias("check_name"))
