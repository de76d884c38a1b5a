"""Scalar text functions over dirtied documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .base import DIRTY, STEPS, dirty_docs, query, table

TABBED = T.Rules(tabs=True)


def _simple(name: str, make, sql: str) -> None:
    """A query of one text function: the digest and length of what it makes."""

    @query(name, f"WITH {DIRTY}, o AS (SELECT doc_id, {sql} AS y FROM dirty) SELECT doc_id, sha256(y) AS digest, CAST(length(y) AS BIGINT) AS n FROM o")
    def run(spark, sf_dir):
        y = dirty_docs(spark, sf_dir).select("doc_id", make(F.col("x")).alias("y"))
        return y.select("doc_id", F.sha2("y", 256).alias("digest"), F.length("y").cast("long").alias("n"))


_simple("txt01_newlines", T.normalize_newlines, r"replace(replace(x, E'\r\n', E'\n'), E'\r', E'\n')")
_simple("txt02_trim", T.trim_trailing, r"regexp_replace(x, '[ \t]+(\n|$)', '\1', 'g')")
_simple("txt03_final_newline", T.ensure_final_newline, r"rtrim(x, E'\n') || E'\n'")


@query("txt04_collapse", f"WITH {STEPS} SELECT doc_id, sha256(x4) AS digest, CAST(length(x4) AS BIGINT) AS n FROM s4")
def txt04(spark, sf_dir):
    out = T.transformed(dirty_docs(spark, sf_dir), "x", "kind", T.Rules(tabs=True, final_newline=False))
    return out.select("doc_id", F.sha2("new_text", 256).alias("digest"), F.length("new_text").cast("long").alias("n"))


_simple("txt05_tabs", lambda x: T.normalize_tabs(x, 4), r"array_to_string(list_transform(string_split(x, E'\n'), lambda l: replace(regexp_extract(l, '^[ \t]*'), E'\t', '    ') || regexp_replace(l, '^[ \t]+', '')), E'\n')")


@query("txt06_transforms", f"WITH {STEPS} SELECT doc_id, sha256(x5) AS digest, array_to_string(list_filter(ops, lambda o: o NOT IN ('rename', 'reencode')), ',') AS ops FROM planned")
def txt06(spark, sf_dir):
    out = T.transformed(dirty_docs(spark, sf_dir), "x", "kind", TABBED)
    return out.select("doc_id", F.sha2("new_text", 256).alias("digest"), F.array_join("text_ops", ",").alias("ops"))


@query("txt07_suffix_class", f"WITH {DIRTY} SELECT doc_id, regexp_extract(path, '[.][^./]+$') AS suffix, CASE WHEN regexp_extract(lower(path), '[.][^./]+$') IN ('.txt', '.md') THEN 'text' ELSE 'markup' END AS kind FROM dirty")
def txt07(spark, sf_dir):
    return dirty_docs(spark, sf_dir).select("doc_id", T.suffix(F.col("path")).alias("suffix"), T.suffix_class(F.col("path")).alias("kind"))


@query("txt08_non_whitespace", rf"WITH {DIRTY} SELECT doc_id, CAST(length(regexp_replace(x, '[\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')) AS BIGINT) AS n FROM dirty")
def txt08(spark, sf_dir):
    return dirty_docs(spark, sf_dir).select("doc_id", T.non_whitespace_count(F.col("x")).alias("n"))


@query("txt09_decode", f"WITH {DIRTY} SELECT doc_id, sha256(x) AS digest, CAST(length(x) AS BIGINT) AS n FROM dirty")
def txt09(spark, sf_dir):
    """Bytes with and without marks, decoded as the ladder says."""
    from ..functions.facts import with_facts

    files = with_facts(dirty_docs(spark, sf_dir).select("doc_id", F.encode("raw", "UTF-8").alias("content")))
    bare = F.when(F.col("bom") == "utf-8", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    text = F.when(F.col("utf8_valid"), bare.cast("string"))
    return files.select("doc_id", F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("n"))


@query("txt10_encode", f"WITH {DIRTY} SELECT doc_id, sha256(encode(x)) AS digest, CAST(octet_length(encode(x)) AS BIGINT) AS n FROM dirty")
def txt10(spark, sf_dir):
    out = dirty_docs(spark, sf_dir).select("doc_id", F.encode("x", "UTF-8").alias("b"))
    return out.select("doc_id", F.sha2("b", 256).alias("digest"), F.octet_length("b").cast("long").alias("n"))


@query("txt11_operation_kind", f"WITH {STEPS} SELECT doc_id, CASE WHEN list_contains(ops, 'rename') AND len(ops) > 1 THEN 'rename_and_rewrite' WHEN list_contains(ops, 'rename') THEN 'rename' ELSE 'rewrite' END AS operation FROM planned WHERE len(ops) > 0")
def txt11(spark, sf_dir):
    from ..plans.planner import operations

    out = operations(dirty_docs(spark, sf_dir), TABBED)
    return out.where(F.size("ops") > 0).select("doc_id", T.operation_kind(F.col("ops")).alias("operation"))


@query("txt12_rename_target", f"WITH {DIRTY} SELECT doc_id, path, CASE WHEN lower(path) LIKE '%.txt' THEN left(path, length(path) - 4) || '.md' END AS target FROM dirty")
def txt12(spark, sf_dir):
    return dirty_docs(spark, sf_dir).select("doc_id", "path", T.rename_target(F.col("path")).alias("target"))


FRONT = r"""fm AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN E'---\ntitle: t' || doc_id || E'\n---\n' || text WHEN 1 THEN E' --- \na: 1\nb: 2\n... \n' || text WHEN 2 THEN E'---\nopen\n' || replace(text, '---', '') ELSE text END AS y FROM documents),
fl AS (SELECT doc_id, string_split(y, E'\n') AS ls FROM fm),
fe AS (SELECT doc_id, ls, list_min(list_filter(list_transform(ls, lambda l, i: CASE WHEN i > 1 AND trim(l, E' \t') IN ('---', '...') THEN i END), lambda i: i IS NOT NULL)) AS stop FROM fl)"""


@query("txt13_frontmatter", f"WITH {FRONT} SELECT doc_id, CASE WHEN trim(ls[1], E' \\t') = '---' AND stop IS NOT NULL THEN array_to_string(ls[2:stop-1], E'\\n') END AS block FROM fe")
def txt13(spark, sf_dir):
    t, i = F.col("text"), F.col("doc_id")
    y = (
        F.when(i % 5 == 0, F.concat(F.lit("---\ntitle: t"), i.cast("string"), F.lit("\n---\n"), t))
        .when(i % 5 == 1, F.concat(F.lit(" --- \na: 1\nb: 2\n... \n"), t))
        .when(i % 5 == 2, F.concat(F.lit("---\nopen\n"), F.replace(t, F.lit("---"), F.lit(""))))
        .otherwise(t)
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.front_block(y).alias("block"))


@query("txt14_frontmatter_problems")
def txt14(spark, sf_dir):
    """YAML blocks parsed and held against the schema; beyond SQL."""
    from ..functions.detect import front_problem

    i = F.col("doc_id")
    block = F.when(i % 3 == 0, F.concat(F.lit("title: t"), i.cast("string"), F.lit("\nnormalizer: {}\nsource: {}\noutput: {}"))).when(i % 3 == 1, F.lit("title: a\ntitle: b")).otherwise(F.lit("- a\n- b"))
    return table(spark, sf_dir, "documents").select("doc_id", block.alias("block")).select("doc_id", front_problem("block").alias("problem"))


@query("txt16_ids", "SELECT event_id, 'run_' || strftime(ts, '%Y%m%dT%H%M%SZ') || '_' || left(sha256(CAST(event_id AS VARCHAR)), 6) AS run_id, 'run_' || strftime(ts, '%Y%m%dT%H%M%SZ') || '_' || left(sha256(CAST(event_id AS VARCHAR)), 6) || '/a' || (event_id % 100 + 1) AS action_id FROM events")
def txt16(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", T.run_id(F.col("ts"), F.col("event_id")).alias("run_id"))
    return events.select("event_id", "run_id", F.concat("run_id", F.lit("/a"), (F.col("event_id") % 100 + 1).cast("string")).alias("action_id"))


@query("txt17_allocated", "SELECT doc_id, CAST((n_chars + 4095) // 4096 * 4096 AS BIGINT) AS allocated FROM documents")
def txt17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.allocated_bytes(F.col("n_chars"), 4096).alias("allocated"))


@query("txt18_ratio_up", "SELECT doc_id, CAST((CAST(doc_id AS HUGEINT) * 1000000000000 + n_chars + 1 - 1) // (n_chars + 1) AS BIGINT) AS units FROM documents")
def txt18(spark, sf_dir):
    up = T.ratio_up("doc_id", "n_chars + 1")
    return table(spark, sf_dir, "documents").select("doc_id", (up * 10**12).cast("long").alias("units"))
