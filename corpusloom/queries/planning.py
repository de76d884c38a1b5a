"""Filters, gates, ledger and plan over dirtied documents with invented facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches, pruned
from ..functions.paths import contained
from ..functions.text import Rules
from ..plans import planner as P
from .base import DIRTY, STEPS, dirty_docs, query, table

TABBED = Rules(tabs=True)
CONFIG = P.Config(rules=TABBED, exclude=(".git/", "lib/07/", "!lib/07/doc000060*", "**/doc0001?9.*"), max_bytes=100_000)

#: Facts that real bytes would seldom show, by doc_id.
FACTS = """SELECT doc_id, CASE WHEN doc_id % 29 = 3 THEN 2 ELSE 1 END AS nlink, CASE WHEN doc_id % 31 = 4 THEN 200000 ELSE 5000 END AS size_bytes,
  doc_id % 97 = 13 AS nul_bytes, CASE WHEN doc_id % 8 = 7 THEN 'utf-8' END AS bom, doc_id % 11 <> 5 AS utf8_valid,
  CASE WHEN doc_id % 13 <> 0 THEN (doc_id * 37 % 100) / 100.0 END AS confidence, doc_id * 7 % 60 AS non_ascii_bytes FROM {documents}"""
FACTS_SQL = FACTS.format(documents="documents")
GATE_SQL = """CASE WHEN path LIKE '%.TXT' OR path LIKE '.git/%' OR (path LIKE 'lib/07/%' AND NOT regexp_matches(path, '^lib/07/doc000060')) OR regexp_matches(path, '(^|/)doc0001[^/]9[.][^/]*$') THEN 'excluded'
  WHEN nlink > 1 THEN 'hard-link-alias' WHEN size_bytes > 100000 THEN 'oversize'
  WHEN NOT nul_bytes AND bom IS NULL AND NOT utf8_valid THEN CASE WHEN confidence IS NULL THEN 'binary-suspect' WHEN confidence < 0.8 THEN 'low-confidence-encoding' WHEN non_ascii_bytes < 20 THEN 'below-non-ascii-floor' END END"""


def facts(spark, sf_dir) -> DataFrame:
    return spark.sql(FACTS, documents=table(spark, sf_dir, "documents")).withColumn("confidence", F.col("confidence").cast("double"))


def inventory(spark, sf_dir) -> DataFrame:
    return dirty_docs(spark, sf_dir).join(facts(spark, sf_dir), "doc_id")


@query("flt01_globs", f"WITH {DIRTY} SELECT path, NOT regexp_matches(path, '[.]htm$') AS included, (path LIKE 'lib/07/%' AND NOT regexp_matches(path, '^lib/07/doc000060')) OR regexp_matches(path, '(^|/)doc0001[^/]9[.][^/]*$') AS excluded FROM dirty")
def flt01(spark, sf_dir):
    path = F.col("path")
    return dirty_docs(spark, sf_dir).select("path", matches(path, ["*", "!*.htm"]).alias("included"), matches(path, list(CONFIG.exclude)).alias("excluded"))


@query("src03_pruning", f"WITH {DIRTY}, d AS (SELECT DISTINCT left(path, 6) AS directory FROM dirty) SELECT directory, directory IN ('lib/07', 'lib/10', 'lib/11', 'lib/12') AS pruned FROM d")
def src03(spark, sf_dir):
    dirs = dirty_docs(spark, sf_dir).select(F.left("path", F.lit(6)).alias("directory")).distinct()
    return dirs.select("directory", pruned(F.col("directory"), ["lib/07/", "!lib/07/doc*", "lib/1[0-2]/"]).alias("pruned"))


@query("flt02_gate_ladder", f"WITH {DIRTY}, f AS ({FACTS_SQL}) SELECT path, {GATE_SQL} AS reason FROM dirty JOIN f USING (doc_id)")
def flt02(spark, sf_dir):
    return inventory(spark, sf_dir).select("path", P.gate(CONFIG).alias("reason"))


@query("flt03_symlinks", "SELECT p_partkey AS link, CASE WHEN p_partkey % 9 = 0 THEN 'excluded' ELSE 'symlink' END AS reason, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '-> ' || p_name END AS detail FROM part")
def flt03(spark, sf_dir):
    links = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.when(F.col("p_partkey") % 9 == 0, F.lit("skip/")).otherwise(F.lit("keep/")), F.col("p_partkey").cast("string")).alias("path"))
    out = matches(F.col("path"), ["skip/"])
    return links.select(F.col("p_partkey").alias("link"), F.when(out, F.lit("excluded")).otherwise(F.lit("symlink")).alias("reason"), F.when(out, F.lit("")).otherwise(F.concat(F.lit("-> "), F.col("p_name"))).alias("detail"))


@query("flt04_nul_split")
def flt04(spark, sf_dir):
    """Whole texts, with a NUL at their end, in UTF-16 without its mark, as they are, and in UTF-16 with it; by brute force in the tests."""
    from ..functions.facts import with_facts

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    i, t = F.col("doc_id") % 4, F.col("t")
    content = F.when(i == 0, F.concat(F.encode(t, "UTF-8"), F.unhex(F.lit("00")))).when(i == 1, F.encode(t, "UTF-16LE")).when(i == 2, F.encode(t, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE")))
    files = with_facts(docs.select("doc_id", content.alias("content")))
    return files.select("doc_id", P.nul_reason(F.col("content"), F.col("nul_bytes"), F.col("bom")).alias("reason"))


LIVE = """SELECT doc_id, n_chars AS size_bytes, 's' || doc_id AS sha, CASE WHEN doc_id % 10 = 3 THEN n_chars + 1 ELSE n_chars END AS now_size,
  CASE WHEN doc_id % 10 = 4 THEN 'other' ELSE 's' || doc_id END AS now_sha FROM {documents}"""


@query("flt06_changed_since_scan", f"WITH l AS ({LIVE.format(documents='documents')}) SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN 'unreadable' WHEN size_bytes <> now_size OR sha <> now_sha THEN 'changed-since-scan' END AS reason FROM l")
def flt06(spark, sf_dir):
    both = spark.sql(LIVE, documents=table(spark, sf_dir, "documents"))
    scanned = both.select("doc_id", "size_bytes", "sha")
    now = both.where("doc_id % 10 <> 5").select("doc_id", "now_size", "now_sha")
    rows = scanned.join(now, "doc_id", "left")
    return rows.select("doc_id", P.changed_reason(F.col("size_bytes"), F.col("sha"), F.col("now_size"), F.col("now_sha")).alias("reason"))


QUERY_JON03 = "SELECT doc_id, n_chars, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars + doc_id % 2 END AS now FROM documents"


@query("jon03_staleness", f"WITH s AS ({QUERY_JON03}) SELECT doc_id, CASE WHEN now IS NULL THEN 'missing' WHEN now <> n_chars THEN 'stale' ELSE 'same' END AS state FROM s")
def jon03(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    live = docs.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") + F.col("doc_id") % 2).alias("now"))
    rows = docs.join(live, F.col("doc_id") == F.col("id"), "left")
    return rows.select("doc_id", F.when(F.col("id").isNull(), F.lit("missing")).when(~F.col("now").eqNullSafe(F.col("n_chars")), F.lit("stale")).otherwise(F.lit("same")).alias("state"))


@query("flt07_decode_failures", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'decode-replacement' END AS reason FROM documents WHERE length(text) > 0")
def flt07(spark, sf_dir):
    """Strict decoding of bytes of which every fourth row's are cut inside a character."""
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("E282")))
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.when(F.col("doc_id") % 4 == 1, broken).otherwise(F.encode("text", "UTF-8")).alias("c"))
    return docs.select("doc_id", F.when(F.try_validate_utf8(F.col("c").cast("string")).isNull(), F.lit("decode-replacement")).alias("reason"))


@query("flt07_legacy_decode")
def flt07_legacy(spark, sf_dir):
    """Codecs that Spark lacks, decoded strictly; beyond SQL."""
    from ..functions.detect import decoded

    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("c"), F.when(F.col("doc_id") % 2 == 0, F.lit("cp1252")).otherwise(F.lit("utf-8")).alias("name"))
    rows = docs.select("doc_id", decoded("c", F.lit(None).cast("string"), "name").alias("d"))
    return rows.select("doc_id", F.sha2("d.text", 256).alias("digest"), "d.error_at")


@query("flt09_containment", """SELECT doc_id, doc_id % 5 IN (0, 3) AS contained FROM documents""")
def flt09(spark, sf_dir):
    i, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    path = F.when(i == 0, F.concat(F.lit("a/../b/"), n)).when(i == 1, F.concat(F.lit("../b/"), n)).when(i == 2, F.concat(F.lit("/b/"), n)).when(i == 3, F.concat(F.lit("./a//b/"), n)).otherwise(F.concat(F.lit("a/../../b/a/"), n))
    return table(spark, sf_dir, "documents").select("doc_id", contained(path).alias("contained"))


#: Paths of shared stems, so that renames meet; one row per path.
STEMS = """SELECT path, min(doc_id) AS doc_id FROM (SELECT doc_id, 'lib/' || lpad(CAST((doc_id - doc_id % 3) % 53 AS STRING), 2, '0') || '/doc' || lpad(CAST(doc_id - doc_id % 3 AS STRING), 6, '0') ||
  CASE doc_id % 7 WHEN 1 THEN '.TXT' WHEN 2 THEN '.md' WHEN 3 THEN '.html' WHEN 6 THEN '.Txt' ELSE '.txt' END AS path FROM {documents}) GROUP BY path"""
LEDGER_SQL = f"""WITH p AS ({STEMS.format(documents='documents')}),
o AS (SELECT path, doc_id, CASE WHEN lower(path) LIKE '%.txt' THEN left(path, length(path) - 4) || '.md' END AS target, lower(path) LIKE '%.txt' OR doc_id % 4 = 0 AS works FROM p),
k AS (SELECT *, coalesce(target, path) AS key, target IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.path = o.target) AS taken FROM o),
w AS (SELECT key, min(path) AS winner FROM k WHERE works AND NOT (taken AND {{blocks}}) GROUP BY key)
SELECT path, target, CASE WHEN works AND ((taken AND {{blocks}}) OR path <> winner) THEN 'collision' END AS reason,
  CASE WHEN works AND winner < path THEN winner END AS winner FROM k LEFT JOIN w USING (key)"""


def stems(spark, sf_dir) -> DataFrame:
    rows = spark.sql(STEMS, documents=table(spark, sf_dir, "documents"))
    ops = F.array_compact(F.array(F.when(F.col("doc_id") % 4 == 0, F.lit("normalize_newlines")), F.when(F.lower("path").like("%.txt"), F.lit("rename"))))
    return rows.withColumn("ops", ops)


@query("win01_output_ledger", LEDGER_SQL.replace("{blocks}", "true"))
def win01(spark, sf_dir):
    rows = stems(spark, sf_dir)
    return P.ledger(rows, rows, "skip").select("path", "target", "reason", "winner")


@query("pln03_overwrite_ledger", LEDGER_SQL.replace("{blocks}", "false"))
def pln03(spark, sf_dir):
    rows = stems(spark, sf_dir)
    return P.ledger(rows, rows, "overwrite").select("path", "target", "reason", "winner")


@query("jon02_target_exists", f"WITH p AS ({STEMS.format(documents='documents')}) SELECT path FROM p a WHERE lower(path) LIKE '%.txt' AND EXISTS (SELECT 1 FROM p b WHERE b.path = left(a.path, length(a.path) - 4) || '.md')")
def jon02(spark, sf_dir):
    from ..functions.text import rename_target

    rows = stems(spark, sf_dir)
    candidates = rows.select("path", rename_target(F.col("path")).alias("candidate")).where("candidate IS NOT NULL")
    return candidates.join(rows.select(F.col("path").alias("candidate")), "candidate", "left_semi").select("path")


@query("pln02_reencode", f"WITH {STEPS} SELECT doc_id, array_to_string(ops, ',') AS ops, sha256(x5) AS digest FROM planned")
def pln02(spark, sf_dir):
    out = P.operations(dirty_docs(spark, sf_dir), TABBED)
    return out.select("doc_id", F.array_join("ops", ",").alias("ops"), F.sha2("new_text", 256).alias("digest"))


PLAN_CTE = f"""WITH {STEPS}, f AS ({FACTS_SQL}),
g AS (SELECT p.*, nlink, size_bytes, coalesce({GATE_SQL}, CASE WHEN nul_bytes AND bom IS NULL THEN 'nul-bytes' END) AS early FROM planned p JOIN f USING (doc_id)),
r AS (SELECT path, early, CASE WHEN early IS NULL THEN array_to_string(ops, ',') ELSE '' END AS ops, early IS NULL AND len(ops) > 0 AS works,
  CASE WHEN early IS NULL AND list_contains(ops, 'rename') THEN left(path, length(path) - 4) || '.md' END AS target FROM g),
t AS (SELECT path, early AS reason, ops, target, CASE WHEN early IS NOT NULL THEN 'skip' WHEN works THEN 'action' ELSE 'noop' END AS disposition FROM r)"""
PLAN_SQL = f"""{PLAN_CTE}
SELECT path, disposition, reason, ops, target, CASE WHEN disposition = 'action' THEN CAST(row_number() OVER (PARTITION BY disposition ORDER BY path) AS BIGINT) END AS seq FROM t"""


@query("pln01_plan", PLAN_SQL)
def pln01(spark, sf_dir):
    return P.build_plan(inventory(spark, sf_dir), CONFIG).select("path", "disposition", "reason", "ops", "target", "seq")


@query("win02_action_numbers", f"WITH {DIRTY} SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS seq FROM dirty WHERE kind = 'text'")
def win02(spark, sf_dir):
    return P.numbered(dirty_docs(spark, sf_dir).where("kind = 'text'").select("path"), "path")


@query("pln04_plan_verdict", f"WITH {DIRTY}, f AS ({FACTS_SQL}), g AS (SELECT {GATE_SQL} AS reason FROM dirty JOIN f USING (doc_id)) SELECT count(*) FILTER (WHERE reason IN ('low-confidence-encoding', 'below-non-ascii-floor')) AS findings, CAST(count(*) FILTER (WHERE reason IN ('low-confidence-encoding', 'below-non-ascii-floor')) > 0 AS BIGINT) AS exit_code FROM g")
def pln04(spark, sf_dir):
    return P.verdict(inventory(spark, sf_dir).select(P.gate(CONFIG).alias("reason")), fail_low_confidence=True)


@query("agg01_skip_counts", f"WITH {DIRTY}, f AS ({FACTS_SQL}), g AS (SELECT {GATE_SQL} AS reason FROM dirty JOIN f USING (doc_id)) SELECT reason, count(*) AS n FROM g WHERE reason IS NOT NULL GROUP BY reason")
def agg01(spark, sf_dir):
    return inventory(spark, sf_dir).select(P.gate(CONFIG).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("agg08_partition_check", f"{PLAN_CTE} SELECT count(*) AS paths, count(*) FILTER (WHERE disposition = 'action') AS actions, count(*) FILTER (WHERE disposition = 'skip') AS skips, count(*) FILTER (WHERE disposition = 'noop') AS noops, CAST(0 AS BIGINT) AS torn FROM t")
def agg08(spark, sf_dir):
    """Actions, skips and no-ops together are the inventory, and no path is two of them."""
    files = inventory(spark, sf_dir)
    tags = files.select("path", F.lit("file").alias("disposition")).unionByName(P.build_plan(files, CONFIG).select("path", "disposition"))
    per = tags.groupBy("path").agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in ("file", "action", "skip", "noop")])
    return per.agg(F.count("*").alias("paths"), F.sum("action").alias("actions"), F.sum("skip").alias("skips"), F.sum("noop").alias("noops"), F.count_if((F.col("file") != 1) | (F.col("action") + F.col("skip") + F.col("noop") != 1)).alias("torn"))
