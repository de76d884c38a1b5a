"""Verification over outcomes and records invented from document numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import apply as A
from ..plans import chain as C
from ..plans import lineage as L
from ..plans import verify as V
from .base import DIRTY, dirty_docs, query, table
from .chain import LAST, records

#: Three attempts' outcomes; some are reported twice, some name no planned action.
OUTCOMES = """
  SELECT attempt, action_id, CASE WHEN status = 'would_apply' THEN NULL WHEN status = 'skipped' AND doc_id % 2 = 0 THEN 'already-applied' ELSE status END AS observation, status, doc_id, line FROM (
    SELECT 1 AS attempt, 'run/a' || doc_id AS action_id, doc_id, 1 AS line, CASE WHEN doc_id % 5 = 4 THEN 'not-attempted' WHEN doc_id % 7 = 3 THEN 'failed' WHEN doc_id % 71 = 5 THEN 'would_apply' ELSE 'applied' END AS status FROM {documents} WHERE doc_id % 83 <> 4
    UNION ALL SELECT 2, 'run/a' || doc_id, doc_id, 2, CASE WHEN doc_id % 5 = 4 THEN 'applied' WHEN doc_id % 7 = 3 THEN 'skipped' ELSE 'skipped' END FROM {documents} WHERE doc_id % 3 = 0
    UNION ALL SELECT 1, 'run/a' || doc_id, doc_id, 3, 'failed' FROM {documents} WHERE doc_id % 89 = 11
    UNION ALL SELECT 3, 'other/a' || doc_id, doc_id, 4, 'skipped' FROM {documents} WHERE doc_id % 97 = 2
  ) o"""
OUT = f"outc AS ({OUTCOMES.format(documents='documents')})"
ONCE = f"{LAST}, {OUT}, once AS (SELECT attempt, action_id, observation FROM outc QUALIFY row_number() OVER (PARTITION BY attempt, action_id ORDER BY line) = 1)"
#: The fold as a recursion over each action's observations.
FOLD = """, n AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY attempt) AS k FROM {source} WHERE observation IS NOT NULL),
f AS (SELECT action_id, k, CASE observation WHEN 'already-applied' THEN 'applied' ELSE observation END AS state, '' AS illegal FROM n WHERE k = 1
  UNION ALL SELECT n.action_id, n.k, CASE WHEN ok AND n.observation <> 'already-applied' THEN n.observation ELSE f.state END,
    CASE WHEN ok THEN f.illegal ELSE f.illegal || CASE WHEN f.illegal = '' THEN '' ELSE ',' END || f.state || '>' || n.observation END
  FROM f JOIN n ON n.action_id = f.action_id AND n.k = f.k + 1, LATERAL (SELECT (f.state || '>' || n.observation) IN ('not-attempted>skipped', 'not-attempted>failed', 'not-attempted>applied', 'failed>applied', 'applied>already-applied') AS ok) z),
fin AS (SELECT action_id, arg_max(state, k) AS state, arg_max(illegal, k) AS illegal FROM f GROUP BY action_id)"""


def outcomes(spark, sf_dir):
    return spark.sql(OUTCOMES, documents=table(spark, sf_dir, "documents"))


def once(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("attempt", "action_id").agg(F.min_by("observation", "line").alias("observation"))


@query("win07_report_fold", f"{ONCE.replace('WITH ', 'WITH RECURSIVE ', 1)}{FOLD.format(source='once')} SELECT action_id, state, illegal FROM fin")
def win07(spark, sf_dir):
    return V.report_states(once(spark, sf_dir))


APPLIED = "ma AS (SELECT DISTINCT action_id FROM rec WHERE kind = 'apply' AND result = 'applied' AND undoes_action_id IS NULL)"
COVER = f"""{ONCE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {APPLIED}, plan AS (SELECT 'run/a' || doc_id AS action_id FROM documents UNION ALL SELECT 'run/a' || doc_id FROM documents WHERE doc_id % 101 = 3),
cl AS (SELECT * FROM once WHERE observation IN ('applied', 'already-applied') AND action_id NOT IN (SELECT action_id FROM ma)),
tr AS (SELECT * FROM once o WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.attempt = o.attempt AND cl.action_id = o.action_id)){FOLD.format(source='tr')},
op AS (SELECT action, state FROM lc WHERE state NOT IN ('applied', 'failed')),
ce AS (SELECT action AS action_id FROM lc WHERE state IN ('applied', 'failed') UNION SELECT action_id FROM fin WHERE action_id NOT IN (SELECT action FROM lc)),
pv AS (SELECT DISTINCT action_id FROM once WHERE observation IS NULL AND action_id NOT IN (SELECT action_id FROM ce) AND action_id NOT IN (SELECT action FROM op)),
x AS (SELECT action_id, 'coverage' AS check_name, 'planned twice' AS detail FROM plan GROUP BY action_id HAVING count(*) > 1
  UNION ALL SELECT action, 'coverage', 'lifecycle is ' || state FROM op
  UNION ALL SELECT action_id, 'coverage', 'reported twice in ' || attempt FROM outc GROUP BY action_id, attempt HAVING count(*) > 1
  UNION ALL SELECT action_id, 'coverage', 'claims without record: ' || observation FROM cl
  UNION ALL SELECT action_id, 'coverage', 'illegal steps: ' || illegal FROM fin WHERE illegal <> ''
  UNION ALL SELECT action_id, 'coverage', fin.state || ' against ' || lc.state FROM fin JOIN lc ON lc.action = fin.action_id WHERE lc.state = 'pending-intent' OR fin.state <> CASE lc.state WHEN 'failed' THEN 'failed' ELSE 'applied' END
  UNION ALL SELECT action_id, 'coverage-uncertified', 'dry run only' FROM pv
  UNION ALL SELECT DISTINCT action_id, 'coverage', 'no end' FROM plan WHERE action_id NOT IN (SELECT action_id FROM ce) AND action_id NOT IN (SELECT action_id FROM pv) AND action_id NOT IN (SELECT action FROM op)
  UNION ALL SELECT action_id, 'coverage', 'not planned' FROM (SELECT action AS action_id FROM lc UNION SELECT action_id FROM once) WHERE action_id NOT IN (SELECT action_id FROM plan))"""


def covered(spark, sf_dir):
    docs, rec = table(spark, sf_dir, "documents"), records(spark, sf_dir)
    action = F.concat(F.lit("run/a"), F.col("doc_id").cast("string")).alias("action_id")
    plan = docs.select(action).unionByName(docs.where("doc_id % 101 = 3").select(action))
    applied = rec.where("kind = 'apply' AND result = 'applied' AND undoes_action_id IS NULL").select("action_id").distinct()
    return V.coverage(plan, C.lifecycle(rec).select(F.col("action").alias("action_id"), "state"), outcomes(spark, sf_dir), applied)


@query("ver11_coverage", f"{COVER} SELECT action_id, check_name, detail FROM x")
def ver11(spark, sf_dir):
    return covered(spark, sf_dir).withColumnRenamed("check", "check_name")


@query("ver12_contradictions", f"{COVER} SELECT action_id, detail FROM x WHERE detail LIKE '% against %'")
def ver12(spark, sf_dir):
    return covered(spark, sf_dir).where("detail LIKE '% against %'").select("action_id", "detail")


@query("jon06_plan_evidence", f"{COVER} SELECT detail, count(*) AS n FROM x WHERE detail IN ('no end', 'not planned') GROUP BY detail")
def jon06(spark, sf_dir):
    return covered(spark, sf_dir).where("detail IN ('no end', 'not planned')").groupBy("detail").agg(F.count("*").alias("n"))


ACCOUNT = f"""{ONCE}, {APPLIED}, mr AS (SELECT DISTINCT CAST(set_index AS INT) AS attempt, action_id FROM rec WHERE kind = 'apply' AND result = 'applied'),
x AS (SELECT attempt, action_id, 'reported-not-recorded' AS check_name FROM once o WHERE observation = 'applied' AND NOT EXISTS (SELECT 1 FROM mr WHERE mr.attempt = o.attempt AND mr.action_id = o.action_id)
  UNION ALL SELECT attempt, action_id, 'recorded-not-reported' FROM mr WHERE NOT EXISTS (SELECT 1 FROM once o WHERE mr.attempt = o.attempt AND mr.action_id = o.action_id))"""


def accounts(spark, sf_dir):
    said = once(spark, sf_dir)
    recorded = records(spark, sf_dir).where("kind = 'apply' AND result = 'applied'").select(F.col("set_index").alias("attempt"), "action_id").distinct()
    return V.accounting(said.where("observation = 'applied'").select("attempt", "action_id"), recorded, said.select("attempt", "action_id"))


@query("jon05_accounting", f"{ACCOUNT} SELECT CAST(attempt AS BIGINT) AS attempt, action_id, check_name FROM x")
def jon05(spark, sf_dir):
    return accounts(spark, sf_dir).select(F.col("attempt").cast("long").alias("attempt"), "action_id", F.col("check").alias("check_name"))


@query("ver09_accounting", f"{ACCOUNT} SELECT check_name, count(*) AS n FROM x GROUP BY check_name")
def ver09(spark, sf_dir):
    return accounts(spark, sf_dir).groupBy(F.col("check").alias("check_name")).agg(F.count("*").alias("n"))


@query("ver10_unprovable", f"{ONCE} SELECT DISTINCT CAST(set_index AS BIGINT) AS attempt FROM rec WHERE kind = 'apply' AND CAST(set_index AS INT) NOT IN (SELECT attempt FROM once WHERE attempt <> 2)")
def ver10(spark, sf_dir):
    """Attempts with mutations but no report (the second one's is taken away)."""
    recorded = records(spark, sf_dir).withColumn("attempt", F.col("set_index"))
    return V.unprovable(recorded, outcomes(spark, sf_dir).where("attempt <> 2")).select(F.col("attempt").cast("long").alias("attempt"))


LIVE = "lv AS (SELECT 't' || doc_id AS path, CASE WHEN doc_id % 10 = 1 THEN 'zz' ELSE 'c' || doc_id END AS live_sha FROM documents WHERE doc_id % 10 <> 2)"


@query("ver06_output_hash", f"""{LAST}, {LIVE}, ap AS (SELECT action_id, target_path, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE after_sha END AS after_sha FROM rec WHERE kind = 'apply' AND result = 'applied')
SELECT action_id, CASE WHEN after_sha IS NULL THEN 'no-after-hash' WHEN path IS NULL THEN 'output-missing' ELSE 'output-hash' END AS check_name FROM ap LEFT JOIN lv ON target_path = path WHERE after_sha IS NULL OR path IS NULL OR live_sha <> after_sha""")
def ver06(spark, sf_dir):
    i = F.col("doc_id")
    live = table(spark, sf_dir, "documents").where("doc_id % 10 <> 2").select(F.concat(F.lit("t"), i.cast("string")).alias("path"), F.when(i % 10 == 1, F.lit("zz")).otherwise(F.concat(F.lit("c"), i.cast("string"))).alias("live_sha"))
    applied = records(spark, sf_dir).where("kind = 'apply' AND result = 'applied'").withColumn("after_sha", F.when(i % 19 != 0, F.col("after_sha")))
    return V.output_findings(applied, live).withColumnRenamed("check", "check_name")


BACKUPS = "SELECT 'run/a' || doc_id AS action_id, CASE WHEN doc_id % 3 <> 0 THEN 'k' || doc_id END AS backup_path, 'b' || doc_id AS before_sha, CASE WHEN doc_id % 4 = 0 THEN 'o' || doc_id END AS overwritten_backup_path, 'v' || doc_id AS overwritten_sha, doc_id FROM {documents}"
HELD = "SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN 'bad' ELSE 'b' || doc_id END AS sha FROM {documents} WHERE doc_id % 13 <> 1 UNION ALL SELECT 'o' || doc_id, 'v' || (doc_id + CASE WHEN doc_id % 12 = 0 THEN 1 ELSE 0 END) FROM {documents} WHERE doc_id % 16 <> 0"
BACK_SQL = f"""WITH r AS ({BACKUPS.format(documents='documents')}), h AS ({HELD.format(documents='documents')}),
c AS (SELECT action_id, 'source' AS role, backup_path AS k, before_sha AS e FROM r UNION ALL SELECT action_id, 'overwritten', overwritten_backup_path, overwritten_sha FROM r),
x AS (SELECT action_id, role, CASE WHEN h.key IS NULL THEN 'backup-missing' ELSE 'backup-hash' END AS check_name FROM c LEFT JOIN h ON c.k = h.key WHERE k IS NOT NULL AND (h.key IS NULL OR h.sha <> e))"""


def backups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return V.backup_findings(spark.sql(BACKUPS, documents=docs), spark.sql(HELD, documents=docs)).withColumnRenamed("check", "check_name")


query("ver07_backup_hash", f"{BACK_SQL} SELECT action_id, role, check_name FROM x")(backups)
query("jon11_backup_roles", f"{BACK_SQL} SELECT role, check_name, count(*) AS n FROM x GROUP BY role, check_name")(lambda spark, sf_dir: backups(spark, sf_dir).groupBy("role", "check_name").agg(F.count("*").alias("n")))


FRONT = ["title: t\nnormalizer: {}\nsource: {}\noutput: {}", "title: a\ntitle: b", "x: 1"]


@query("ver02_frontmatter_check", f"WITH {DIRTY} SELECT path, 'frontmatter' AS check_name FROM dirty WHERE path LIKE '%.md' AND doc_id % 4 <> 3 AND doc_id % 3 <> 0")
def ver02(spark, sf_dir):
    """Blocks before whole texts, of which every fourth has none."""
    i = F.col("doc_id")
    block = F.when(i % 3 == 0, F.lit(FRONT[0])).when(i % 3 == 1, F.lit(FRONT[1])).otherwise(F.lit(FRONT[2]))
    x = F.when(i % 4 == 3, F.concat(F.lit("x\n"), F.col("x"))).otherwise(F.concat(F.lit("---\n"), block, F.lit("\n---\n"), F.col("x")))
    return V.frontmatter_findings(dirty_docs(spark, sf_dir).select("path", x.alias("x"))).select("path", F.col("check").alias("check_name"))


@query("ver03_discovery_findings", f"WITH {DIRTY} SELECT path, CASE doc_id % 5 WHEN 0 THEN 'discovery-unreadable' ELSE 'discovery-timeout' END AS check_name FROM dirty WHERE doc_id % 5 < 2 UNION ALL SELECT NULL, 'zero-checked'")
def ver03(spark, sf_dir):
    """Skips of five reasons, of a scan that then had nothing left to check."""
    rows, i = dirty_docs(spark, sf_dir), F.col("doc_id")
    reason = F.when(i % 5 == 0, F.lit("unreadable")).when(i % 5 == 1, F.lit("timeout")).otherwise(F.lit("excluded"))
    return V.discovery_findings(rows.select("path", reason.alias("reason")), rows.limit(0)).select("path", F.col("check").alias("check_name"))


@query("ver04_root_agreement", "SELECT 'run' || s_suppkey AS run_id, '/lib' || (s_nationkey % 3) || ' is not /lib1' AS detail FROM supplier WHERE s_nationkey % 3 <> 1")
def ver04(spark, sf_dir):
    heads = table(spark, sf_dir, "supplier").select(F.concat(F.lit("run"), F.col("s_suppkey").cast("string")).alias("run_id"), F.concat(F.lit("/lib"), (F.col("s_nationkey") % 3).cast("string")).alias("source_root"))
    return V.root_findings(heads, "/lib1").select("run_id", "detail")


@query("ver08_binding", "WITH a AS (SELECT o_custkey AS plan, o_orderkey AS place, o_orderpriority AS sha, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS expected FROM orders) SELECT plan, expected, string_agg(place || '=' || sha, '; ' ORDER BY place) AS mismatch FROM a WHERE sha <> expected GROUP BY plan, expected")
def ver08(spark, sf_dir):
    """Attempts whose plan isn't the first attempt's."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("plan_sha"))
    return L.binding_findings(rows)


@query("win10_not_attempted_tail", "WITH p AS (SELECT o_custkey AS plan, o_orderkey AS seq, o_orderkey % 13 = 0 AS abort FROM orders), q AS (SELECT *, max(CASE WHEN abort THEN 1 ELSE 0 END) OVER (PARTITION BY plan ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM p) SELECT plan, seq, CASE WHEN stopped = 1 THEN 'not-attempted' WHEN abort THEN 'skipped' ELSE 'applied' END AS status FROM q")
def win10(spark, sf_dir):
    """What an abort leaves of the plan after it."""
    abort = F.col("o_orderkey") % 13 == 0
    return A.after_abort(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("seq"), F.when(abort, F.lit("skipped")).otherwise(F.lit("applied")).alias("status"), abort.alias("abort")))


@query("win08_heartbeats", "WITH h AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id AS run, event_id AS place, CASE WHEN value < before THEN 'falls' ELSE 'passes the total' END AS problem FROM h WHERE value < before OR value > 90")
def win08(spark, sf_dir):
    """Progress counts that fall from one line to the next, or pass their total."""
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), F.col("value").alias("processed"), F.lit(0).alias("skipped"), F.lit(0).alias("failed"), F.lit(90).alias("total"))
    return V.heartbeat_findings(lines)
