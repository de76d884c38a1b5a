"""Chains, lifecycles and restores over records invented from document numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import chain as C
from .base import query, table

#: Two apply sets and a restore.  ``phase`` orders an action's records; a tenth of the rows break some rule.
RECORDS = """
  SELECT set_index, kind, CAST(row_number() OVER (PARTITION BY set_index ORDER BY doc_id, phase) AS BIGINT) AS seq, doc_id, action_id, undoes_action_id,
    operation, original_path, target_path, before_sha, CASE WHEN result = 'failed' AND doc_id % 17 <> 2 THEN NULL ELSE after_sha END AS after_sha, result
  FROM (
    SELECT doc_id, set_index, kind, phase, CASE WHEN kind = 'restore' THEN 'r/a' || doc_id ELSE 'run/a' || doc_id END AS action_id,
      CASE WHEN kind = 'restore' AND doc_id % 53 <> 6 THEN 'run/a' || doc_id END AS undoes_action_id,
      CASE doc_id % 3 WHEN 0 THEN 'rename' WHEN 1 THEN 'rewrite' ELSE 'rename_and_rewrite' END AS operation,
      'p' || doc_id AS original_path, CASE WHEN result <> 'intent' AND doc_id % 43 = 5 THEN 'q' || doc_id ELSE 't' || doc_id END AS target_path,
      'b' || doc_id AS before_sha, CASE WHEN result <> 'intent' AND doc_id % 47 = 6 THEN 'x' ELSE 'c' || doc_id END AS after_sha, result
    FROM (
      SELECT doc_id, 1 AS set_index, 'apply' AS kind, 1 AS phase, 'intent' AS result FROM {documents} WHERE doc_id % 37 <> 9
      UNION ALL SELECT doc_id, 1, 'apply', CASE WHEN doc_id % 59 = 8 THEN 0 ELSE 2 END, CASE WHEN doc_id % 7 = 3 THEN 'failed' ELSE 'applied' END FROM {documents} WHERE doc_id % 5 <> 4
      UNION ALL SELECT doc_id, 2, 'apply', 1, 'intent' FROM {documents} WHERE doc_id % 5 <> 4 AND doc_id % 7 = 3 AND doc_id % 2 = 0
      UNION ALL SELECT doc_id, 2, 'apply', 2, 'applied' FROM {documents} WHERE (doc_id % 5 <> 4 AND doc_id % 7 = 3 AND doc_id % 2 = 0) OR (doc_id % 5 = 4 AND doc_id % 3 = 0) OR doc_id % 61 = 10
      UNION ALL SELECT doc_id, 3, 'restore', 1, 'intent' FROM {documents} WHERE doc_id % 6 = 1
      UNION ALL SELECT doc_id, 3, 'restore', 2, CASE WHEN doc_id % 18 = 1 THEN 'failed' ELSE 'applied' END FROM {documents} WHERE doc_id % 12 = 1
    ) a
  ) b"""
REC = f"WITH rec AS ({RECORDS.format(documents='documents')})"
LAST = f"""{REC}, las AS (SELECT coalesce(undoes_action_id, action_id) AS action, * FROM rec QUALIFY row_number() OVER (PARTITION BY coalesce(undoes_action_id, action_id) ORDER BY set_index DESC, seq DESC) = 1),
lc AS (SELECT action, set_index, seq, after_sha, target_path, CASE WHEN kind = 'restore' THEN CASE result WHEN 'intent' THEN 'pending-restore' WHEN 'applied' THEN 'restored' ELSE 'restore-failed' END
  ELSE CASE result WHEN 'intent' THEN 'pending-intent' ELSE result END END AS state FROM las)"""


def records(spark, sf_dir):
    return spark.sql(RECORDS, documents=table(spark, sf_dir, "documents"))


def of(name: str, sql: str, make) -> None:
    query(name, sql)(lambda spark, sf_dir: make(records(spark, sf_dir)))


of("agg07_lifecycle", f"{LAST} SELECT action, state, set_index, seq, after_sha, target_path FROM lc", C.lifecycle)
of("win03_sequence", f"{REC}, bad AS (SELECT set_index, CASE WHEN doc_id % 41 = 7 THEN seq + 1 ELSE seq END AS seq, action_id, result FROM rec), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY set_index ORDER BY seq, action_id, result) AS BIGINT) AS place FROM bad) SELECT set_index, seq, place, action_id FROM p WHERE seq <> place",
   lambda r: C.sequence_gaps(r.withColumn("seq", F.when(F.col("doc_id") % 41 == 7, F.col("seq") + 1).otherwise(F.col("seq")))))
of("win04_per_set_lifecycle", f"{REC}, g AS (SELECT set_index, action_id, count(*) FILTER (WHERE result = 'intent') AS intents, count(*) FILTER (WHERE result <> 'intent') AS terminals, min(seq) FILTER (WHERE result = 'intent') AS fi, min(seq) FILTER (WHERE result <> 'intent') AS ft FROM rec GROUP BY ALL) SELECT set_index, action_id, intents, terminals FROM g WHERE intents > 1 OR terminals > 1 OR ft < fi", C.per_set_lifecycle)
of("win05_terminal_after_applied", f"{REC} SELECT set_index, seq, action_id FROM rec r WHERE result <> 'intent' AND EXISTS (SELECT 1 FROM rec e WHERE e.action_id = r.action_id AND e.result = 'applied' AND (e.set_index, e.seq) < (r.set_index, r.seq))", C.terminal_after_applied)
CHANGED = f"""{REC}, j AS (SELECT t.set_index, t.action_id, array_to_string(list_filter([CASE WHEN t.operation IS DISTINCT FROM i.operation THEN 'operation' END, CASE WHEN t.original_path IS DISTINCT FROM i.original_path THEN 'original_path' END,
  CASE WHEN t.target_path IS DISTINCT FROM i.target_path THEN 'target_path' END, CASE WHEN t.before_sha IS DISTINCT FROM i.before_sha THEN 'before_sha' END,
  CASE WHEN CASE WHEN t.result = 'failed' THEN t.after_sha IS NOT NULL ELSE t.after_sha IS DISTINCT FROM i.after_sha END THEN 'after_sha' END], lambda z: z IS NOT NULL), ',') AS fields
  FROM rec t JOIN rec i ON t.set_index = i.set_index AND t.action_id = i.action_id AND t.result <> 'intent' AND i.result = 'intent')
SELECT set_index, action_id, fields FROM j WHERE fields <> ''"""
of("chn04_set_immutables", CHANGED, C.changed_immutables)
of("jon07_immutables", CHANGED.replace("SELECT set_index, action_id, fields FROM j WHERE fields <> ''", "SELECT fields, count(*) AS n FROM j WHERE fields <> '' GROUP BY fields"), lambda r: C.changed_immutables(r).groupBy("fields").agg(F.count("*").alias("n")))
CROSS = f"""{REC}, s AS (SELECT *, lag(result) OVER w AS br, lag(operation) OVER w AS bo, lag(original_path) OVER w AS bp, lag(target_path) OVER w AS bt, lag(before_sha) OVER w AS bb,
  count(*) FILTER (WHERE result = 'intent') OVER (PARTITION BY set_index, action_id) AS intents FROM rec WINDOW w AS (PARTITION BY action_id ORDER BY set_index, seq))
SELECT set_index, action_id, coalesce(br = 'intent' AND bo = operation AND bp = original_path AND bt = target_path AND bb = before_sha, false) OR result = 'failed' AS legal FROM s WHERE result <> 'intent' AND intents = 0"""
of("chn06_cross_set", CROSS, C.standalone_terminals)
of("jon08_dangling_intents", f"SELECT legal, count(*) AS n FROM ({CROSS}) GROUP BY legal", lambda r: C.standalone_terminals(r).groupBy("legal").agg(F.count("*").alias("n")))
of("chn05_kind_lineage", f"{REC} SELECT set_index, seq, action_id FROM rec WHERE (kind = 'restore') <> (undoes_action_id IS NOT NULL)", C.kind_lineage)
UNKNOWN = f"{REC} SELECT set_index, seq, action_id, undoes_action_id FROM rec r WHERE undoes_action_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rec a WHERE a.kind = 'apply' AND a.result = 'applied' AND a.action_id = r.undoes_action_id)"
of("chn07_undoes", UNKNOWN, C.unknown_undoes)
of("jon09_undoes_semi", f"SELECT count(*) AS n FROM ({UNKNOWN})", lambda r: C.unknown_undoes(r).agg(F.count("*").alias("n")))
of("srt03_restore_order", f"{LAST} SELECT action, state, CAST(row_number() OVER (ORDER BY set_index DESC, seq DESC) AS BIGINT) AS turn FROM lc WHERE state IN ('applied', 'restore-failed', 'pending-restore')", C.restore_order)
of("rst04_inverse_records", f"{REC} SELECT 'undo/' || action_id AS action_id, action_id AS undoes_action_id, operation, target_path AS original_path, original_path AS target_path, after_sha AS before_sha, before_sha AS after_sha FROM rec WHERE kind = 'apply' AND result = 'applied'", lambda r: C.inverse_records(r, "undo"))
of("agg18_unrestorable", f"{REC} SELECT count(*) AS n FROM rec WHERE result = 'applied' AND operation <> 'rename' AND doc_id % 4 = 0", lambda r: r.agg(F.count_if((F.col("result") == "applied") & (F.col("operation") != "rename") & (F.col("doc_id") % 4 == 0)).alias("n")))
of("ver05_lifecycle_findings", f"{LAST} SELECT action, state FROM lc WHERE state NOT IN ('applied', 'failed')", lambda r: C.lifecycle(r).where("state NOT IN ('applied', 'failed')").select("action", "state"))
of("jon04_resume", f"{LAST} SELECT 'run/a' || doc_id AS action, CASE WHEN state = 'applied' THEN CASE WHEN doc_id % 6 = 0 THEN 'failed' ELSE 'already-applied' END WHEN state = 'pending-intent' THEN 'adjudicate' ELSE 'execute' END AS next FROM (SELECT DISTINCT doc_id FROM rec) LEFT JOIN lc ON action = 'run/a' || doc_id",
   lambda r: _resume(r))


def _resume(r):
    """What a resumed run does with each planned action: applied ones are held against the live bytes."""
    plan = r.select("doc_id").distinct()
    rows = plan.select("doc_id", F.concat(F.lit("run/a"), F.col("doc_id").cast("string")).alias("action")).join(C.lifecycle(r).select("action", "state", F.col("after_sha").alias("recorded")), "action", "left")
    live = F.when(F.col("doc_id") % 6 == 0, F.lit("changed")).otherwise(F.col("recorded"))
    matches = live.eqNullSafe(F.col("recorded"))
    return rows.select("action", F.when(F.col("state") == "applied", F.when(matches, F.lit("already-applied")).otherwise(F.lit("failed"))).when(F.col("state") == "pending-intent", F.lit("adjudicate")).otherwise(F.lit("execute")).alias("next"))


SETS = "SELECT CAST(o_orderkey AS BIGINT) AS set_index, CASE WHEN o_orderkey % 4 = 3 THEN 'restore' ELSE 'apply' END AS kind, 'root' AS source_root, CASE WHEN o_orderkey = 5 THEN 'p2' ELSE 'p1' END AS plan_sha, 'run' || (o_orderkey % 9) AS run_id FROM {orders} WHERE o_orderkey < 40"
SET_SQL = f"WITH st AS ({SETS.format(orders='orders')})"


@query("win06_apply_after_restore", f"{SET_SQL} SELECT set_index FROM st s WHERE kind = 'apply' AND EXISTS (SELECT 1 FROM st b WHERE b.kind = 'restore' AND b.set_index < s.set_index)")
def win06(spark, sf_dir):
    return C.apply_after_restore(spark.sql(SETS, orders=table(spark, sf_dir, "orders")))


@query("chn02_coherence", f"{SET_SQL} SELECT count(DISTINCT source_root) <= 1 AS one_root, count(DISTINCT plan_sha) <= 1 AS one_plan, count(DISTINCT run_id) = count(*) AS unique_runs FROM st")
def chn02(spark, sf_dir):
    return C.coherence(spark.sql(SETS, orders=table(spark, sf_dir, "orders")))


@query("chn01_chain_order", "WITH RECURSIVE h AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN 'sha' || (n_nationkey - 1) END AS prior_sha, 'sha' || n_nationkey AS sha FROM nation), c AS (SELECT id, sha, CAST(1 AS BIGINT) AS place FROM h WHERE prior_sha IS NULL UNION ALL SELECT h.id, h.sha, c.place + 1 FROM h JOIN c ON h.prior_sha = c.sha) SELECT CAST(id AS BIGINT) AS id, sha, place FROM c")
def chn01(spark, sf_dir):
    """Headers are few: they come to the driver, are walked there, and go back in order."""
    heads = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("run_id"), F.concat(F.lit("sha"), F.col("n_nationkey").cast("string")).alias("sha"), F.when(F.col("n_nationkey") > 0, F.concat(F.lit("sha"), (F.col("n_nationkey") - 1).cast("string"))).alias("prior_sha"))
    walked = C.ordered_sets([r.asDict() for r in heads.collect()])
    return spark.createDataFrame([(h["run_id"], h["sha"], i) for i, h in enumerate(walked, 1)], "id long, sha string, place long")


@query("chn03_attempt_lineage", "WITH a AS (SELECT s_suppkey AS i, 'run' || s_suppkey AS run_id, CASE WHEN s_suppkey > 1 THEN 'run' || (s_suppkey - CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END) END AS prior FROM supplier), l AS (SELECT *, lag(run_id) OVER (ORDER BY i) AS before FROM a) SELECT run_id, prior, before FROM l WHERE prior IS DISTINCT FROM before")
def chn03(spark, sf_dir):
    """Attempts whose named predecessor isn't the one before them."""
    from pyspark.sql import Window

    i = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("run"), c.cast("string"))
    a = table(spark, sf_dir, "supplier").select(i.alias("i"), name(i).alias("run_id"), F.when(i > 1, name(i - F.when(i % 10 == 0, 2).otherwise(1))).alias("prior"))
    return a.withColumn("before", F.lag("run_id").over(Window.orderBy("i"))).where(~F.col("prior").eqNullSafe(F.col("before"))).select("run_id", "prior", "before")


NAMED = lambda names: "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rewrite' WHEN 1 THEN 'rename' ELSE 'rename_and_rewrite' END AS operation, " + ", ".join(f"(CAST((doc_id - doc_id % 3) / 3 AS BIGINT) % {2 ** (k + 1)}) >= {2**k} AS {n}" for k, n in enumerate(names)) + " FROM {documents}"
APPLY_BITS = ("overwrites", "source_ok", "source_absent", "published", "target_absent", "target_before")
INVERSE_BITS = ("clobbered", "applied_ok", "applied_absent", "reinstated", "original_absent", "cleaned")


@query("apl07_adjudication", f"""WITH o AS ({NAMED(APPLY_BITS).format(documents='documents')}) SELECT doc_id, CASE
  WHEN operation = 'rewrite' THEN CASE WHEN target_before THEN 'never-happened' WHEN published THEN 'completed' ELSE 'external-interference' END
  WHEN source_ok AND ((overwrites AND target_before) OR (NOT overwrites AND target_absent)) THEN 'never-happened'
  WHEN source_ok AND published AND NOT (operation = 'rename' AND overwrites) THEN 'finish-remaining'
  WHEN source_absent AND published THEN 'completed' ELSE 'external-interference' END AS verdict FROM o""")
def apl07(spark, sf_dir):
    return spark.sql(NAMED(APPLY_BITS), documents=table(spark, sf_dir, "documents")).select("doc_id", C.adjudicated().alias("verdict"))


@query("apl07_inverse_adjudication", f"""WITH o AS ({NAMED(INVERSE_BITS).format(documents='documents')}) SELECT doc_id, CASE
  WHEN operation = 'rewrite' THEN CASE WHEN applied_ok THEN 'never-happened' WHEN reinstated THEN 'completed' ELSE 'external-interference' END
  WHEN applied_ok AND original_absent THEN 'never-happened' WHEN applied_ok AND reinstated THEN 'finish-remaining'
  WHEN reinstated AND ((clobbered AND cleaned) OR (NOT clobbered AND applied_absent)) THEN 'completed' ELSE 'external-interference' END AS verdict FROM o""")
def apl07_inverse(spark, sf_dir):
    return spark.sql(NAMED(INVERSE_BITS), documents=table(spark, sf_dir, "documents")).select("doc_id", C.adjudicated_inverse().alias("verdict"))


PRE = """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN CASE WHEN doc_id % 10 = 1 THEN 'other' ELSE 'c' || doc_id END END AS live_sha, CASE WHEN doc_id % 23 <> 1 THEN 'c' || doc_id END AS after_sha, doc_id % 10 = 2 AS original_occupied,
  CASE doc_id % 3 WHEN 0 THEN 'rename' ELSE 'rewrite' END AS operation, CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 4 THEN 'zz' ELSE 'b' || doc_id END AS backup_sha, 'b' || doc_id AS before_sha,
  CASE WHEN doc_id % 10 IN (5, 6) THEN 'o' || doc_id END AS overwritten_sha, CASE WHEN doc_id % 10 = 6 THEN 'o' || doc_id END AS overwritten_backup_sha FROM {documents}"""
PRE_CASE = """CASE WHEN live_sha IS NULL THEN 'skipped-unreadable' WHEN after_sha IS NOT NULL AND live_sha <> after_sha THEN 'modified-since-apply' WHEN original_occupied THEN 'collision'
  WHEN operation <> 'rename' AND backup_sha IS NULL THEN 'backup-missing' WHEN operation <> 'rename' AND backup_sha <> before_sha THEN 'backup-mismatch'
  WHEN overwritten_sha IS NOT NULL AND overwritten_sha IS DISTINCT FROM overwritten_backup_sha THEN 'overwritten-backup-mismatch' END"""


@query("rst03_precheck", f"WITH o AS ({PRE.format(documents='documents')}) SELECT doc_id, {PRE_CASE} AS problem FROM o")
def rst03(spark, sf_dir):
    return spark.sql(PRE, documents=table(spark, sf_dir, "documents")).select("doc_id", C.restore_precheck().alias("problem"))


@query("rst01_preview", f"{LAST}, o AS ({PRE.format(documents='documents')}), ls AS (SELECT action, state FROM lc), p AS (SELECT action, state, {PRE_CASE} AS problem FROM ls JOIN o ON action = 'run/a' || doc_id) SELECT action, CASE state WHEN 'restored' THEN 'already-restored' WHEN 'pending-intent' THEN 'skipped' WHEN 'pending-restore' THEN 'adjudicate' ELSE coalesce(problem, 'would_restore') END AS outcome FROM p WHERE state <> 'failed'")
def rst01(spark, sf_dir):
    """What a restore would do with each action, from its state and the precheck."""
    docs = table(spark, sf_dir, "documents")
    checked = spark.sql(PRE, documents=docs).select(F.concat(F.lit("run/a"), F.col("doc_id").cast("string")).alias("action"), C.restore_precheck().alias("problem"))
    rows = C.lifecycle(records(spark, sf_dir)).select("action", "state").join(checked, "action").where("state <> 'failed'")
    outcome = F.when(F.col("state") == "restored", F.lit("already-restored")).when(F.col("state") == "pending-intent", F.lit("skipped")).when(F.col("state") == "pending-restore", F.lit("adjudicate")).otherwise(F.coalesce("problem", F.lit("would_restore")))
    return rows.select("action", outcome.alias("outcome"))


@query("jon13_restore_selector", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jon13(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(chosen, "doc_id", "left_semi")


@query("chn09_backup_keys", "SELECT doc_id, 'root/run/a' || (doc_id % 100 + 1) || '/' || CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'target' END || '/lib/' || doc_id || '.txt' AS backup_key FROM documents")
def chn09(spark, sf_dir):
    from ..functions.paths import backup_key

    i = F.col("doc_id")
    role = F.when(i % 2 == 0, F.lit("source")).otherwise(F.lit("target"))
    return table(spark, sf_dir, "documents").select("doc_id", backup_key(F.lit("root"), F.lit("run"), i % 100 + 1, role, F.concat(F.lit("lib/"), i.cast("string"), F.lit(".txt"))).alias("backup_key"))


@query("chn08_containment_findings", "SELECT DISTINCT 'run/a' || (doc_id % 50) AS action, CASE WHEN doc_id % 3 = 0 THEN '../x' || (doc_id % 9) ELSE '/abs' END AS path FROM documents WHERE doc_id % 3 <> 1")
def chn08(spark, sf_dir):
    """Escaping paths, once per action and path."""
    from ..functions.paths import contained

    i = F.col("doc_id")
    path = F.when(i % 3 == 0, F.concat(F.lit("../x"), (i % 9).cast("string"))).when(i % 3 == 1, F.lit("fine/x")).otherwise(F.lit("/abs"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("run/a"), (i % 50).cast("string")).alias("action"), path.alias("path"))
    return rows.where(~contained(F.col("path"))).dropDuplicates(["action", "path"])
