"""The synthetic corpus, thresholds, capacity, and the apply ladder; also sources and streams seen as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import apply as A
from ..plans import qualify as Q
from .base import query, table

CLASS = "CASE WHEN b < 24 THEN 'rename-only' WHEN b < 32 THEN 'rewrite-and-rename' WHEN b < 36 THEN 'clean-markdown' WHEN b < 38 THEN 'rewrite-markdown' WHEN b = 38 THEN 'legacy-conversion' ELSE 'below-floor-skip' END"


@query("src12_recipes", f"WITH r AS (SELECT doc_id AS i, doc_id % 40 AS b FROM documents) SELECT i AS index_no, 'lib/' || lpad(CAST(i % 53 AS VARCHAR), 2, '0') || '/' || lpad(CAST(i // 53 % 41 AS VARCHAR), 2, '0') || '/doc' || lpad(CAST(i AS VARCHAR), 6, '0') || CASE WHEN b >= 32 AND b < 38 THEN '.md' ELSE '.txt' END AS path, {CLASS} AS recipe_class FROM r")
def src12(spark, sf_dir):
    rows = Q.recipes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index")))
    return rows.select(F.col("index").alias("index_no"), "path", "recipe_class")


@query("agg16_cardinalities", f"WITH r AS (SELECT i % 40 AS b FROM range(10000) t(i)) SELECT {CLASS} AS recipe_class, count(*) AS n FROM r GROUP BY ALL")
def agg16(spark, sf_dir):
    return Q.corpus(spark, 10000).groupBy("recipe_class").agg(F.count("*").alias("n"))


@query("agg17_corpus_budget", "WITH r AS (SELECT i % 53 AS d, i // 53 % 41 AS e FROM range(10000) t(i)) SELECT count(*) AS inodes, count(DISTINCT d) AS dirs, count(DISTINCT d * 100 + e) AS subdirs FROM r")
def agg17(spark, sf_dir):
    rows = Q.corpus(spark, 10000)
    return rows.agg(F.count("*").alias("inodes"), F.countDistinct(F.left("path", F.lit(6))).alias("dirs"), F.countDistinct(F.left("path", F.lit(9))).alias("subdirs"))


#: Peaks of resident memory at three corpus sizes, by stage (published figures, in bytes).
POINTS = "SELECT * FROM (VALUES ('scan', 10000, 111808512), ('scan', 100000, 393216000), ('scan', 1000000, 3201589248), ('plan', 10000, 139542528), ('plan', 100000, 706932736), ('plan', 1000000, 6384893952), ('apply', 10000, 219996160), ('apply', 100000, 1528246272), ('apply', 1000000, 14654480384), ('verify', 10000, 285429760), ('verify', 100000, 2143305728), ('verify', 1000000, 20825497600)) AS v(stage, n, rss)"


def points(spark):
    return spark.sql(POINTS).select("stage", F.col("n").cast("long"), F.col("rss").cast("long"))


@query("agg12_slope", f"SELECT CAST(ceil(max(greatest(0, s))) AS BIGINT) AS slope FROM (SELECT regr_slope(CAST(rss AS DOUBLE), CAST(n AS DOUBLE)) AS s FROM ({POINTS}) GROUP BY stage)")
def agg12(spark, sf_dir):
    return Q.slope(points(spark)).select(F.ceil("slope").cast("long").alias("slope"))


@query("agg13_thresholds", f"WITH p AS ({POINTS}), r AS (SELECT stage, CAST(max(rss) FILTER (WHERE n = 10000) AS HUGEINT) AS a, CAST(max(rss) FILTER (WHERE n = 100000) AS HUGEINT) AS b FROM p GROUP BY stage) SELECT CAST((max(greatest(greatest(a, b) * 90000, a * 90000 + (b - a) * 990000)) * 5 + 359999) // 360000 AS BIGINT) AS peak_limit FROM r")
def agg13(spark, sf_dir):
    return Q.thresholds(points(spark), 10000, 100000, 1000000)


@query("agg14_verdict", "SELECT o_orderkey AS run, CAST(o_totalprice AS BIGINT) <= 200000 AS peak_ok, o_custkey <= 700 AS slope_ok, o_orderkey % 100 <= 20 AS linear_ok FROM orders")
def agg14(spark, sf_dir):
    """Halves go to the even number, as the SQL's cast takes them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.rint("o_totalprice").cast("long").alias("peak"), F.col("o_custkey").alias("slope"), (F.col("o_orderkey") % 100).alias("linearity"))
    return Q.verdict(o, F.lit(200000), F.lit(700), F.lit(20))


ACTIONS = "SELECT source AS device, n_chars AS size_bytes, doc_id % 4 AS depth, CAST(4000000 AS BIGINT) AS available FROM {documents}"
CAPACITY = f"WITH a AS ({ACTIONS.format(documents='documents')}), s AS (SELECT device, CAST(sum((size_bytes + 4095) // 4096 * 4096) AS BIGINT) AS b, CAST(sum(3 + depth) AS BIGINT) AS i, max(available) AS v FROM a GROUP BY device)"


@query("agg10_capacity", f"{CAPACITY} SELECT device, CAST((b * 5 + 3) // 4 AS BIGINT) AS bytes, CAST((i * 5 + 3) // 4 AS BIGINT) AS inodes, (b * 5 + 3) // 4 <= v AS fits FROM s")
def agg10(spark, sf_dir):
    return Q.capacity(spark.sql(ACTIONS, documents=table(spark, sf_dir, "documents")))


@query("agg11_plan_estimate", "SELECT CAST(sum((n_chars + 4095) // 4096 * 4096) AS BIGINT) AS bytes, CAST(sum(3 + doc_id % 4) AS BIGINT) AS inodes, CAST(max(n_chars) * 4 AS BIGINT) AS staging FROM documents")
def agg11(spark, sf_dir):
    from ..functions.text import allocated_bytes

    rows = spark.sql(ACTIONS, documents=table(spark, sf_dir, "documents"))
    return rows.agg(F.sum(allocated_bytes(F.col("size_bytes"), 4096)).alias("bytes"), F.sum(3 + F.col("depth")).alias("inodes"), (F.max("size_bytes") * 4).alias("staging"))


@query("agg19_throughput", "SELECT l_shipmode_like AS stage, CAST(round(files * 1000 / elapsed) AS BIGINT) AS files_per_1000_s, CAST(round(bytes / elapsed) AS BIGINT) AS bytes_s FROM (SELECT l_returnflag AS l_shipmode_like, count(*) AS files, sum(CAST(l_quantity AS BIGINT)) AS bytes, max(l_partkey) AS elapsed FROM lineitem GROUP BY l_returnflag)")
def agg19(spark, sf_dir):
    stages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.count("*").alias("files"), F.sum(F.round("l_quantity").cast("long")).alias("bytes"), F.max("l_partkey").alias("elapsed"))
    return Q.throughput(stages).select("stage", F.round(F.col("files_s") * 1000).cast("long").alias("files_per_1000_s"), F.round("bytes_s").cast("long").alias("bytes_s"))


LADDER = """SELECT doc_id, 'lib/' || doc_id || '.txt' AS path, doc_id % 23 <> 1 AS readable, doc_id % 29 = 2 AS interfered, doc_id % 19 <> 3 AS hash_ok, doc_id % 17 = 4 AS filtered,
  doc_id % 37 <> 5 AS inside, doc_id % 41 = 6 AS shrinks, doc_id % 43 <> 7 AS same_operations, doc_id % 13 = 8 AS target_taken, doc_id % 31 = 9 AS linked FROM {documents}"""
LADDER_SQL = f"WITH l AS ({LADDER.format(documents='documents')})"
PREVIEW = """CASE WHEN interfered THEN 'skipped:external-interference' WHEN NOT readable THEN 'skipped:unreadable' WHEN NOT hash_ok THEN 'skipped:stale-hash' WHEN filtered THEN 'skipped:excluded' WHEN NOT inside THEN 'skipped:containment'
  WHEN shrinks THEN 'skipped:shrink-invariant' WHEN NOT same_operations THEN 'failed:ERR-006' WHEN target_taken THEN 'skipped:collision' ELSE 'would_apply' END"""
EXECUTE = """CASE WHEN NOT inside THEN 'skipped:containment' WHEN interfered THEN 'skipped:external-interference' WHEN NOT readable THEN 'skipped:unreadable' WHEN linked THEN 'skipped:hard-link-alias' WHEN NOT hash_ok THEN 'skipped:stale-hash'
  WHEN filtered THEN 'skipped:excluded' WHEN shrinks THEN 'skipped:shrink-invariant' WHEN NOT same_operations THEN 'failed:ERR-006' WHEN target_taken THEN 'skipped:collision' ELSE 'applied' END"""


def ladder(spark, sf_dir):
    return spark.sql(LADDER, documents=table(spark, sf_dir, "documents"))


@query("apl01_ladder", f"{LADDER_SQL} SELECT doc_id, {PREVIEW} AS outcome FROM l")
def apl01(spark, sf_dir):
    return ladder(spark, sf_dir).select("doc_id", A.preview().alias("outcome"))


@query("apl02_ladder", f"{LADDER_SQL} SELECT doc_id, {EXECUTE} AS outcome FROM l")
def apl02(spark, sf_dir):
    return ladder(spark, sf_dir).select("doc_id", A.executed().alias("outcome"))


@query("apl03_recompute", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ERR-006' END AS error FROM documents")
def apl03(spark, sf_dir):
    """Operations found again must be those planned; every fifth plan names one too many."""
    from ..functions import text as T

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("x"), F.lit("text").alias("kind"))
    now = T.transformed(docs, "x", "kind")
    planned = F.when(F.col("doc_id") % 5 == 0, F.array_append("text_ops", "rename")).otherwise(F.col("text_ops"))
    return now.select("doc_id", A.recompute_error(planned, F.col("text_ops")).alias("error"))


@query("apl04_resume_reconciliation", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'skipped:already-applied' ELSE 'failed:ERR-002' END END AS outcome FROM documents")
def apl04(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 4 == 0, F.lit("applied")).alias("state"), F.lit("h").alias("after_sha"), F.when(i % 8 == 0, F.lit("h")).otherwise(F.lit("g")).alias("live_sha"))
    return rows.select("doc_id", A.resumed(F.col("state"), F.col("after_sha"), F.col("live_sha")).alias("outcome"))


@query("apl05_exit_code", f"{LADDER_SQL}, o AS (SELECT {EXECUTE} AS outcome FROM l) SELECT count(*) FILTER (WHERE outcome LIKE 'skipped:%' AND outcome <> 'skipped:already-applied') AS skips, count(*) FILTER (WHERE outcome LIKE 'failed:%') AS failures, CAST(count(*) FILTER (WHERE outcome <> 'applied') > 0 AS BIGINT) AS exit_code FROM o")
def apl05(spark, sf_dir):
    return A.exit_code(ladder(spark, sf_dir).select(A.executed().alias("outcome")))


@query("apl06_preservation_gate", "WITH a AS (SELECT source AS plan, count(*) FILTER (WHERE doc_id % 3 > 0) AS rewrites, count(*) FILTER (WHERE doc_id % 5 = 0) AS overwrites FROM documents GROUP BY source) SELECT plan, rewrites, overwrites, array_to_string(list_filter([CASE WHEN rewrites > 0 AND plan NOT IN ('src1', 'src2') THEN 'rewrites-unpreserved' END, CASE WHEN overwrites > 0 AND plan <> 'src1' THEN 'overwrites-without-backup' END], lambda z: z IS NOT NULL), ',') AS refusals FROM a")
def apl06(spark, sf_dir):
    i = F.col("doc_id")
    kinds = F.when(i % 3 == 0, F.lit("rename")).otherwise(F.lit("rewrite"))
    plans = table(spark, sf_dir, "documents").select(F.col("source").alias("plan"), kinds.alias("operation"), (i % 5 == 0).alias("overwrites"), (F.col("source") == "src1").alias("backup_dir"), (F.col("source") == "src2").alias("preserved"))
    return A.preservation(plans)


@query("src08_manifest_lines", "SELECT o_custkey AS run, count(*) AS records, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey")
def src08(spark, sf_dir):
    """Manifests as whole texts with a torn last line, read back as records."""
    from ..sources.artifacts import manifest_records

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("seq"), F.lit("applied").alias("result")))
    texts = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("ls"))
    body = F.concat(F.lit('{"schema_version":"2.0"}\n'), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit('\n{"seq": 1, "resu'))
    rows = manifest_records(texts.select(F.col("o_custkey").cast("string").alias("path"), body.alias("value")), "seq long, result string")
    return rows.groupBy(F.col("path").cast("long").alias("run")).agg(F.count("*").alias("records"), F.max("r.seq").alias("last_order"))


@query("src11_log_lines", "SELECT event_id, event_type AS event FROM events WHERE event_id % 7 NOT IN (3, 4)")
def src11(spark, sf_dir):
    """Log lines that keep the rules: one object of the named run, without repeated keys."""
    from ..sources.artifacts import log_lines

    e = F.col("event_id")
    good = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("ts"), F.lit("info").alias("level"), F.when(e % 7 == 3, F.lit("other")).otherwise(F.lit("r1")).alias("run_id"), F.lit("scan").alias("command"), F.col("event_type").alias("event"), e.alias("event_id")))
    line = F.when(e % 7 == 4, F.concat(F.lit('{"level":"info",'), F.expr("substring(g, 2)"))).otherwise(F.col("g"))
    rows = table(spark, sf_dir, "events").withColumn("g", good).select(line.alias("value"))
    return log_lines(rows, "r1", "scan", "event_id long").where("problem IS NULL").select("l.event_id", "l.event")
