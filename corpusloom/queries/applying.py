"""Plans made from bytes, applied to files that have changed meanwhile, and undone again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.facts import digest
from ..operators.tables import kept, scratch
from ..plans import apply as A
from ..plans import planner as P
from ..plans import qualify as Q
from ..plans import verify as V
from .base import STEPS, dirty_docs, query, table
from .planning import TABBED

PLANNED = P.Config(rules=TABBED)
#: By the time of the run, another folder is excluded.
RUNNING = P.Config(rules=TABBED, exclude=(*PLANNED.exclude, "lib/17/"))

#: The actions of the plan, in order, and what became of each file since: gone, linked, changed, or its new name taken.
ACTIONS = f"""WITH {STEPS}, p AS (SELECT *, list_contains(ops, 'rename') AS moves FROM planned WHERE path NOT LIKE '%.TXT' AND len(ops) > 0),
a AS (SELECT *, row_number() OVER (ORDER BY path) AS seq, CASE WHEN moves THEN left(path, length(path) - 4) || '.md' ELSE path END AS place,
  CASE WHEN doc_id % 23 = 1 THEN 'skipped:unreadable' WHEN doc_id % 31 = 9 THEN 'skipped:hard-link-alias' WHEN doc_id % 19 = 3 THEN 'skipped:stale-hash' WHEN path LIKE 'lib/17/%' THEN 'skipped:excluded'
    WHEN doc_id % 43 = 7 THEN 'failed:ERR-006' WHEN moves AND doc_id % 13 = 8 THEN 'skipped:collision' ELSE 'applied' END AS outcome,
  CASE WHEN doc_id % 23 = 1 THEN 'skipped:unreadable' WHEN doc_id % 19 = 3 THEN 'skipped:stale-hash' WHEN path LIKE 'lib/17/%' THEN 'skipped:excluded'
    WHEN doc_id % 43 = 7 THEN 'failed:ERR-006' WHEN moves AND doc_id % 13 = 8 THEN 'skipped:collision' ELSE 'would_apply' END AS preview FROM p),
live AS (SELECT path, CASE WHEN doc_id % 19 = 3 THEN raw || 'x' ELSE raw END AS content FROM dirty WHERE doc_id % 23 <> 1
  UNION ALL SELECT left(path, length(path) - 4) || '.md', 'other' FROM dirty WHERE doc_id % 13 = 8 AND path LIKE '%.txt'),
done AS (SELECT * FROM a WHERE outcome = 'applied')"""


def number() -> F.Column:
    return F.regexp_extract("path", r"doc0*(\d+)[.]", 1).cast("long")


def files(spark, sf_dir) -> DataFrame:
    return dirty_docs(spark, sf_dir).select("path", F.encode("raw", "UTF-8").alias("content"))


def actions(spark, sf_dir) -> DataFrame:
    """The plan's actions with the digests of their sources; some are tampered with."""
    seen = kept(P.from_bytes(files(spark, sf_dir), PLANNED), "seen")
    plan = P.build_plan(seen, PLANNED).where("disposition = 'action'")
    ops = F.when(number() % 43 == 7, F.concat("ops", F.lit(",normalize_tabs"))).otherwise(F.col("ops"))
    return plan.join(seen.select("path", F.col("sha256").alias("source_sha")), "path").select("seq", "path", "target", "source_sha", ops.alias("ops"))


def live(spark, sf_dir) -> DataFrame:
    """The files as the run finds them."""
    rows, i = files(spark, sf_dir), number()
    now = rows.where(i % 23 != 1).select("path", F.when(i % 19 == 3, F.concat("content", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("content")).alias("content"), F.when(i % 31 == 9, 2).otherwise(1).alias("nlink"))
    new = rows.where((i % 13 == 8) & F.endswith("path", F.lit(".txt"))).select(F.concat(F.expr("left(path, length(path) - 4)"), F.lit(".md")).alias("path"), F.encode(F.lit("other"), "UTF-8").alias("content"), F.lit(1).alias("nlink"))
    return now.unionByName(new)


def run(spark, sf_dir) -> A.Applied:
    return A.execute(live(spark, sf_dir), actions(spark, sf_dir), "run", scratch(spark), RUNNING)


@query("apl01_preview", f"{ACTIONS} SELECT path, CAST(seq AS BIGINT) AS seq, preview AS outcome FROM a")
def apl01(spark, sf_dir):
    return A.bound(live(spark, sf_dir), actions(spark, sf_dir), RUNNING).select("path", "seq", A.preview().alias("outcome"))


@query("apl02_execute", f"{ACTIONS} SELECT path, CAST(seq AS BIGINT) AS seq, outcome FROM a")
def apl02(spark, sf_dir):
    return run(spark, sf_dir).outcomes.select("path", "seq", "outcome")


@query("snk04_journal", f"{ACTIONS}, n AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM done), r AS (SELECT *, unnest(['intent', 'applied']) AS result FROM n) SELECT CAST(2 * k - CASE WHEN result = 'intent' THEN 1 ELSE 0 END AS BIGINT) AS record_seq, 'run/a' || seq AS action_id, result, path AS original_path, place AS target_path, 'sha256:' || sha256(raw) AS before_sha, 'sha256:' || sha256(x5) AS after_sha FROM r")
def snk04(spark, sf_dir):
    return run(spark, sf_dir).journal.select("record_seq", "action_id", "result", "original_path", "target_path", "before_sha", "after_sha")


@query("snk05_backups", f"{ACTIONS} SELECT 'run/a' || seq || '/source/' || path AS key, 'sha256:' || sha256(raw) AS sha FROM done WHERE array_to_string(ops, ',') <> 'rename'")
def snk05(spark, sf_dir):
    return run(spark, sf_dir).backups.select("key", digest(F.col("content")).alias("sha"))


@query("snk06_new_version", f"{ACTIONS} SELECT path, sha256(content) AS digest FROM live WHERE path NOT IN (SELECT path FROM done) UNION ALL SELECT place, sha256(x5) FROM done")
def snk06(spark, sf_dir):
    return run(spark, sf_dir).corpus.select("path", F.sha2("content", 256).alias("digest"))


@query("rst02_restored_version", f"{ACTIONS} SELECT CASE WHEN b.seq % 5 = 0 THEN b.place ELSE l.path END AS path, CASE WHEN b.seq % 5 = 0 THEN sha256(b.x5 || '!') ELSE sha256(l.content) END AS digest FROM live l LEFT JOIN done b ON l.path = b.path")
def rst02(spark, sf_dir):
    """What was applied is undone, but for files that have been changed since."""
    done = run(spark, sf_dir)
    applied = done.journal.where("result = 'applied'").select(F.col("target_path").alias("path"), "seq")
    changed = F.when(F.col("seq") % 5 == 0, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content"))
    now = kept(done.corpus.join(applied, "path", "left").select("path", changed.alias("content")), "now")
    return A.restore(now, done.journal, done.backups, "undo", scratch(spark)).corpus.select("path", F.sha2("content", 256).alias("digest"))


#: Letters that tell Windows-1252 from other charsets, and too few of them.
MANY = "Größe und Übermaß: die schöne Straße führt über Brücken, Flüsse und Hügel. Äpfel, Öl, Käse. " * 8
FEW = "plain words only, " * 20 + "café, naïve"


def synthetic(spark, sf_dir) -> DataFrame:
    """Recipes with their bytes, what is to become of them, and where."""
    rows = Q.recipes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index")))
    end = F.when(F.col("newline") == "crlf", F.lit("\r\n")).otherwise(F.lit("\n"))
    body = F.when(F.col("recipe_class") == "legacy-conversion", F.lit(MANY.strip())).when(F.col("recipe_class") == "below-floor-skip", F.lit(FEW)).otherwise(F.concat(F.lit("words of "), F.col("index").cast("string")))
    rows = rows.withColumn("text", F.concat(body, end, F.lit("more"), end))
    content = F.when(F.col("encoding") == "utf-8", F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    place = F.when(F.contains("operations", F.lit("rename")), F.concat(F.expr("left(path, length(path) - 4)"), F.lit(".md"))).otherwise(F.col("path"))
    after = digest(F.encode(F.replace("text", F.lit("\r\n"), F.lit("\n")), "UTF-8"))
    return rows.withColumns({"content": content, "place": place, "after": after})


@query("ver13_pipeline_reconciliation", """WITH r AS (SELECT doc_id AS i, doc_id % 40 AS b, doc_id % 37 = 5 AS gone, doc_id % 41 = 6 AS more FROM documents),
c AS (SELECT *, 'lib/' || lpad(CAST(i % 53 AS VARCHAR), 2, '0') || '/' || lpad(CAST(i // 53 % 41 AS VARCHAR), 2, '0') || '/doc' || lpad(CAST(i AS VARCHAR), 6, '0') AS stem, b < 32 OR b BETWEEN 36 AND 38 OR (b BETWEEN 32 AND 35 AND more) AS works FROM r),
p AS (SELECT *, stem || CASE WHEN b BETWEEN 32 AND 37 THEN '.md' ELSE '.txt' END AS path, stem || CASE WHEN b = 39 THEN '.txt' ELSE '.md' END AS place FROM c)
SELECT 'inventory' AS contract, path, 'missing' AS problem FROM p WHERE gone
UNION ALL SELECT 'plan', path, CASE WHEN b < 24 THEN 'differs: operations' ELSE 'differs: disposition,operations' END FROM p WHERE NOT gone AND more AND (b < 24 OR b BETWEEN 32 AND 35)
UNION ALL SELECT 'manifest', path, 'missing' FROM p WHERE NOT gone AND works AND i % 43 = 9
UNION ALL SELECT 'bytes', place, CASE WHEN gone THEN 'missing' ELSE 'differs: sha' END FROM p WHERE (gone OR more) AND b <> 39""")
def ver13(spark, sf_dir):
    """A corpus of recipes, planned, applied and held against the recipes; some files are missing, some have more
    lines than they should, and some terminals are taken from the journal."""
    recipes = kept(synthetic(spark, sf_dir), "recipes")
    more = F.when(F.col("index") % 41 == 6, F.concat("content", F.encode(F.lit("x\r\n"), "UTF-8"))).otherwise(F.col("content"))
    files = recipes.where("index % 37 <> 5").select("path", more.alias("content"))
    seen = kept(P.from_bytes(files), "seen")
    plan = kept(P.build_plan(seen), "plan")
    actions = plan.where("disposition = 'action'").join(seen.select("path", F.col("sha256").alias("source_sha")), "path").select("seq", "path", "target", "source_sha", "ops")
    done = A.execute(files, actions, "run", scratch(spark))
    torn = done.journal.where(~((F.col("result") == "applied") & (F.regexp_extract("original_path", r"doc0*(\d+)[.]", 1).cast("long") % 43 == 9)))
    return V.reconcile(recipes, plan, A.Applied(done.outcomes, torn, done.backups, done.corpus))
