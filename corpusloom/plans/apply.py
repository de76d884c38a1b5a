"""Applying plans: outcome ladders, gates, and immutable versions of the corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.facts import digest
from ..functions.globs import matches
from ..functions.paths import contained
from ..operators.tables import kept
from ..sources.sinks import append_backups
from . import planner as P

#: Rungs by name: the test over columns of what was observed, and the outcome.
RUNGS = {
    "interfered": ("interfered", "skipped:external-interference"),
    "unreadable": ("NOT readable", "skipped:unreadable"),
    "linked": ("linked", "skipped:hard-link-alias"),
    "stale": ("NOT hash_ok", "skipped:stale-hash"),
    "filtered": ("filtered", "skipped:excluded"),
    "outside": ("NOT inside", "skipped:containment"),
    "shrinks": ("shrinks", "skipped:shrink-invariant"),
    "differs": ("NOT same_operations", "failed:ERR-006"),
    "taken": ("target_taken", "skipped:collision"),
    "unkept": ("target_taken AND NOT preserved", "skipped:collision-unpreserved"),
}


def _ladder(order: list[str], end: str, on_collision: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in order:
        test, outcome = RUNGS[name]
        if name == "taken" and on_collision == "overwrite":
            name = "unkept"
            test, outcome = RUNGS[name]
        out = out.when(F.expr(test), F.lit(outcome))
    return out.otherwise(F.lit(end))


def preview(on_collision: str = "skip") -> Column:
    """A dry run's outcome: filters before containment, links not looked at.

    With collisions overwritten, ``preserved`` says whether what is overwritten is kept.
    """
    return _ladder(["interfered", "unreadable", "stale", "filtered", "outside", "shrinks", "differs", "taken"], "would_apply", on_collision)


def executed(on_collision: str = "skip") -> Column:
    """A real run's outcome: containment first, links before the hash."""
    return _ladder(["outside", "interfered", "unreadable", "linked", "stale", "filtered", "shrinks", "differs", "taken"], "applied", on_collision)


def recompute_error(planned: Column, found: Column) -> Column:
    return F.when(planned != found, F.lit("ERR-006"))


def resumed(state: Column, after_sha: Column, live_sha: Column) -> Column:
    """The outcome of an action that a record says was applied; null for others."""
    return F.when(state == "applied", F.when(live_sha.eqNullSafe(after_sha), F.lit("skipped:already-applied")).otherwise(F.lit("failed:ERR-002")))


def exit_code(outcomes: DataFrame) -> DataFrame:
    """One row: skips that count, failures, and the exit code."""
    o = F.col("outcome")
    sums = outcomes.agg(F.count_if(F.startswith(o, F.lit("skipped:")) & (o != "skipped:already-applied")).alias("skips"), F.count_if(F.startswith(o, F.lit("failed:"))).alias("failures"))
    return sums.withColumn("exit_code", (F.col("skips") + F.col("failures") > 0).cast("long"))


def preservation(actions: DataFrame) -> DataFrame:
    """Why a plan may not be applied; an empty list lets it go ahead.

    ``actions`` has a row per action: ``plan``, ``operation``, ``overwrites`` (its target is there, and collisions
    overwrite), and, alike for all of a plan, ``backup_dir`` (backups are on) and ``preserved`` (another strategy is
    declared).  These, where there are such columns, refuse too: ``outside`` (a path of the action leaves the root),
    ``opt_in`` (one action may go without backup, but no more), ``backup_inside`` (backups would lie in the corpus),
    ``backup_writable`` and ``journal_writable``, and ``bytes_needed`` against ``bytes_free``.
    """
    has = set(actions.columns)
    flag = lambda name, missing: F.coalesce(F.bool_or(name), F.lit(missing)) if name in has else F.lit(missing)
    number = lambda name, how: how(name) if name in has else F.lit(None).cast("long")
    per = actions.groupBy("plan").agg(
        F.count("*").alias("actions"),
        F.count_if(F.col("operation") != "rename").alias("rewrites"),
        F.count_if("overwrites").alias("overwrites"),
        flag("outside", False).alias("outside"),
        flag("backup_dir", False).alias("backup_dir"),
        flag("preserved", False).alias("preserved"),
        flag("opt_in", False).alias("opt_in"),
        flag("backup_inside", False).alias("backup_inside"),
        flag("backup_writable", True).alias("backup_writable"),
        flag("journal_writable", True).alias("journal_writable"),
        number("bytes_needed", F.sum).alias("needed"),
        number("bytes_free", F.max).alias("free"),
    )
    active = F.col("backup_dir") | F.col("preserved")
    alone = F.col("opt_in") & (F.col("actions") == 1)
    refusals = [
        ("outside-root", F.col("outside")),
        ("opt-in-of-many", F.col("opt_in") & (F.col("actions") > 1)),
        ("rewrites-unpreserved", (F.col("rewrites") > 0) & ~active & ~alone),
        ("overwrites-without-backup", (F.col("overwrites") > 0) & ~active),
        ("backup-inside-corpus", F.col("backup_dir") & F.col("backup_inside")),
        ("backup-unwritable", F.col("backup_dir") & ~F.col("backup_inside") & ~F.col("backup_writable")),
        ("journal-unwritable", ~F.col("journal_writable")),
        ("no-space", F.coalesce(F.col("needed") > F.col("free"), F.lit(False))),
    ]
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in refusals]))
    return per.select("plan", "rewrites", "overwrites", F.array_join(named, ",").alias("refusals"))


@dataclass(frozen=True)
class Applied:
    """What a run leaves: an outcome per action, its journal and backups, and the corpus' next version."""

    outcomes: DataFrame
    journal: DataFrame
    backups: DataFrame
    corpus: DataFrame


def bound(corpus: DataFrame, actions: DataFrame, config: P.Config) -> DataFrame:
    """What is seen of each action's file now, for the ladders, and what would be written.

    ``corpus``: path, content and, where it is given, nlink; ``actions``: seq, path, operations as ``ops`` (joined by
    commas), target and ``source_sha``.
    """
    files = corpus if "nlink" in corpus.columns else corpus.withColumn("nlink", F.lit(1))
    rows = actions.join(files.select("path", "content", "nlink"), "path", "left")
    there = files.select(F.col("path").alias("target"), F.col("content").alias("overwritten"), F.lit(True).alias("target_taken"))
    rows = rows.join(there, "target", "left").withColumnRenamed("ops", "planned")
    now = P.operations(P.from_bytes(rows, config), config.rules, config.rename)
    same_text = F.array_join("ops", ",").isin("", "rename")
    output = F.when(same_text, F.col("content")).otherwise(F.encode("new_text", "UTF-8"))
    inside = contained(F.col("path")) & F.coalesce(contained(F.col("target")), F.lit(True))
    return now.select(
        "seq",
        "path",
        "target",
        "source_sha",
        T.operation_kind(F.split("planned", ",")).alias("operation"),
        F.lit(False).alias("interfered"),
        F.col("content").isNotNull().alias("readable"),
        F.coalesce(F.col("nlink") > 1, F.lit(False)).alias("linked"),
        F.coalesce(digest(F.col("content")) == F.col("source_sha"), F.lit(False)).alias("hash_ok"),
        (~matches(F.col("path"), list(config.include)) | matches(F.col("path"), list(config.exclude))).alias("filtered"),
        inside.alias("inside"),
        F.coalesce(T.non_whitespace_count(F.col("new_text")) < T.non_whitespace_count(F.col("x")), F.lit(False)).alias("shrinks"),
        F.coalesce(F.array_join("ops", ",") == F.col("planned"), F.lit(False)).alias("same_operations"),
        F.coalesce("target_taken", F.lit(False)).alias("target_taken"),
        "content",
        output.alias("output"),
        "overwritten",
    )


def execute(corpus: DataFrame, actions: DataFrame, run: str, folder: str, config: P.Config = P.Config(), preserved: bool = True) -> Applied:
    """Applies a plan's actions to a corpus of files, and writes all that follows below ``folder``.

    In this order: what is seen of each file now decides its outcome; originals and overwritten targets are copied
    under keys written once, read again and compared with their digests; the journal gets an intent per applied
    action; the corpus' next version is written; its files are read again, and the journal gets the terminals, of
    failure where a file isn't what it should be.  A run that stops leaves intents without terminals.
    """
    spark = corpus.sparkSession
    rows = bound(corpus, actions, config).withColumn("preserved", F.lit(preserved))
    seen = kept(rows.withColumn("outcome", executed(config.on_collision)), "bound")
    done = seen.where("outcome = 'applied'").withColumns({"place": F.coalesce("target", "path"), "action_id": F.concat(F.lit(f"{run}/a"), F.col("seq").cast("string")), "after_sha": digest(F.col("output"))})
    key = lambda role, path: F.concat(F.lit(f"{run}/a"), F.col("seq").cast("string"), F.lit(f"/{role}/"), F.col(path))
    copies = done.where("operation <> 'rename'").select(key("source", "path").alias("key"), F.col("content"), F.col("source_sha").alias("sha"))
    clobbered = done.where("target_taken").select(key("overwritten", "target").alias("key"), F.col("overwritten").alias("content"), digest(F.col("overwritten")).alias("sha"))
    append_backups(copies.unionByName(clobbered), f"{folder}/backups")
    fixed = done.select(
        "seq",
        "action_id",
        "operation",
        F.col("path").alias("original_path"),
        F.col("place").alias("target_path"),
        F.col("source_sha").alias("before_sha"),
        "after_sha",
        F.when(F.col("operation") != "rename", key("source", "path")).alias("backup_key"),
        F.when(F.col("target_taken"), digest(F.col("overwritten"))).alias("overwritten_sha"),
        F.when(F.col("target_taken"), key("overwritten", "target")).alias("overwritten_key"),
    )
    P.numbered(fixed.withColumn("result", F.lit("intent")), "seq", name="record_seq").write.parquet(f"{folder}/journal/phase=intent")
    gone = done.select("path").unionByName(done.where("target_taken").select(F.col("target").alias("path")))
    rest = corpus.select("path", "content").join(gone, "path", "left_anti")
    rest.unionByName(done.select(F.col("place").alias("path"), F.col("output").alias("content"))).write.parquet(f"{folder}/corpus")
    version = spark.read.parquet(f"{folder}/corpus")
    found = version.select(F.col("path").alias("target_path"), digest(F.col("content")).alias("live_sha"))
    ended = fixed.join(found, "target_path", "left").withColumn("result", F.when(F.col("live_sha").eqNullSafe(F.col("after_sha")), F.lit("applied")).otherwise(F.lit("failed"))).drop("live_sha")
    P.numbered(ended.select(*fixed.columns, "result"), "seq", name="record_seq").write.parquet(f"{folder}/journal/phase=terminal")
    journal = spark.read.parquet(f"{folder}/journal").withColumn("record_seq", 2 * F.col("record_seq") - F.when(F.col("result") == "intent", 1).otherwise(0))
    return Applied(seen.select("seq", "path", "target", "outcome"), journal, spark.read.parquet(f"{folder}/backups"), version)


def restore(corpus: DataFrame, journal: DataFrame, backups: DataFrame, run: str, folder: str, only: DataFrame | None = None) -> Applied:
    """Undoes what a journal says was applied, as a new set and a new version of the corpus, below ``folder``.

    A file that has changed since, an original name that something else has taken, and backups that are missing or
    aren't what was recorded, leave an action as it is.  ``only`` (action_id) restricts what is undone.
    """
    from .chain import restore_precheck

    spark = corpus.sparkSession
    applied = journal.where("result = 'applied'").drop("result", "phase", "record_seq")
    if only is not None:
        applied = applied.join(only.select("action_id").distinct(), "action_id", "left_semi")
    live = corpus.select(F.col("path").alias("target_path"), F.col("content").alias("live"))
    other = corpus.select(F.col("path").alias("original_path"), F.lit(True).alias("there"))
    copy = lambda of, content: backups.select(F.col("key").alias(of), F.col("content").alias(content))
    rows = applied.join(live, "target_path", "left").join(other, "original_path", "left")
    rows = rows.join(copy("backup_key", "original"), "backup_key", "left").join(copy("overwritten_key", "overwritten"), "overwritten_key", "left")
    facts = rows.withColumns({
        "live_sha": digest(F.col("live")),
        "original_occupied": F.coalesce("there", F.lit(False)) & (F.col("original_path") != F.col("target_path")),
        "backup_sha": digest(F.col("original")),
        "overwritten_backup_sha": digest(F.col("overwritten")),
    })
    seen = kept(facts.withColumn("outcome", F.coalesce(restore_precheck(), F.lit("restored"))), "restoring")
    done = seen.where("outcome = 'restored'")
    inverse = done.select(
        "seq",
        F.concat(F.lit(f"{run}/"), F.col("action_id")).alias("action_id"),
        F.col("action_id").alias("undoes_action_id"),
        "operation",
        F.col("target_path").alias("original_path"),
        F.col("original_path").alias("target_path"),
        F.col("after_sha").alias("before_sha"),
        F.col("before_sha").alias("after_sha"),
    )
    order = F.desc("seq")
    P.numbered(inverse.withColumn("result", F.lit("intent")), order, name="record_seq").write.parquet(f"{folder}/journal/phase=intent")
    rest = corpus.select("path", "content").join(done.select(F.col("target_path").alias("path")), "path", "left_anti")
    back = done.select(F.col("original_path").alias("path"), F.coalesce("original", "live").alias("content"))
    again = done.where("overwritten IS NOT NULL").select(F.col("target_path").alias("path"), F.col("overwritten").alias("content"))
    rest.unionByName(back).unionByName(again).write.parquet(f"{folder}/corpus")
    version = spark.read.parquet(f"{folder}/corpus")
    found = version.select(F.col("path").alias("target_path"), digest(F.col("content")).alias("live_sha"))
    ended = inverse.join(found, "target_path", "left").withColumn("result", F.when(F.col("live_sha").eqNullSafe(F.col("after_sha")), F.lit("applied")).otherwise(F.lit("failed"))).drop("live_sha")
    P.numbered(ended.select(*inverse.columns, "result"), order, name="record_seq").write.parquet(f"{folder}/journal/phase=terminal")
    kept_journal = spark.read.parquet(f"{folder}/journal").withColumn("record_seq", 2 * F.col("record_seq") - F.when(F.col("result") == "intent", 1).otherwise(0))
    return Applied(seen.select("seq", F.col("target_path").alias("path"), F.col("original_path").alias("target"), "outcome"), kept_journal, backups, version)


def next_version(corpus: DataFrame, applied: DataFrame) -> DataFrame:
    """The corpus with the outputs of applied actions (id, output) in place of their sources."""
    rows = corpus.join(applied, F.col("doc_id") == F.col("id"), "left")
    return rows.withColumn("text", F.coalesce("output", "text")).drop("id", "output")


def journaled(actions: DataFrame, run: str, set_index: int) -> DataFrame:
    """Intent and terminal rows of a set, numbered in the order of their actions."""
    phases = F.array(F.struct(F.lit(1).alias("phase"), F.lit("intent").alias("result")), F.struct(F.lit(2).alias("phase"), F.col("result").alias("result")))
    rows = actions.withColumn("p", F.explode(phases)).drop("result")
    return rows.select("*", F.lit(run).alias("run_id"), F.lit(set_index).alias("set_index"), (2 * (F.col("seq") - 1) + F.col("p.phase")).alias("record_seq"), F.col("p.result").alias("result")).drop("p")


def finished(names: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The names that a version has once interrupted actions are finished: what remained was to drop their sources.

    ``names``: path; ``verdicts``: verdict, source and target.  A source goes only if its target is there.
    """
    done = verdicts.where("verdict = 'finish-remaining'").join(names.select(F.col("path").alias("target")), "target", "left_semi")
    return names.join(done.select(F.col("source").alias("path")), "path", "left_anti")


def after_abort(outcomes: DataFrame) -> DataFrame:
    """Statuses of a plan's actions (``plan``, ``seq``, ``status``, ``abort``) where an abort stops those after it."""
    before = Window.partitionBy("plan").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("abort").cast("int")).over(before), F.lit(0)) == 1
    return outcomes.select("plan", "seq", F.when(stopped, F.lit("not-attempted")).otherwise(F.col("status")).alias("status"))
