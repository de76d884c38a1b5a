"""Manifest chains: order, coherence, lifecycle rules and their violations.

Records are rows of ``set_index, seq, kind, action_id, undoes_action_id, operation, original_path, target_path,
before_sha, after_sha, result`` (result: intent, applied or failed).  Sets are few, records are many: sets are
ordered on the driver or by a recursive query, records by windows per action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .planner import numbered

#: What a terminal record must share with its intent.
IMMUTABLE = ("operation", "original_path", "target_path", "before_sha", "after_sha")


def original_action() -> Column:
    """The action that a record is about: an inverse is about the one that it undoes."""
    return F.coalesce("undoes_action_id", "action_id")


def state_of(kind: Column, result: Column) -> Column:
    """The state that an action's last record leaves it in."""
    inverse = kind == "restore"
    return (
        F.when(result == "intent", F.when(inverse, F.lit("pending-restore")).otherwise(F.lit("pending-intent")))
        .when(result == "applied", F.when(inverse, F.lit("restored")).otherwise(F.lit("applied")))
        .otherwise(F.when(inverse, F.lit("restore-failed")).otherwise(F.lit("failed")))
    )


def lifecycle(records: DataFrame) -> DataFrame:
    """A row per original action: its last record by set and place, never by time, and the state."""
    last = records.groupBy(original_action().alias("action")).agg(F.max_by(F.struct(*records.columns), F.struct("set_index", "seq")).alias("r"))
    return last.select("action", state_of(F.col("r.kind"), F.col("r.result")).alias("state"), F.col("r.set_index").alias("set_index"), F.col("r.seq").alias("seq"), F.col("r.after_sha").alias("after_sha"), F.col("r.target_path").alias("target_path"))


def ordered_sets(headers: list[dict]) -> list[dict]:
    """Manifests from the root along their hash links; raises where the chain forks, breaks or has two roots.

    Headers hold ``run_id``, ``sha`` and ``prior_sha``; there is one per run, so they are walked on the driver.
    """
    by_prior: dict[str | None, list[dict]] = {}
    for h in headers:
        by_prior.setdefault(h["prior_sha"], []).append(h)
    if len(by_prior.get(None, [])) != 1:
        raise ValueError("a chain has exactly one root")
    out, now = [], by_prior[None][0]
    while now:
        out.append(now)
        after = by_prior.get(now["sha"], [])
        if len(after) > 1:
            raise ValueError(f"the chain forks after {now['run_id']}")
        now = after[0] if after else None
    if len(out) != len(headers):
        raise ValueError("the chain has a gap")
    return out


def sequence_gaps(records: DataFrame) -> DataFrame:
    """Records whose number isn't their place in the set."""
    place = F.row_number().over(Window.partitionBy("set_index").orderBy("seq", "action_id", "result"))
    return records.withColumn("place", place.cast("long")).where("seq <> place").select("set_index", "seq", "place", "action_id")


def per_set_lifecycle(records: DataFrame) -> DataFrame:
    """Actions with more than one intent or terminal in a set, or a terminal before its intent."""
    of = records.groupBy("set_index", "action_id").agg(
        F.count_if(F.col("result") == "intent").alias("intents"),
        F.count_if(F.col("result") != "intent").alias("terminals"),
        F.min(F.when(F.col("result") == "intent", F.col("seq"))).alias("first_intent"),
        F.min(F.when(F.col("result") != "intent", F.col("seq"))).alias("first_terminal"),
    )
    return of.where("intents > 1 OR terminals > 1 OR first_terminal < first_intent").select("set_index", "action_id", "intents", "terminals")


def changed_immutables(records: DataFrame) -> DataFrame:
    """Terminals that differ from their set's intent in what must stay; a failed one has no after-hash."""
    intent = records.where("result = 'intent'").select("set_index", "action_id", *[F.col(c).alias(f"i_{c}") for c in IMMUTABLE])
    both = records.where("result <> 'intent'").join(intent, ["set_index", "action_id"])
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"i_{c}")), F.lit(c)) for c in IMMUTABLE if c != "after_sha"]))
    after = F.when(F.col("result") == "failed", F.col("after_sha").isNotNull()).otherwise(~F.col("after_sha").eqNullSafe(F.col("i_after_sha")))
    fields = F.concat(differs, F.when(after, F.array(F.lit("after_sha"))).otherwise(F.array().cast("array<string>")))
    return both.withColumn("fields", F.array_join(fields, ",")).where("fields <> ''").select("set_index", "action_id", "fields")


def terminal_after_applied(records: DataFrame) -> DataFrame:
    """Apply terminals that follow an applied one of the same action."""
    before = Window.partitionBy("action_id").orderBy("set_index", "seq").rowsBetween(Window.unboundedPreceding, -1)
    done = F.max(F.when(F.col("result") == "applied", 1).otherwise(0)).over(before)
    return records.withColumn("done", done).where("result <> 'intent' AND done = 1").select("set_index", "seq", "action_id")


def standalone_terminals(records: DataFrame) -> DataFrame:
    """Terminals without an intent in their set, and whether an earlier set's dangling intent allows them.

    Legal if the record before is an intent with the same fixed parts, or the terminal is a failure.
    """
    by = Window.partitionBy("action_id").orderBy("set_index", "seq")
    own = Window.partitionBy("set_index", "action_id")
    fixed = ("operation", "original_path", "target_path", "before_sha")
    seen = records.withColumn("before", F.lag(F.struct("result", *fixed)).over(by)).withColumn("intents", F.count_if(F.col("result") == "intent").over(own))
    same = F.col("before.result") == "intent"
    for c in fixed:
        same &= F.col(f"before.{c}").eqNullSafe(F.col(c))
    legal = F.coalesce(same, F.lit(False)) | (F.col("result") == "failed")
    return seen.where("result <> 'intent' AND intents = 0").select("set_index", "action_id", legal.alias("legal"))


def apply_after_restore(sets: DataFrame) -> DataFrame:
    """Apply sets that come after a restore."""
    before = Window.orderBy("set_index").rowsBetween(Window.unboundedPreceding, -1)
    return sets.withColumn("restored", F.max(F.when(F.col("kind") == "restore", 1).otherwise(0)).over(before)).where("kind = 'apply' AND restored = 1").select("set_index")


def coherence(sets: DataFrame) -> DataFrame:
    """One row of what a chain's headers must agree on."""
    return sets.agg((F.countDistinct("source_root") <= 1).alias("one_root"), (F.countDistinct("plan_sha") <= 1).alias("one_plan"), (F.countDistinct("run_id") == F.count("*")).alias("unique_runs"))


def kind_lineage(records: DataFrame) -> DataFrame:
    """Records that name an undone action outside a restore, or don't inside one."""
    return records.where((F.col("kind") == "restore") != F.col("undoes_action_id").isNotNull()).select("set_index", "seq", "action_id")


def unknown_undoes(records: DataFrame) -> DataFrame:
    """Inverses of actions that no apply record says were applied."""
    applied = records.where("kind = 'apply' AND result = 'applied'").select(F.col("action_id").alias("undoes_action_id")).distinct()
    return records.where("undoes_action_id IS NOT NULL").join(applied, "undoes_action_id", "left_anti").select("set_index", "seq", "action_id", "undoes_action_id")


def restore_order(records: DataFrame) -> DataFrame:
    """Applied actions, newest first: what a restore undoes in turn."""
    states = lifecycle(records).where("state IN ('applied', 'restore-failed', 'pending-restore')")
    return numbered(states, F.desc("set_index"), F.desc("seq"), name="turn").select("action", "state", "turn")


def inverse_records(records: DataFrame, run: str) -> DataFrame:
    """Inverse intents for what was applied: paths and hashes swapped, the undone action named."""
    applied = records.where("kind = 'apply' AND result = 'applied'")
    return applied.select(F.concat(F.lit(f"{run}/"), F.col("action_id")).alias("action_id"), F.col("action_id").alias("undoes_action_id"), "operation", F.col("target_path").alias("original_path"), F.col("original_path").alias("target_path"), F.col("after_sha").alias("before_sha"), F.col("before_sha").alias("after_sha"))


def adjudicated() -> Column:
    """What a dangling apply intent's crash left, from what is observed at its two names.

    Over ``operation``, ``overwrites`` (a target was there), ``source_ok`` (the source name holds the recorded
    object and bytes), ``source_absent``, ``published`` (the target name holds the expected output),
    ``target_absent`` and ``target_before`` (the target still holds what was to be overwritten).
    """
    source, gone, out = F.col("source_ok"), F.col("source_absent"), F.col("published")
    pre = F.when(F.col("overwrites"), F.col("target_before")).otherwise(F.col("target_absent"))
    rewrite = F.when(F.col("target_before"), F.lit("never-happened")).when(out, F.lit("completed")).otherwise(F.lit("external-interference"))
    moved = F.when(source & pre, F.lit("never-happened")).when(gone & out, F.lit("completed")).otherwise(F.lit("external-interference"))
    linked = F.when(source & pre, F.lit("never-happened")).when(source & out, F.lit("finish-remaining")).when(gone & out, F.lit("completed")).otherwise(F.lit("external-interference"))
    return F.when(F.col("operation") == "rewrite", rewrite).when((F.col("operation") == "rename") & F.col("overwrites"), moved).otherwise(linked)


def adjudicated_inverse() -> Column:
    """The same for a dangling inverse.

    Over ``operation``, ``clobbered`` (the undone action overwrote a target), ``applied_ok`` (the live name
    still holds the applied object), ``applied_absent``, ``reinstated`` (the original name holds what it
    should), ``original_absent`` and ``cleaned`` (the live name holds the clobbered bytes again).
    """
    live, back = F.col("applied_ok"), F.col("reinstated")
    rewrite = F.when(live, F.lit("never-happened")).when(back, F.lit("completed")).otherwise(F.lit("external-interference"))
    done = F.when(F.col("clobbered"), F.col("cleaned")).otherwise(F.col("applied_absent"))
    other = F.when(live & F.col("original_absent"), F.lit("never-happened")).when(live & back, F.lit("finish-remaining")).when(back & done, F.lit("completed")).otherwise(F.lit("external-interference"))
    return F.when(F.col("operation") == "rewrite", rewrite).otherwise(other)


def restore_precheck() -> Column:
    """Why an applied action can't be restored; null if it can.

    Over ``live_sha``, ``after_sha``, ``original_occupied``, ``operation``, ``backup_sha``, ``before_sha``,
    ``overwritten_sha`` and ``overwritten_backup_sha``.
    """
    needs = F.col("operation") != "rename"
    return (
        F.when(F.col("live_sha").isNull(), F.lit("skipped-unreadable"))
        .when(F.col("after_sha").isNotNull() & (F.col("live_sha") != F.col("after_sha")), F.lit("modified-since-apply"))
        .when(F.col("original_occupied"), F.lit("collision"))
        .when(needs & F.col("backup_sha").isNull(), F.lit("backup-missing"))
        .when(needs & (F.col("backup_sha") != F.col("before_sha")), F.lit("backup-mismatch"))
        .when(F.col("overwritten_sha").isNotNull() & ~F.col("overwritten_sha").eqNullSafe(F.col("overwritten_backup_sha")), F.lit("overwritten-backup-mismatch"))
    )
