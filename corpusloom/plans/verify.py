"""Verification: findings about contents, lifecycles, accounting and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import kept

#: Steps that a reported outcome may take from one attempt to the next (fixed values).
ALLOWED = [("not-attempted", "skipped"), ("not-attempted", "failed"), ("not-attempted", "applied"), ("failed", "applied"), ("applied", "already-applied")]


def content_findings(files: DataFrame) -> DataFrame:
    """Files that aren't UTF-8, and files with other line ends than LF; one file can be both."""
    checks = F.array_compact(F.array(F.when(~F.col("utf8_valid"), F.lit("encoding")), F.when(~F.col("newline_style").isin("lf", "none"), F.lit("newlines"))))
    return files.select("path", F.explode(checks).alias("check"))


def output_findings(applied: DataFrame, live: DataFrame) -> DataFrame:
    """Applied outputs that are missing, or whose bytes aren't as recorded."""
    rows = applied.join(live.select(F.col("path").alias("live_path"), "live_sha"), F.col("target_path") == F.col("live_path"), "left")
    problem = F.when(F.col("after_sha").isNull(), F.lit("no-after-hash")).when(F.col("live_path").isNull(), F.lit("output-missing")).when(~F.col("live_sha").eqNullSafe(F.col("after_sha")), F.lit("output-hash"))
    return rows.select("action_id", problem.alias("check")).where("check IS NOT NULL")


def backup_findings(records: DataFrame, backups: DataFrame) -> DataFrame:
    """Source and overwritten copies that are missing or differ from what they copy.

    Records name up to two copies; they become a row each and are looked up by their key.
    """
    roles = F.array(
        F.struct(F.lit("source").alias("role"), F.col("backup_path").alias("key"), F.col("before_sha").alias("expected")),
        F.struct(F.lit("overwritten").alias("role"), F.col("overwritten_backup_path").alias("key"), F.col("overwritten_sha").alias("expected")),
    )
    rows = records.select("action_id", F.explode(roles).alias("c")).select("action_id", "c.*").where("key IS NOT NULL")
    found = rows.join(backups.select(F.col("key").alias("held"), "sha"), F.col("key") == F.col("held"), "left")
    problem = F.when(F.col("held").isNull(), F.lit("backup-missing")).when(~F.col("sha").eqNullSafe(F.col("expected")), F.lit("backup-hash"))
    return found.select("action_id", "role", problem.alias("check")).where("check IS NOT NULL")


def accounting(report_applied: DataFrame, manifest_applied: DataFrame, reported: DataFrame) -> DataFrame:
    """Claims of either side that the other doesn't know, per attempt."""
    keys = ["attempt", "action_id"]
    claimed = report_applied.join(manifest_applied, keys, "left_anti").select(*keys, F.lit("reported-not-recorded").alias("check"))
    silent = manifest_applied.join(reported, keys, "left_anti").select(*keys, F.lit("recorded-not-reported").alias("check"))
    return claimed.unionByName(silent)


def observation(status: Column, skip_reason: Column) -> Column:
    """What an outcome says of its action; null for a preview."""
    return F.when(status == "would_apply", F.lit(None)).when((status == "skipped") & (skip_reason == "already-applied"), F.lit("already-applied")).otherwise(status)


def report_states(outcomes: DataFrame) -> DataFrame:
    """Folds each action's observations in attempt order: the final state and the illegal steps.

    The first observation sets the state (already-applied as applied); allowed ones move it, others are noted
    and change nothing.
    """
    known = outcomes.where("observation IS NOT NULL").groupBy("action_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "observation"))).alias("seen"))
    start = F.struct(F.lit(None).cast("string").alias("state"), F.array().cast("array<string>").alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        now, before = x["observation"], acc["state"]
        allowed = F.lit(False)
        for a, b in ALLOWED:
            allowed |= (before == a) & (now == b)
        moved = F.when(before.isNull(), F.when(now == "already-applied", F.lit("applied")).otherwise(now)).when(allowed & (now != "already-applied"), now).otherwise(before)
        bad = F.when(before.isNotNull() & ~allowed, F.array_append(acc["bad"], F.concat_ws(">", before, now))).otherwise(acc["bad"])
        return F.struct(moved.alias("state"), bad.alias("bad"))

    return known.select("action_id", F.aggregate("seen", start, step).alias("f")).select("action_id", "f.state", F.array_join("f.bad", ",").alias("illegal"))


def coverage(plan: DataFrame, states: DataFrame, outcomes: DataFrame, applied: DataFrame) -> DataFrame:
    """Findings of whether each planned action has one certified end.

    ``plan``: action_id; ``states``: action_id and lifecycle state; ``outcomes``: attempt, action_id and
    observation; ``applied``: the actions that manifests say were applied.
    """
    row = lambda df, check, detail: df.select("action_id", F.lit(check).alias("check"), detail.alias("detail"))
    # Read many times below: what an action's evidence comes to is worked out once.
    states = kept(states, "states")
    repeated = row(plan.groupBy("action_id").count().where("count > 1"), "coverage", F.lit("planned twice"))
    open_ = states.where("state NOT IN ('applied', 'failed')")
    unfinished = row(open_, "coverage", F.concat(F.lit("lifecycle is "), F.col("state")))
    doubled = row(outcomes.groupBy("attempt", "action_id").count().where("count > 1"), "coverage", F.concat(F.lit("reported twice in "), F.col("attempt").cast("string")))
    once = kept(outcomes.groupBy("attempt", "action_id").agg(F.min_by("observation", F.col("line")).alias("observation")), "once")
    claims = once.where("observation IN ('applied', 'already-applied')").join(applied, "action_id", "left_anti")
    unfounded = row(claims, "coverage", F.concat(F.lit("claims without record: "), F.col("observation")))
    trusted = once.join(claims.select("attempt", "action_id"), ["attempt", "action_id"], "left_anti")
    final = kept(report_states(trusted), "final")
    illegal = row(final.where("illegal <> ''"), "coverage", F.concat(F.lit("illegal steps: "), F.col("illegal")))
    expected = F.when(F.col("m").isin("applied", "pending-restore", "restored", "restore-failed"), F.lit("applied")).when(F.col("m") == "failed", F.lit("failed"))
    both = final.join(states.select("action_id", F.col("state").alias("m")), "action_id")
    against = row(both.where(expected.isNull() | (F.col("state") != expected)), "coverage", F.concat_ws(" against ", "state", "m"))
    certified = states.where("state IN ('applied', 'failed')").select("action_id").unionByName(final.select("action_id").join(states, "action_id", "left_anti")).distinct()
    previews = once.where("observation IS NULL").select("action_id").distinct().join(certified, "action_id", "left_anti").join(open_, "action_id", "left_anti")
    previewed = row(previews, "coverage-uncertified", F.lit("dry run only"))
    planned = plan.select("action_id").distinct()
    missing = row(planned.join(certified, "action_id", "left_anti").join(previews, "action_id", "left_anti").join(open_, "action_id", "left_anti"), "coverage", F.lit("no end"))
    evidence = states.select("action_id").unionByName(once.select("action_id")).distinct()
    foreign = row(evidence.join(planned, "action_id", "left_anti"), "coverage", F.lit("not planned"))
    out = repeated
    for more in (unfinished, doubled, unfounded, illegal, against, previewed, missing, foreign):
        out = out.unionByName(more)
    return out


def frontmatter_findings(files: DataFrame) -> DataFrame:
    """Files ``path`` and decoded text ``x`` (null where the bytes aren't UTF-8) whose block lacks what it must hold.

    Only names that end in .md, in that case, are looked at, and only texts that have a block.
    """
    from ..functions.detect import front_problem
    from ..functions.text import front_block

    blocks = files.where(F.endswith("path", F.lit(".md"))).select("path", front_block(F.col("x")).alias("block")).where("block IS NOT NULL")
    return blocks.select("path", F.lit("frontmatter").alias("check"), front_problem("block").alias("detail")).where("detail IS NOT NULL")


def discovery_findings(skips: DataFrame, checked: DataFrame) -> DataFrame:
    """Files that couldn't be looked at (``path``, ``reason``), and, where ``checked`` has no row, that nothing was."""
    kind = F.when(F.col("reason") == "unreadable", F.lit("discovery-unreadable")).when(F.col("reason") == "timeout", F.lit("discovery-timeout"))
    found = skips.select("path", kind.alias("check")).where("check IS NOT NULL")
    none = checked.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("path"), F.lit("zero-checked").alias("check"))
    return found.unionByName(none)


def root_findings(headers: DataFrame, root: str) -> DataFrame:
    """Manifests (``run_id``, ``source_root``) of another root than the one that is verified."""
    return headers.where(F.col("source_root") != root).select("run_id", F.lit("manifest-root").alias("check"), F.concat_ws(" is not ", "source_root", F.lit(root)).alias("detail"))


def unprovable(records: DataFrame, reports: DataFrame) -> DataFrame:
    """Attempts whose records say that something was changed, but of which there is no report."""
    return records.where("kind = 'apply'").select("attempt").distinct().join(reports.select("attempt").distinct(), "attempt", "left_anti")


def heartbeat_findings(lines: DataFrame, counts: tuple[str, ...] = ("processed", "skipped", "failed")) -> DataFrame:
    """``run``, ``place`` and ``problem`` of progress lines that fall behind the one before, or pass their total."""
    before = Window.partitionBy("run").orderBy("place")
    fell = F.lit(False)
    for c in counts:
        fell |= F.coalesce(F.col(c) < F.lag(c).over(before), F.lit(False))
    problem = F.when(fell, F.lit("falls")).when(F.col("processed") > F.col("total"), F.lit("passes the total"))
    return lines.select("run", "place", problem.alias("problem")).where("problem IS NOT NULL")


def reconcile(expected: DataFrame, plan: DataFrame, done) -> DataFrame:
    """What a run made of a corpus, against what was to come of it: ``contract``, ``path``, ``problem``.

    ``expected``: path, disposition, operations and ``after`` (digest of what is left of the file under ``place``);
    ``plan``: a row per file; ``done``: what the run left.
    """
    from ..functions.facts import digest
    from ..operators.relations import mismatches

    planned = plan.select("path", "disposition", F.col("ops").alias("operations"))
    wanted = expected.select("path", "disposition", F.when(F.col("disposition") == "action", F.col("operations")).otherwise(F.lit("")).alias("operations"))
    actions = planned.where("disposition = 'action'").select("path", F.lit("applied").alias("outcome"))
    recorded = done.journal.where("result = 'applied'").select(F.col("original_path").alias("path"))
    applied = done.outcomes.where("outcome = 'applied'").select("path")
    places = expected.where("disposition <> 'skip'").select(F.col("place").alias("path"), F.col("after").alias("sha"))
    left = done.corpus.select("path", digest(F.col("content")).alias("sha"))
    contracts = {
        "inventory": mismatches(wanted, planned, "path", []),
        "plan": mismatches(wanted.join(planned.select("path"), "path", "left_semi"), planned, "path", ["disposition", "operations"]),
        "report": mismatches(actions, done.outcomes, "path", ["outcome"]),
        "manifest": mismatches(applied, recorded, "path", []),
        "bytes": mismatches(places, left.join(places.select("path"), "path", "left_semi"), "path", ["sha"]),
    }
    out = None
    for name, found in contracts.items():
        row = found.select(F.lit(name).alias("contract"), "path", "problem")
        out = row if out is None else out.unionByName(row)
    return out
