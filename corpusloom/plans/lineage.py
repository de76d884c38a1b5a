"""Attempts and how they follow each other: manifests and reports of the same runs, and the edges between them.

Attempts are rows of ``run_id``, ``sha`` (of what the attempt left) and, but for the first, ``prior_run`` and
``prior_sha``, the attempt that they say they continue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predecessors(attempts: DataFrame) -> DataFrame:
    """``run_id`` and ``prior_run`` of the edges that lead to an attempt with the hash that they name."""
    known = attempts.select(F.col("run_id").alias("prior_run"), F.col("sha").alias("prior_sha"))
    return attempts.select("run_id", "prior_run", "prior_sha").join(known, ["prior_run", "prior_sha"]).select("run_id", "prior_run")


def lineage_findings(attempts: DataFrame) -> DataFrame:
    """``run_id`` and ``problem``: edges that lead nowhere, forks, and first attempts or tips beside the one that there may be.

    Of several first attempts or tips each is a finding.  A walk isn't needed: attempts whose edges all lead
    somewhere, with one first attempt and no fork, are one chain, or there is a circle, which has no tip.
    """
    edges = predecessors(attempts)
    named = attempts.where("prior_run IS NOT NULL")
    lost = named.join(edges.select("run_id"), "run_id", "left_anti").select("run_id", F.lit("gap").alias("problem"))
    forks = edges.groupBy("prior_run").agg(F.count("*").alias("n")).where("n > 1").select(F.col("prior_run").alias("run_id"), F.lit("fork").alias("problem"))
    firsts = attempts.where("prior_run IS NULL").select("run_id", F.lit("first").alias("problem"))
    tips = attempts.select("run_id").join(edges.select(F.col("prior_run").alias("run_id")), "run_id", "left_anti").select("run_id", F.lit("tip").alias("problem"))
    ends = firsts.unionByName(tips)
    many = ends.groupBy("problem").agg(F.count("*").alias("n")).where("n > 1").select("problem")
    return lost.unionByName(forks).unionByName(ends.join(F.broadcast(many), "problem").select("run_id", "problem"))


def unified(manifests: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per run of either kind: what there is of it, whether both name the same predecessor, and which it is."""
    side = lambda rows, name: rows.select(F.col("run_id").alias(f"{name}_run"), F.struct("prior_run", "prior_sha").alias(f"{name}_prior"))
    both = side(manifests, "m").join(side(reports, "r"), F.col("m_run") == F.col("r_run"), "full")
    agree = F.col("m_run").isNull() | F.col("r_run").isNull() | F.col("m_prior").eqNullSafe(F.col("r_prior"))
    prior = F.when(F.col("m_run").isNotNull(), F.col("m_prior")).otherwise(F.col("r_prior"))
    return both.select(F.coalesce("m_run", "r_run").alias("run_id"), F.col("m_run").isNotNull().alias("has_manifest"), F.col("r_run").isNotNull().alias("has_report"), agree.alias("agree"), prior["prior_run"].alias("prior_run"), prior["prior_sha"].alias("prior_sha"))


def binding_findings(attempts: DataFrame, plan_sha: str | None = None) -> DataFrame:
    """``plan``, and the attempts' plans that aren't the one they should be, as one text.

    ``attempts``: plan, place, run_id, plan_sha.  They should be the given one, or that of the first attempt.
    """
    first = F.min_by("plan_sha", "place") if plan_sha is None else F.lit(plan_sha)
    said = F.sort_array(F.collect_list(F.struct("place", "run_id", "plan_sha")))
    per = attempts.groupBy("plan").agg(F.any_value(F.lit(plan_sha)).alias("given") if plan_sha else first.alias("given"), said.alias("said"))
    wrong = F.filter("said", lambda x: x["plan_sha"] != F.col("given"))
    named = F.array_join(F.transform(wrong, lambda x: F.concat_ws("=", x["run_id"], x["plan_sha"])), "; ")
    return per.select("plan", F.col("given").alias("expected"), named.alias("mismatch")).where("mismatch <> ''")
