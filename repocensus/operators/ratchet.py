"""Rules proposed from verdicts, their differences, violations, and the debt that may only shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shares import CONVENTION


def propose_rules(summary: DataFrame, drift: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """repo, dimension, expect, share, standing (enforce, documented, undecided), source.

    A team's decision outranks what is measured; where code moved, the recent bucket is meant, and enforced if strong.
    """
    keys = ["repo", "dimension"]
    out = summary.select(*keys, "dominant", "share", "total", "verdict")
    if drift is None:
        out = out.withColumn("recent", F.lit(None).cast("string")).withColumn("recent_share", F.lit(None).cast("double"))
    else:
        out = out.join(drift.filter("kind = 'moved'").select(*keys, "recent", "recent_share"), keys, "left")
    if decisions is None:
        out = out.withColumn("decided", F.lit(None).cast("string"))
    else:
        out = out.join(decisions.select(*keys, F.col("expect").alias("decided")), keys, "left")
    moved_strong = F.coalesce(F.col("recent_share") >= CONVENTION, F.lit(False))
    standing = (
        F.when(F.col("decided").isNotNull(), "enforce").when(F.col("verdict") == "too few to say", "undecided")
        .when((F.col("verdict") == "convention") | moved_strong, "enforce").when(F.col("verdict") == "weak", "documented").otherwise("undecided")
    )
    source = F.when(F.col("decided").isNotNull(), "decision").when(F.col("recent").isNotNull(), "recent").otherwise("whole")
    return out.select(*keys, F.coalesce("decided", "recent", "dominant").alias("expect"), F.coalesce("recent_share", "share").alias("share"), "total", standing.alias("standing"), source.alias("source"))


def rule_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed, changed or steady for every (repo, dimension) of two rule tables (repo, dimension, expect)."""
    a = before.select("repo", "dimension", F.col("expect").alias("before"), F.lit(True).alias("in_a"))
    b = after.select("repo", "dimension", F.col("expect").alias("after"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "steady").otherwise("changed")
    return a.join(b, ["repo", "dimension"], "full_outer").select("repo", "dimension", "before", "after", status.alias("status"))


def violations(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, dimension, path) whose bucket isn't the expected one. Rules are few, a row for each repo and dimension."""
    return observations.join(rules.select("repo", "dimension", "expect"), ["repo", "dimension"]).filter(F.col("bucket") != F.col("expect")).select("repo", "dimension", "path")


def ratchet(baseline: DataFrame, now: DataFrame, before_rules: DataFrame, after_rules: DataFrame) -> DataFrame:
    """The full outer set of accepted and present violations with its status.

    paid: no longer there. released: its rule is gone or changed. carried: in both. taken on: new under a rule that is new
    or changed. regression: new under a steady rule, never absorbed into the baseline.
    """
    keys = ["repo", "dimension", "path"]
    a = baseline.select(*keys).distinct().withColumn("was", F.lit(True))
    b = now.select(*keys).distinct().withColumn("is", F.lit(True))
    rules = rule_diff(before_rules, after_rules).select("repo", "dimension", F.col("status").alias("rule"))
    both = a.join(b, keys, "full_outer").join(rules, ["repo", "dimension"], "left")
    steady = F.col("rule") == "steady"
    status = (
        F.when(F.col("was").isNotNull() & F.col("is").isNotNull(), "carried")
        .when(F.col("was").isNotNull(), F.when(steady, "paid").otherwise("released"))
        .otherwise(F.when(steady, "regression").otherwise("taken on"))
    )
    return both.select(*keys, status.alias("status"))


def gate(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """New violations: those not accepted before."""
    return found.join(baseline, ["repo", "dimension", "path"], "left_anti")
