"""Rules over measured facts: predicates, mechanisms, rings, practices, levels, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = ("equals", "contains", "startsWith", "gte", "lt")


def validate_predicates(rules: DataFrame) -> DataFrame:
    """Rejected rules with a reason: an operator nobody knows, no path, nothing tested. rules: technique, group, path, op, operand, negate."""
    why = F.when(F.col("op").isNull(), "nothing tested").when(~F.col("op").isin(*OPERATORS), "unknown operator").when(F.coalesce(F.col("path"), F.lit("")) == "", "no path")
    return rules.withColumn("why", why).filter("why is not null")


def _holds() -> Column:
    v, x = F.col("value"), F.col("operand")
    number = v.try_cast("double")
    held = (
        F.when(F.col("op") == "equals", v == x).when(F.col("op") == "contains", v.contains(x)).when(F.col("op") == "startsWith", v.startswith(x))
        .when(F.col("op") == "gte", number >= x.try_cast("double")).when(F.col("op") == "lt", number < x.try_cast("double"))
    )
    return F.coalesce(held, F.lit(False)) != F.coalesce(F.col("negate"), F.lit(False))


def leaves(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every leaf of every rule for every repo, with the fact it looked at and whether it held; a missing fact doesn't hold."""
    repos = facts.select("repo").distinct()
    each = repos.crossJoin(F.broadcast(rules))
    return each.join(facts.select("repo", "path", "value"), ["repo", "path"], "left").withColumn("held", _holds())


def evaluate_predicates(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, technique, applies): all leaves of some group hold. Groups are alternatives, the leaves of a group go together."""
    group = leaves(facts, rules).groupBy("repo", "technique", "group").agg(F.bool_and("held").alias("held"))
    return group.groupBy("repo", "technique").agg(F.bool_or("held").alias("applies"))


def why(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """The leaves that held, as "path op operand (value)", for each repo and technique."""
    said = F.concat_ws(" ", "path", "op", "operand", F.concat(F.lit("("), F.coalesce("value", F.lit("absent")), F.lit(")")))
    return leaves(facts, rules).filter("held").groupBy("repo", "technique").agg(F.array_sort(F.collect_set(said)).alias("because"))


def toolchain(evidence: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """repo, present, missing: a mechanism is there if anything of its kind (dependency, file, script) matches one of its patterns.

    evidence: repo, kind, name; mechanisms: mechanism, kind, pattern, a short list.
    """
    hit = evidence.join(F.broadcast(mechanisms), "kind").filter(F.expr("name rlike pattern")).select("repo", "mechanism").distinct().withColumn("there", F.lit(True))
    every = evidence.select("repo").distinct().crossJoin(F.broadcast(mechanisms.select("mechanism").distinct()))
    rows = every.join(hit, ["repo", "mechanism"], "left")
    there = F.col("there").isNotNull()
    return rows.groupBy("repo").agg(F.array_sort(F.collect_list(F.when(there, F.col("mechanism")))).alias("present"), F.array_sort(F.collect_list(F.when(~there, F.col("mechanism")))).alias("missing"))


def ring(evidence: DataFrame) -> DataFrame:
    """technique to ring, counted in distinct projects: hold, adopt, trial or assess, with the span of the dated evidence."""

    def projects(v: str) -> Column:
        return F.count_distinct(F.when(F.col("verdict") == v, F.col("project")))

    by = evidence.groupBy("technique").agg(projects("worked").alias("worked"), projects("no-effect").alias("no_effect"), projects("rejected").alias("rejected"), F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.when(F.col("date").isNull(), 1)).alias("undated"))
    name = F.when((F.col("no_effect") >= 2) | (F.col("rejected") >= 3), "hold").when((F.col("worked") >= 2) & (F.col("no_effect") == 0), "adopt").when(F.col("worked") >= 1, "trial").otherwise("assess")
    return by.withColumn("ring", name)


def practice_compare(facts: DataFrame, practices: DataFrame) -> DataFrame:
    """met, diverges or gap of each practice (metric, op, target, measured_over) in each repo; a gap where it wasn't measured, or over nothing."""
    repos = facts.select("repo").distinct().crossJoin(F.broadcast(practices))
    value = facts.select("repo", F.col("metric"), F.col("value"))
    over = facts.select("repo", F.col("metric").alias("measured_over"), F.col("value").alias("over"))
    rows = repos.join(value, ["repo", "metric"], "left").join(over, ["repo", "measured_over"], "left")
    v, t = F.col("value"), F.col("target")
    met = F.when(F.col("op") == "equals", v == t).when(F.col("op") == "lte", v <= t).when(F.col("op") == "gte", v >= t)
    gap = v.isNull() | (F.col("measured_over").isNotNull() & (F.coalesce(F.col("over"), F.lit(0)) == 0))
    return rows.select("repo", "metric", "op", "target", "value", "over", F.when(gap, "gap").when(met, "met").otherwise("diverges").alias("state"))


def delegation_level(facts: DataFrame, requirements: DataFrame) -> DataFrame:
    """repo, level, missing: the highest level such that its requirements and those of all below hold; what the next one lacks.

    facts: repo, requirement (those that hold); requirements: level, requirement.
    """
    every = facts.select("repo").distinct().crossJoin(F.broadcast(requirements))
    rows = every.join(facts.select("repo", "requirement").distinct().withColumn("ok", F.lit(True)), ["repo", "requirement"], "left")
    by = rows.groupBy("repo", "level").agg(F.bool_and(F.col("ok").isNotNull()).alias("held"), F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col("requirement")))).alias("lacks"))
    w = Window.partitionBy("repo").orderBy("level")
    run = by.withColumn("all", F.min(F.col("held").cast("int")).over(w))
    top = run.groupBy("repo").agg(F.coalesce(F.max(F.when(F.col("all") == 1, F.col("level"))), F.lit(0)).alias("level"), F.min(F.when(F.col("all") == 0, F.struct("level", "lacks"))).alias("next"))
    return top.select("repo", "level", F.coalesce("next.lacks", F.array().cast("array<string>")).alias("missing"))


def selection_rules(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """accept or reject each zone (spec, zone, task, item, cardinality, fields, editable, elements) by the rules that match it.

    A rule (task, item, cardinality, min_fields, max_fields, editable: null matches all; forbid, choose: arrays) forbids
    elements; where rules name what to choose, one of those must be among the zone's elements.
    """
    z, r = zones.alias("z"), F.broadcast(rules.alias("r"))

    def same(c: str) -> Column:
        return F.col(f"r.{c}").isNull() | (F.col(f"r.{c}") == F.col(f"z.{c}"))

    match = same("task") & same("item") & same("cardinality") & same("editable") & (F.col("z.fields") >= F.coalesce("r.min_fields", F.lit(0))) & (F.col("z.fields") <= F.coalesce("r.max_fields", F.lit(2**31 - 1)))
    rows = z.join(r, match, "left")
    by = rows.groupBy("z.spec", "z.zone", "z.elements").agg(F.array_distinct(F.flatten(F.collect_list("r.forbid"))).alias("forbid"), F.array_distinct(F.flatten(F.collect_list("r.choose"))).alias("choose"))
    bad = F.array_intersect("elements", "forbid")
    ok = (F.size("choose") == 0) | F.arrays_overlap("elements", "choose")
    # what is chosen beside what is forbidden stands: the zone offers the right representation
    verdict = F.when((F.size("choose") > 0) & ok, "accept").when((F.size(bad) > 0) | ~ok, "reject").otherwise("accept")
    return by.select("spec", "zone", "elements", F.array_sort("forbid").alias("forbid"), F.array_sort("choose").alias("choose"), verdict.alias("verdict"))


def decide(rules: DataFrame, task: str, fields: int) -> DataFrame:
    """Allowed and forbidden representations of a task over so many fields."""
    hit = rules.filter((F.col("task").isNull() | (F.col("task") == task)) & (F.coalesce("min_fields", F.lit(0)) <= fields) & (F.coalesce("max_fields", F.lit(2**31 - 1)) >= fields))
    each = hit.select(F.explode(F.array(F.struct(F.lit("choose").alias("kind"), F.col("choose").alias("of")), F.struct(F.lit("forbid").alias("kind"), F.col("forbid").alias("of")))).alias("x")).select("x.kind", F.explode("x.of").alias("name")).distinct()
    return each.agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in ("choose", "forbid")])
