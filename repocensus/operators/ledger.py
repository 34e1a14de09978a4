"""Ledgers: commits, runs, outcomes, triage, measurements before and after, budgets, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that agents sign with, and domains that are their vendors'; kinds of signatures that were made, whether they can be trusted or not.
AGENT_NAME = r"(?i)^(claude|chatgpt|gpt-|codex|copilot|gemini|cursor|aider|devin|windsurf|amp|jules)\b|\bbot\b$"
AGENT_DOMAIN = r"(?i)@(anthropic|openai|users\.noreply\.cursor|githubcopilot)\."
SIGNED = ("G", "U", "X", "Y", "R")


def is_agent(person: Column) -> Column:
    """A co-author (name, email) who is an agent: by name, or by a vendor's domain. A privacy address alone says nothing: it is a person's."""
    return F.coalesce(person["name"].rlike(AGENT_NAME), F.lit(False)) | F.coalesce(person["email"].rlike(AGENT_DOMAIN), F.lit(False))


def provenance(commits: DataFrame) -> DataFrame:
    """Per repo: commits, those that name an agent as co-author, signed ones, authors, and the share since the first agent-named one.

    commits: repo, hash, author, date, signature, co_authors array<struct<name,email>>; a repo without agents has no share.
    """
    rows = commits.withColumn("agent", F.coalesce(F.exists("co_authors", is_agent), F.lit(False)))
    first = rows.filter("agent").groupBy("repo").agg(F.min("date").alias("_first"))
    rows = rows.join(first, "repo", "left").withColumn("since", F.coalesce(F.col("date") >= F.col("_first"), F.lit(False)))
    out = rows.groupBy("repo").agg(F.count("*").alias("commits"), F.count(F.when(F.col("agent"), 1)).alias("agent_named"), F.count(F.when(F.col("signature").isin(*SIGNED), 1)).alias("signed"), F.count_distinct("author").alias("authors"), F.count(F.when(F.col("since"), 1)).alias("since_adoption"))
    return out.withColumn("share_since", F.round(F.col("agent_named") / F.when(F.col("since_adoption") > 0, F.col("since_adoption")), 3))


def models_named(commits: DataFrame) -> DataFrame:
    """(repo, model, commits): agents by the name they sign with; one that a commit names twice is named once."""
    named = F.array_distinct(F.transform(F.filter("co_authors", is_agent), lambda c: c["name"]))
    return commits.select("repo", F.explode(named).alias("model")).groupBy("repo", "model").agg(F.count("*").alias("commits"))


def since_first(rows: DataFrame, keys: list[str], ts: str, marks: Column) -> DataFrame:
    """Rows at or after the first row of their group that ``marks``; groups without one have none. The firsts are joined back, no group is held whole."""
    first = rows.filter(marks).groupBy(*keys).agg(F.min(ts).alias("_first"))
    return rows.join(first, keys).filter(F.col(ts) >= F.col("_first")).drop("_first")


def outcome(runs: DataFrame) -> DataFrame:
    """Per ledger, of its latest run: seen, autonomy, error rate, blended unit cost, and what is saved by unit and year.
    runs: ledger, ts, handled, escalated, wrong, cost_per_unit, baseline, volume.

    Earlier runs don't count. Costs are null where the latest run states none: nothing is estimated, and no cost isn't a cost of nothing. Of two runs at
    one time the one with more handled counts, and so on in the order of the columns.
    """
    figures = ["handled", "escalated", "wrong", "cost_per_unit", "baseline", "volume"]
    by = runs.groupBy("ledger").agg(F.max(F.struct("ts", *figures)).alias("x")).select("ledger", *[F.col(f"x.{c}").alias(c) for c in figures])
    seen = F.col("handled") + F.col("escalated")
    some = F.when(seen > 0, seen)
    blended = (F.col("handled") * F.col("cost_per_unit") + F.col("escalated") * F.col("baseline")) / some
    out = by.withColumn("seen", seen).withColumn("autonomy", F.round(F.col("handled") / some, 3)).withColumn("error_rate", F.round(F.col("wrong") / F.when(F.col("handled") > 0, F.col("handled")), 3)).withColumn("blended", F.round(blended, 2))
    return out.withColumn("saved_per_unit", F.round(F.col("baseline") - blended, 2)).withColumn("saved_per_year", F.round((F.col("baseline") - blended) * F.col("volume"), 0))


def keyword_triage(records: DataFrame, categories: dict[str, str]) -> DataFrame:
    """records (id, text, reference, label) with decision and wrong: handled if exactly one category (name: pattern) matches and there is a reference, else escalated."""
    hits = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(k)) for k, p in sorted(categories.items())]))
    rows = records.withColumn("matched", F.coalesce(hits, F.array().cast("array<string>")))
    handled = F.col("reference").isNotNull() & (F.size("matched") == 1)
    return rows.withColumn("decision", F.when(handled, F.col("matched")[0])).withColumn("handled", handled).withColumn("wrong", F.coalesce(handled & (F.col("matched")[0] != F.col("label")), F.lit(False)))


def baseline_vs_now(before: DataFrame, now: DataFrame, directions: DataFrame, least_days: int = 14) -> DataFrame:
    """(repo, metric, value, on) twice to before, after, delta and whether it worked; only where enough days lie between."""
    a = before.select("repo", "metric", F.col("value").alias("before"), F.col("on").alias("from_day"))
    b = now.select("repo", "metric", F.col("value").alias("after"), F.col("on").alias("to_day"))
    rows = a.join(b, ["repo", "metric"]).join(F.broadcast(directions), "metric").filter(F.datediff("to_day", "from_day") >= least_days)
    delta = F.round(F.col("after") - F.col("before"), 3)
    better = F.when(F.col("direction") == "up", delta > 0).otherwise(delta < 0)
    return rows.withColumn("delta", delta).withColumn("verdict", F.when(better, "worked").otherwise("no-effect"))


def context_budget(entries: DataFrame, budget: int) -> DataFrame:
    """entry and text to its estimated tokens, whether it is over ``budget``, the room left, and the budget that would be written for it."""
    tokens = F.ceil(F.length("text") / 4).cast("long")
    out = entries.withColumn("tokens", F.coalesce(tokens, F.lit(0)))
    return out.withColumn("over", F.col("tokens") > budget).withColumn("headroom", F.lit(budget).cast("long") - F.col("tokens")).withColumn("generated", F.greatest(F.lit(500), F.ceil(1.25 * F.col("tokens") / 100) * 100).cast("long"))


def check_verdict(checks: DataFrame, changed: DataFrame) -> DataFrame:
    """Per case: PROVEN, PARTLY, FAILED, FAILED ELSEWHERE or NOT PROVEN. checks: case, ran, passed, output; changed: case, file.

    A failure is the case's own if its output names one of the changed files.
    """
    failed = checks.filter("ran and not passed").join(changed, "case").filter(F.expr("contains(output, file)")).select("case").distinct().withColumn("own", F.lit(True))
    by = checks.groupBy("case").agg(F.count("*").alias("all"), F.count(F.when(F.col("ran"), 1)).alias("ran"), F.count(F.when(F.col("ran") & F.col("passed"), 1)).alias("passed")).join(failed, "case", "left")
    name = F.when(F.col("own"), "FAILED").when(F.col("passed") < F.col("ran"), "FAILED ELSEWHERE").when(F.col("ran") == 0, "NOT PROVEN").when(F.col("ran") < F.col("all"), "PARTLY").otherwise("PROVEN")
    return by.select("case", "all", "ran", "passed", name.alias("verdict"))


def record_once(cases: DataFrame, keys: list[str]) -> DataFrame:
    return cases.dropDuplicates(keys)


def discrimination(results: DataFrame, floor: int = 95) -> DataFrame:
    """Per task: share of breaks caught (score below the reference's), and whether the reference itself reaches the floor. results: task, variant, is_reference, score."""
    ref = results.filter("is_reference").groupBy("task").agg(F.max("score").alias("reference"))
    rows = results.filter("not is_reference").join(ref, "task", "left")
    by = rows.groupBy("task").agg(F.count("*").alias("breaks"), F.count(F.when(F.col("score") < F.col("reference"), 1)).alias("caught"), F.max("reference").alias("reference"))
    return by.withColumn("share", F.round(F.col("caught") / F.col("breaks"), 3)).withColumn("reference_ok", F.col("reference") >= floor)
