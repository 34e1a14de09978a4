"""Checks over results, locale parity, surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.shares import guarded

PLURAL = "_(zero|one|two|few|many|other)$"


def denominator_guard(rows: DataFrame, count: str, considered: str) -> DataFrame:
    """``rows`` with value and why: null and a reason where the pass didn't run, never a 0 that nobody counted."""
    value, why = guarded(F.col(count), F.col(considered))
    return rows.withColumn("value", value).withColumn("why", why)


def suspicious(results: DataFrame) -> DataFrame:
    """Results (repo, metric, count, considered, share, why) that contradict themselves, each with what is wrong."""
    what = F.array_compact(F.array(
        F.when((F.col("count") > 0) & (F.coalesce("considered", F.lit(0)) == 0), "counted over nothing"),
        F.when(F.col("count").isNull() & F.col("why").isNull(), "refused without a reason"),
        F.when((F.col("share") < 0) | (F.col("share") > 1), "share outside 0 to 1"),
        F.when(F.col("count") > F.col("considered"), "more than were looked at"),
    ))
    return results.select("repo", "metric", F.explode(what).alias("finding"))


def premature(registries: DataFrame, rules: DataFrame, modes: DataFrame) -> DataFrame:
    """(repo, finding): registries (repo, components, sites) with components that nothing calls, and rules (repo, standing)
    enforced in repos whose mode is "too early"."""
    idle = registries.filter("components > 0 and coalesce(sites, 0) = 0").select("repo", F.lit("a registry that nothing calls").alias("finding"))
    early = rules.filter("standing = 'enforce'").select("repo").distinct().join(modes.filter("mode = 'too early'").select("repo"), "repo", "left_semi")
    return idle.distinct().unionByName(early.select("repo", F.lit("rules enforced too early").alias("finding")))


#: Signs that a value was cut out of source; that it is content (a path, an address, a phrase); that a reason is none.
DEBRIS = r"[\"`]|\$\{|\$event|=>|</|^\s*[{\[(]|[)\]}]\s*$|\\$"
CONTENT, LONGEST_VALUE = r"[\s/@]|://", 32
NO_REASON = r"(?i)^\s*$|undefined|null|\[object"


def _field(node: str, name: str, kind: str) -> Column:
    """A field of a variant object if it is of this kind ("BOOLEAN", "STRING" or a number), else null; as text."""
    found = F.try_variant_get(F.col(node), f"$.{name}", "variant")
    is_kind = F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") if kind == "number" else F.schema_of_variant(found) == kind
    return F.when(is_kind, F.try_variant_get(F.col(node), f"$.{name}", "string"))


def explode_variant(rows: DataFrame, node: str = "v") -> DataFrame:
    """``rows`` with pos, key and value of each element of the variant ``node``; scalars have none."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(node).outer()))


def nested_findings(documents: DataFrame) -> DataFrame:
    """(slot, file, v) to what any node of an artifact says that it shouldn't, with the node's path: a refusal without a reason, a share out of bounds.

    Nodes are opened level by level, until none is left that holds others; a level is written before the next, so plans stay short whatever the depth.
    """
    level, out = documents.select("slot", "file", F.lit("").alias("path"), "v"), None
    holds = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    while True:
        level = cut(level.filter(holds))
        refused = F.coalesce((_field("v", "available", "BOOLEAN") == "false") | (_field("v", "ran", "BOOLEAN") == "false"), _field("v", "available", "BOOLEAN") == "false", _field("v", "ran", "BOOLEAN") == "false", F.lit(False))
        why, value = F.try_variant_get("v", "$.why", "string"), _field("v", "share", "number")
        found = F.array(
            F.when(refused & (why.isNull() | why.rlike(NO_REASON)), F.struct(F.lit("refusal with no reason").alias("what"), F.when(F.col("path") == "", "(root)").otherwise(F.col("path")).alias("detail"))),
            F.when((value.cast("double") < 0) | (value.cast("double") > 1), F.struct(F.lit("share outside 0..1").alias("what"), F.concat("path", F.lit(" = "), value).alias("detail"))),
        )
        here = level.select("slot", "file", F.explode(F.array_compact(found)).alias("f")).select("slot", "file", "f.what", "f.detail")
        out = here if out is None else out.unionByName(here)
        if level.isEmpty():
            return out
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        level = explode_variant(level).select("slot", "file", path.alias("path"), F.col("value").alias("v"))


def artifact_findings(artifacts: DataFrame) -> DataFrame:
    """(slot, file, json) to (slot, file, what, detail): artifacts that can't be trusted as they are.

    Those that don't parse; refusals without a reason and shares out of bounds at any depth; measured values (axes.component.prop.observed) that are debris of parsing or
    content; a registry of which nothing is called although it could be; rules enforced in a mode that claims nothing; a collapse claimed without a count. Null json: unreadable.
    """
    parsed = cut(artifacts.select("slot", "file", F.try_parse_json("json").alias("v")))
    broken = parsed.filter("v is null").select("slot", "file", F.lit("unreadable artifact").alias("what"), F.lit("this file is on disk and does not parse").alias("detail"))
    docs = parsed.filter("v is not null")
    values = docs.select("slot", "file", F.try_variant_get("v", "$.axes", "variant").alias("v"))
    for name in ("component", "prop"):
        values = explode_variant(values).select("slot", "file", *(["component"] if name == "prop" else []), F.col("key").alias(name), F.col("value").alias("v"))
    values = explode_variant(values.withColumn("v", F.try_variant_get("v", "$.observed", "variant"))).filter("key is not null")
    bad = F.when(F.col("key").rlike(DEBRIS), "parse debris in a measured value").when((F.length("key") > LONGEST_VALUE) | F.col("key").rlike(CONTENT), "content in a measured value")
    values = values.select("slot", "file", bad.alias("what"), F.concat("component", F.lit("."), "prop", F.lit(" = "), "key").alias("detail")).filter("what is not null")
    mode, called = _field("v", "mode", "STRING"), F.coalesce(F.try_variant_get("v", "$.considered.called", "long"), F.lit(0))
    entries, unreachable = F.try_variant_get("v", "$.considered.registry", "long"), F.coalesce(F.size(F.try_variant_get("v", "$.notMeasurableByTag", "array<variant>")), F.lit(0))
    enforced = F.size(F.map_keys(F.try_variant_get("v", "$.enforce", "map<string,variant>")))
    claims = F.array(
        F.when((called == 0) & (entries - F.greatest(unreachable, F.lit(0)) > 0), F.struct(F.lit("a registry nothing calls").alias("what"), F.concat(entries.cast("string"), F.lit(" component(s), 0 found")).alias("detail"))),
        F.when(mode.startswith("too early to say") & (enforced > 0), F.struct(F.lit("enforcing what the scan would not claim").alias("what"), F.concat(enforced.cast("string"), F.lit(" rule(s)")).alias("detail"))),
        F.when(mode.contains("came apart") & ~mode.rlike(r"\d+ of \d+"), F.struct(F.lit("a collapse claimed without a count").alias("what"), F.substring(mode, 1, 90).alias("detail"))),
    )
    claimed = docs.select("slot", "file", F.explode(F.array_compact(claims)).alias("f")).select("slot", "file", "f.what", "f.detail")
    return broken.unionByName(nested_findings(docs)).unionByName(values).unionByName(claimed)


def cross_pass(conventions: DataFrame, findings: DataFrame, dimension: str, bucket: str) -> DataFrame:
    """Repos where one pass calls ``bucket`` the convention while another flags the same thing as defects (repo, n)."""
    own = conventions.filter((F.col("dimension") == dimension) & (F.col("dominant") == bucket) & (F.col("verdict") == "convention")).select("repo", "share")
    return own.join(findings.filter("n > 0"), "repo")


def moved_targets(artifacts: DataFrame) -> DataFrame:
    """Slots that describe several targets, or were counted by rules that have changed since. artifacts: slot, target, rules, now_rules."""
    by = artifacts.groupBy("slot").agg(F.count_distinct("target").alias("targets"), F.bool_or(F.col("rules") != F.col("now_rules")).alias("stale"))
    return by.filter((F.col("targets") > 1) | F.col("stale"))


def locale_parity(keys: DataFrame) -> DataFrame:
    """repo, language, key of every key some language of the repo has and this one lacks; plural forms count as one key.

    Keys that all languages have are dropped before anything is expanded.
    """
    base = keys.select("repo", "language", F.regexp_replace("key", PLURAL, "").alias("key")).distinct()
    languages = base.select("repo", "language").distinct()
    n = languages.groupBy("repo").agg(F.count("*").alias("n"))
    gaps = base.groupBy("repo", "key").agg(F.count("*").alias("have")).join(n, "repo").filter("have < n").select("repo", "key")
    return gaps.join(languages, "repo").join(base, ["repo", "language", "key"], "left_anti").select("repo", "language", "key")


def plural_forms(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("key").rlike(PLURAL)).groupBy("repo", "language").agg(F.count("*").alias("plural_forms"))


def survey(passes: dict[str, DataFrame], repos: DataFrame) -> DataFrame:
    """One row a repo from all passes, each (repo, value); null where a pass has nothing on it."""
    out = repos.select("repo").distinct()
    for name, df in sorted(passes.items()):
        out = out.join(df.select("repo", F.col("value").alias(name)), "repo", "left")
    return out


def validate_profile(registry: DataFrame) -> DataFrame:
    """Failures of registry rows by kind, with how many; a missing tier is one finding with a count. registry: component, level, surface, props."""
    what = F.array_compact(F.array(
        F.when(F.coalesce("component", F.lit("")) == "", "no name"), F.when(F.col("level").isNull(), "no level"), F.when(F.col("surface").isNull(), "no surface"),
        F.when(F.col("component").rlike("^[a-z]"), "lower-case name"), F.when(F.size("props") != F.size(F.array_distinct("props")), "a prop declared twice"),
    ))
    return registry.select(F.explode(what).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
