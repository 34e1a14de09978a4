"""Distributions of classified files: tally, verdict, situation, drift, scoped rules, majorities and outliers.

Every operator takes long observations (repo, path, dimension, bucket); a null bucket doesn't speak to its dimension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shares import FLOOR, share, verdict

RECENT_LEAST, CONSOLIDATING = 10, 0.15

#: Dimension name to a column that gives the bucket of a row; add to it to measure more.
Dimensions = dict[str, Callable[[], Column]]


def observe(files: DataFrame, dimensions: dict[str, Column], repo: str = "repo", path: str = "path") -> DataFrame:
    """All dimensions of every file in one pass over its columns; only the buckets go on."""
    cases = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in sorted(dimensions.items())])
    return files.select(F.col(repo).alias("repo"), F.col(path).alias("path"), F.explode(cases).alias("o")).select("repo", "path", "o.*").filter("bucket is not null")


def tally(observations: DataFrame) -> DataFrame:
    """Count and up to three examples (the first paths) of each bucket; no list grows with its group."""
    keys = ["repo", "dimension", "bucket"]
    counted = observations.groupBy(*keys).agg(F.count("*").alias("n"), F.min("path").alias("e1"))
    for k in (1, 2):  # the next smallest path, again by a partial aggregate
        seen = counted.select(*keys, F.col(f"e{k}").alias("seen"))
        more = observations.join(seen, keys).filter(F.col("path") > F.col("seen")).groupBy(*keys).agg(F.min("path").alias(f"e{k + 1}"))
        counted = counted.join(more, keys, "left")
    return counted.select(*keys, "n", F.array_compact(F.array("e1", "e2", "e3")).alias("examples"))


def counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("repo", "dimension", "bucket").agg(F.count("*").alias("n"))


def summarise(tallied: DataFrame) -> DataFrame:
    """Per repo and dimension: dominant bucket (ties: first by name), its share, total, verdict, and the distribution as a map."""
    by = tallied.groupBy("repo", "dimension").agg(
        F.sum("n").alias("total"),
        F.min(F.struct((-F.col("n")).alias("m"), "bucket")).alias("top"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("distribution"),
    )
    out = by.select("repo", "dimension", F.col("top.bucket").alias("dominant"), share(-F.col("top.m"), F.col("total")).alias("share"), "total", "distribution")
    return out.withColumn("verdict", verdict(F.col("share"), F.col("total")))


def mode(summary: DataFrame, n_dimensions: int, repos: DataFrame | None = None) -> DataFrame:
    """The situation of each repo from how many of its dimensions are settled, split and readable.

    With ``repos`` (repo, files, in_scope) also those of which nothing was summarised: out of scope where all files were left
    out, empty where there are none.
    """
    n = float(n_dimensions)
    by = summary.groupBy("repo").agg(
        F.count(F.when(F.col("verdict") == "convention", 1)).alias("strong"),
        F.count(F.when(F.col("verdict") == "split", 1)).alias("split"),
        F.count(F.when(F.col("verdict") != "too few to say", 1)).alias("readable"),
    )
    split_share = F.coalesce(F.col("split") / F.when(F.col("readable") > 0, F.col("readable")), F.lit(0.0))
    name = (
        F.when(F.col("strong") / n >= 0.7, "settled")
        .when((F.col("strong") / n >= 0.4) & (split_share >= 0.2), "drifted")
        .when(F.col("readable") < n / 2, "too early")
        .when(F.col("strong") > 0, "mixed")
        .otherwise("greenfield")
    )
    out = by.withColumn("mode", name)
    if repos is None:
        return out
    every = repos.groupBy("repo").agg(F.sum("files").alias("files"), F.sum("in_scope").alias("in_scope")).join(out, "repo", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("strong", "split", "readable")]
    state = F.when((F.col("files") > 0) & (F.col("in_scope") == 0), "out of scope").when(F.col("in_scope") == 0, "empty").otherwise(F.coalesce("mode", F.lit("empty")))
    return every.select("repo", *counts, state.alias("mode"))


def drift(observations: DataFrame, recent: DataFrame) -> DataFrame:
    """Dimensions whose recent files (at least ten) have another dominant bucket, or the same by a clearly larger share."""
    every, late = (summarise(counts(x)).select("repo", "dimension", "dominant", "share", "total") for x in (observations, recent))
    late = late.filter(F.col("total") >= RECENT_LEAST).select("repo", "dimension", F.col("dominant").alias("recent"), F.col("share").alias("recent_share"))
    both = every.join(late, ["repo", "dimension"])
    kind = F.when(F.col("dominant") != F.col("recent"), "moved").when(F.round(F.col("recent_share") - F.col("share"), 3) > CONSOLIDATING, "consolidating")
    return both.withColumn("kind", kind).filter("kind is not null").select("repo", "dimension", "kind", "dominant", "share", "recent", "recent_share")


def scoped_rules(observations: DataFrame, subtree: Column, least_files: int = 12) -> DataFrame:
    """Subtrees of enough files in which a dimension is a convention, but another one than in the repo as a whole."""
    rows = observations.withColumn("subtree", subtree)
    files = rows.groupBy("repo", "subtree").agg(F.count_distinct("path").alias("files")).filter(F.col("files") >= least_files)
    inner = summarise(rows.groupBy(F.struct("repo", "subtree").alias("repo"), "dimension", "bucket").agg(F.count("*").alias("n")))
    inner = inner.filter("verdict = 'convention'").select("repo.*", "dimension", F.col("dominant").alias("expect"), "share", "total")
    whole = summarise(counts(observations)).select("repo", "dimension", F.col("dominant").alias("repo_dominant"))
    return inner.filter(F.col("total") >= FLOOR).join(files, ["repo", "subtree"]).join(whole, ["repo", "dimension"]).filter(~F.col("expect").eqNullSafe(F.col("repo_dominant")))


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group (ties: the smallest) with its count, share and the group's total."""
    c = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    out = c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), value)).alias("x"), F.sum("n").alias("total"))
    return out.select(*keys, F.col(f"x.{value}").alias(value), (-F.col("x.m")).alias("n"), share(-F.col("x.m"), F.col("total")).alias("share"), "total")


def outliers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values that aren't the majority and occur at most half as often."""
    c = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = majority(rows, keys, value).select(*keys, F.col(value).alias("dominant"), F.col("n").alias("dominant_n"))
    return c.join(top, keys).filter((F.col(value) != F.col("dominant")) & (2 * F.col("n") <= F.col("dominant_n")))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only k a group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)
