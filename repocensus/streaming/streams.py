"""The repeated measurements as streams: gate, ledger windows, cases once, ratchet, sliding distributions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shares import share, verdict


def gate_stream(arriving: DataFrame, dimensions: dict[str, Column], rules: DataFrame) -> DataFrame:
    """Arriving files that break a rule: stream-static join, append mode. Rules are a row for each repo and dimension, so they grow with the
    repos: nothing is broadcast unless the planner finds it small."""
    cases = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in sorted(dimensions.items())])
    seen = arriving.select("repo", "path", F.explode(cases).alias("o")).select("repo", "path", "o.*").filter("bucket is not null")
    return seen.join(rules.select("repo", "dimension", "expect"), ["repo", "dimension"]).filter(F.col("bucket") != F.col("expect"))


def ledger_windows(runs: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """handled, escalated and wrong in tumbling windows of ts; runs later than the watermark are dropped."""
    by = runs.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "ledger")
    out = by.agg(F.sum("handled").alias("handled"), F.sum("escalated").alias("escalated"), F.sum("wrong").alias("wrong"))
    return out.select(F.col("w.start").alias("window_start"), "ledger", "handled", "escalated", "wrong", share(F.col("handled"), F.col("handled") + F.col("escalated")).alias("autonomy"))


def cases_once(cases: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each case once within the watermark."""
    return cases.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sliding_shares(events: DataFrame, window: str = "180 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts of each bucket in sliding windows of ts, for the recent side of drift."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "repo", "dimension", "bucket")
    return by.agg(F.count("*").alias("n")).select(F.col("w.end").alias("window_end"), "repo", "dimension", "bucket", "n")


def sliding_verdicts(counted: DataFrame) -> DataFrame:
    """Verdicts of finished windows (a table that sliding_shares has written)."""
    out = counted.groupBy("window_end", "repo", "dimension").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "bucket")).alias("x"))
    s = share(-F.col("x.m"), F.col("total"))
    return out.select("window_end", "repo", "dimension", F.col("x.bucket").alias("dominant"), s.alias("share"), "total", verdict(s, F.col("total")).alias("verdict"))


def late_against(every: DataFrame, kept: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Rows that came too late, by window: ``every`` has all rows' counts, ``kept`` what a stream in append mode has written. keys, counted, late, closed.

    A window that the watermark hasn't passed isn't written yet: closed is false, and nothing of it is late so far.
    """
    both = every.select(*keys, F.col(count).alias("every")).join(kept.select(*keys, F.col(count).alias("counted"), F.lit(True).alias("there")), keys, "left")
    closed = F.coalesce("there", F.lit(False))
    return both.select(*keys, F.coalesce("counted", F.lit(0)).alias("counted"), F.when(closed, F.col("every") - F.col("counted")).otherwise(0).alias("late"), closed.alias("closed"))


SHARDS = 16


def ratchet_stream(scans: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Accepted debt carried as keyed state. scans: a stream of (repo, scan, dimension, path), a row for each violation that a scan of a repo found, and
    one with a null path for a scan that found none. Out: (repo, scan, dimension, path, status), once for each scan.

    The first scan of a repo accepts what it finds (``accepted``). Later ones find it still there (``carried``) or gone (``paid``, for good), and whatever else they
    find is a ``regression``, which never becomes accepted. A repo that pays everything stays known. A scan with a number that the repo has passed
    changes nothing, so one delivered twice counts once. The rows of one scan of a repo have to come in one batch. State is kept by repo and
    ``shards`` hashes of the path, so no repo is one group; every shard learns of each scan. The debt of a shard is held whole in one task, and all debt in the state
    store, which is memory unless the session says otherwise; ``ratchet_statuses`` says the same of debt of any size.
    """
    names = ["repo", "scan", "dimension", "path", "shard"]
    own = F.when(F.col("path").isNotNull(), F.pmod(F.xxhash64("dimension", "path"), F.lit(shards)).cast("int"))

    def told(batches):
        """A violation goes to its shard alone; that a repo was scanned goes to all, once for each Arrow batch. The state's sets take what comes twice."""
        for b in batches:
            yield from pa.Table.from_batches([b]).filter(pc.is_valid(b.column("shard"))).to_batches()
            scanned = pa.Table.from_batches([b]).group_by(["repo", "scan"]).aggregate([])
            take, shard = np.repeat(np.arange(scanned.num_rows), shards), np.tile(np.arange(shards, dtype=np.int32), scanned.num_rows)
            repo, scan = (scanned.column(c).combine_chunks().take(pa.array(take)) for c in names[:2])
            yield pa.RecordBatch.from_arrays([repo, scan, pa.nulls(len(take), pa.string()), pa.nulls(len(take), pa.string()), pa.array(shard)], names=names)

    types = dict(scans.dtypes)
    rows = scans.select("repo", "scan", "dimension", "path", own.alias("shard")).mapInArrow(told, f"repo {types['repo']}, scan {types['scan']}, dimension string, path string, shard int")

    def step(key, frames, state):
        import pandas as pd

        got = pd.concat(list(frames))
        last, held = state.get if state.exists else (None, [])
        accepted, out = {tuple(x.split("\x1f", 1)) for x in held}, []
        for scan, found in got.groupby("scan"):
            if last is not None and scan <= last:
                continue
            here = set(found.dropna(subset=["path"])[["dimension", "path"]].itertuples(index=False, name=None))
            if last is None:
                named = {v: "accepted" for v in here}
                accepted = here
            else:
                named = {v: "paid" for v in accepted - here} | {v: "carried" for v in accepted & here} | {v: "regression" for v in here - accepted}
                accepted = accepted & here
            last = int(scan)
            out += [(key[0], last, *v, status) for v, status in sorted(named.items())]
        state.update((last, sorted("\x1f".join(v) for v in accepted)))
        yield pd.DataFrame(out, columns=["repo", "scan", "dimension", "path", "status"])

    return rows.groupBy("repo", "shard").applyInPandasWithState(step, "repo string, scan long, dimension string, path string, status string", "last long, accepted array<string>", "append", "NoTimeout")


def ratchet_statuses(folder: str):
    """A foreachBatch function that says the same as ``ratchet_stream``, with the debt in tables: a shuffle and a sort that spill, so no task holds the debt of a repo or a shard.

    Statuses of a batch are written to ``folder``/rows, named by the batch's id: (repo, scan, dimension, path, status). What a repo has accepted are its rows of the latest
    scan that are accepted or carried, so there is no second copy, and debt that no batch touches isn't rewritten: ``folder``/known says for each repo its latest scan
    and the batch that has it. A batch that is run again writes the same. A null repo or dimension is one like any other.
    """
    rows = "repo string, scan long, dimension string, path string, status string"

    def step(found: DataFrame, batch_id: int) -> None:
        spark, here = found.sparkSession, f"batch={batch_id}"
        found = found.select("repo", F.col("scan").cast("long").alias("scan"), "dimension", "path")
        schema = "repo string, last long, held long"
        known = spark.read.schema(schema).parquet(f"{folder}/known/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
        told = found.groupBy("repo").agg(F.array_sort(F.collect_set("scan")).alias("scans")).alias("t")
        told = told.join(known.alias("k"), F.expr("t.repo <=> k.repo"), "left").select("t.repo", F.expr("filter(scans, s -> last is null or s > last)").alias("scans"), "last", "held")
        told.filter("size(scans) > 0").write.mode("overwrite").parquet(f"{folder}/repos/{here}")
        repos = spark.read.schema("repo string, scans array<long>, last long, held long").parquet(f"{folder}/repos/{here}")  # a row a repo: the planner sees how large it is
        places = ["array_position(scans, scan) AS o", "last IS NULL AS new"]  # of its scans in this batch; 0 is what was accepted before
        seen = found.filter("path is not null").alias("f").join(repos.alias("r"), F.expr("f.repo <=> r.repo")).selectExpr("f.repo", "dimension", "path", "scans", *places).filter("o > 0")
        held = [r["held"] for r in repos.filter("held is not null").select("held").distinct().collect()]
        if held:
            before = spark.read.schema(f"{rows}, batch long").parquet(f"{folder}/rows").filter(F.col("batch").isin(held) & F.col("status").isin("accepted", "carried"))
            debt = before.alias("b").join(repos.alias("r"), F.expr("b.repo <=> r.repo and b.scan = r.last and b.batch = r.held"))
            seen = seen.unionByName(debt.selectExpr("b.repo", "dimension", "path", "scans", "0L AS o", "false AS new"))
        # get() of a place behind the last is null: no scan comes after; arrays of scans aren't shuffled
        each = seen.selectExpr("repo", "dimension", "path", "o", "new", "if(o > 0, get(scans, int(o) - 1), null) AS scan", "get(scans, int(o)) AS after")
        by = Window.partitionBy("repo", "dimension", "path").orderBy("o")
        each = each.select("*", F.dense_rank().over(by).alias("nth"), F.lag("o").over(by).alias("left"), F.lead("o").over(by).alias("right"))
        still = F.expr("o + if(new, 0, 1) = nth")  # accepted, and found in every scan so far
        there = F.when(still, F.when(F.expr("new and o = 1"), "accepted").otherwise("carried")).otherwise("regression")
        found_now = F.when(F.expr("o > 0 and not left <=> o"), F.struct("scan", there.alias("status")))
        gone = F.when(still & F.expr("after is not null and (right is null or right > o + 1)"), F.struct(F.col("after").alias("scan"), F.lit("paid").alias("status")))
        out = each.select("repo", "dimension", "path", F.explode(F.filter(F.array(found_now, gone), lambda x: x.isNotNull())).alias("x")).select("repo", "x.scan", "dimension", "path", "x.status")
        out.write.mode("overwrite").parquet(f"{folder}/rows/{here}")
        now = repos.select("repo", F.element_at("scans", -1).alias("last"), F.lit(batch_id).cast("long").alias("held"))
        latest = known.unionByName(now).groupBy("repo").agg(F.max(F.struct("last", "held")).alias("x"))
        latest.select("repo", "x.*").write.mode("overwrite").parquet(f"{folder}/known/{here}")

    return step


def ratchet_batch(folder: str):
    """A foreachBatch function that carries the accepted violations: those of repos in the batch shrink to what is still there, and a
    repo that none had before brings its own. A row without a path says that its repo was looked at and nothing found; its debt goes.

    Every batch writes a new version under ``folder``, named by its id; a batch that is run again writes the same one. Rows without a path
    in a version are the repos that are known. ``ratchet_stream`` keeps the same by key, without rewriting what no batch touches.
    """

    def step(found: DataFrame, batch_id: int) -> None:
        spark = found.sparkSession
        keys = ["repo", "dimension", "path"]
        found = found.select(*keys).distinct()
        target = f"{folder}/batch={batch_id}"
        seen = found.select("repo").distinct()
        known = seen.select("repo", *[F.lit(None).cast("string").alias(c) for c in keys[1:]])
        found = found.filter("path is not null")
        if batch_id == 0:
            found.unionByName(known).write.mode("overwrite").parquet(target)
            return
        before = spark.read.schema(found.schema).parquet(f"{folder}/batch={batch_id - 1}")
        first = found.join(before.select("repo").distinct(), "repo", "left_anti")
        carried = before.join(found, keys, "left_semi")
        other = before.join(seen, "repo", "left_anti")
        carried.unionByName(other).unionByName(first).unionByName(known).write.mode("overwrite").parquet(target)

    return step
